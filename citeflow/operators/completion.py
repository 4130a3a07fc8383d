"""Completion: prompt and model name to text, by a pluggable provider."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.functions.text import strip
from citeflow.operators.prompts import REFUSAL
from citeflow.session import written
from citeflow.settings import Settings

APOLOGY = "Sorry, no answer could be produced this time. Please ask again."

# A provider called from executors: made once per partition, then given (model, prompt) pairs.
Client = Callable[[str, str], str | None]
ClientFactory = Callable[[], Client]


def first_sentence(text: Column) -> Column:
    """Text up to its first full stop, question or exclamation mark before white space."""
    bare = strip(text)
    found = F.regexp_extract(bare, r"(?s)\A(.*?[.!?])(?:\s|\z)", 1)
    return F.when(found == "", bare).otherwise(found)


def between(prompt: Column, tag: str) -> Column:
    """Content of a slot. The slots wrap free text, so the outermost pair counts."""
    return F.regexp_extract(prompt, rf"(?s)<{tag}>\n(.*)\n</{tag}>", 1)


# Shape of one numbered document inside a prompt.
# A URL holds no line break, but may hold brackets.
_DOCUMENT = r"(?s)Context document \d+: .*? \[URL: [^\n]*\]\n\n"
_DOCUMENT_PARTS = r"(?s)\AContext document \d+: (.*) \[URL: ([^\n]*)\]\n\n\z"


def extractive_answer(docs: Column) -> Column:
    """A deterministic stand-in for a model: the first sentence of every context document with its
    mark, then the sources; without documents the refusal sentence. Documents count from 1."""
    said = F.transform(
        docs,
        lambda d, i: F.concat(
            first_sentence(F.regexp_extract(d, _DOCUMENT_PARTS, 1)),
            F.lit(" [^"), (i + 1).cast("string"), F.lit("]"),
        ),
    )
    cited = F.transform(
        docs,
        lambda d, i: F.concat(
            F.lit("[^"), (i + 1).cast("string"),
            F.lit("] [Context document "), (i + 1).cast("string"),
            F.lit("]("), F.regexp_extract(d, _DOCUMENT_PARTS, 2), F.lit(")"),
        ),
    )
    answer = F.concat(
        F.array_join(said, "\n"), F.lit("\n\nSources:\n"), F.array_join(cited, "\n")
    )
    return F.when(F.size(docs) == 0, F.lit(REFUSAL)).otherwise(answer)


def extended_query(prompt: Column) -> Column:
    """Stand-in for query rewriting: the question followed by what was said, on one line."""
    said = F.regexp_replace(between(prompt, "chat_history"), r"(?U)\s+", " ")
    return strip(F.concat_ws(" ", between(prompt, "question"), said))


def _offline(df: DataFrame, prompt: str, out: str) -> DataFrame:
    """Offline provider: answers prompts that hold a context, extends the query of those that do not.

    The documents are a column of their own, so they are found once per prompt.
    """
    docs = F.regexp_extract_all(between(F.col(prompt), "context"), F.lit(_DOCUMENT), F.lit(0))
    found = df.withColumn("_docs", docs)
    text = F.when(
        F.col(prompt).contains("\n<context>\n"), extractive_answer(F.col("_docs"))
    ).otherwise(extended_query(F.col(prompt)))
    return found.withColumn(out, F.when(F.col(prompt).isNotNull(), text)).drop("_docs")


def openai_client() -> Client:
    """Client of a hosted model; needs the vendor's package and key on the executors."""
    from openai import OpenAI

    client = OpenAI(api_key=os.environ["OPENAI_API_KEY"])
    return lambda model, prompt: client.responses.create(model=model, input=prompt).output_text


PROVIDERS: dict[str, ClientFactory] = {"openai": openai_client}


def complete(
    df: DataFrame,
    settings: Settings,
    prompt: str = "prompt",
    out: str = "response",
    providers: dict[str, ClientFactory] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``out``, the completion of ``prompt``, and ``<out>_error``; a null prompt gives null.

    The provider is checked before any row is read. The offline provider is made of column
    expressions and never fails. Others run in Arrow batches, spread over ``tasks`` (four per core unless
    given), with one client per partition. A call that fails gives null and its message as the error, so it costs no
    other row its answer. The result is written here, once: later steps read it and never call again.
    """
    if settings.provider == "offline":
        return _offline(df, prompt, out).withColumn(f"{out}_error", F.lit(None).cast("string"))
    known = PROVIDERS if providers is None else providers
    if settings.provider not in known:
        raise ValueError(f"unknown completion provider {settings.provider!r}")
    factory, model = known[settings.provider], settings.model_name

    def run(batches):
        client = factory()

        def ask(text):
            if text is None:
                return None, None
            try:
                return client(model, text), None
            except Exception as e:  # noqa: BLE001 - whatever the service raises belongs to its row
                return None, f"{type(e).__name__}: {e}"

        for batch in batches:
            told = [ask(text) for text in batch[prompt]]
            batch[out], batch[f"{out}_error"] = [t[0] for t in told], [t[1] for t in told]
            yield batch

    more = [T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())]
    tasks = tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
    return written(df.repartition(tasks).mapInPandas(run, T.StructType([*df.schema.fields, *more])), "completed")


def model_select(provider: Column, models: dict[str, tuple[str, ...]]) -> Column:
    """Model of each row's provider: the first one it offers. An unknown provider fails the job."""
    chosen = F.raise_error(F.concat(F.lit("unknown completion provider "), provider))
    for name, offered in models.items():
        chosen = F.when(provider == name, F.lit(offered[0])).otherwise(chosen)
    return chosen


def response_or_apology(response: Column) -> Column:
    return F.when(F.coalesce(response, F.lit("")) == "", F.lit(APOLOGY)).otherwise(response)


def is_answered(response: Column) -> Column:
    """Only an answered question is stored by the bot."""
    return F.coalesce(response, F.lit("")) != ""
