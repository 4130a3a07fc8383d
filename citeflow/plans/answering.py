"""The two front ends as whole plans: many questions in, cited and rendered answers out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.functions import markup
from citeflow.operators import context as ctx
from citeflow.operators.completion import complete, response_or_apology
from citeflow.operators.history import (
    history_render,
    query_route,
    question_normalize,
    with_history,
)
from citeflow.operators.prompts import prompt_bot, prompt_web, rewrite_prompt
from citeflow.operators.rendering import rendered_pages
from citeflow.operators.retrieval import hybrid_first_seen, legs, search_projection
from citeflow.session import written
from citeflow.settings import Settings
from citeflow.sources.corpus import CONTENT_NAMES, content_fallback
from citeflow.sources.transcript import transcript_rows

# A search: questions ``(qid, question)`` and k to hits ``(qid, rank, score, chunk_id)``.
Search = Callable[[DataFrame, int], DataFrame]


def searched_questions(questions: DataFrame, messages: DataFrame, settings: Settings) -> DataFrame:
    """``(qid, question, chat_history, search_query)`` for web questions.

    Written once: rewriting may call a paid service, and the result is used for both search and
    prompt.
    """
    asked = questions.select("qid", question_normalize(F.col("question"), "web").alias("question"))
    told = with_history(asked, messages, settings.num_messages, settings.use_history)
    has_history = F.size("history") > 0
    prompt = rewrite_prompt(history_render(F.col("history")), F.col("question"))
    rewritten = complete(
        told.withColumn("_prompt", F.when(has_history, prompt)), settings, "_prompt", "_rewritten"
    )
    routed = query_route(rewritten, F.col("_rewritten"))
    return written(routed.select("qid", "question", "chat_history", "search_query"), "questions")


def answer_web(
    questions: DataFrame,
    messages: DataFrame,
    corpus: DataFrame,
    semantic: Search,
    keyword: Search,
    settings: Settings,
) -> DataFrame:
    """Answers to web questions; ``qid`` names the conversation whose newest message they are.

    Returns ``(qid, question, chat_history, search_query, context, response, formatted, display)``.
    """
    k, text = settings.num_chunks, settings.search_column
    url = settings.url_column if settings.url_column in corpus.columns else None
    columns = [text, url] if url else [text]
    asked = searched_questions(questions, messages, settings)
    query = asked.select("qid", F.col("search_query").alias("question"))
    hits = written(legs(semantic(query, k), keyword(query, k)), "hits")
    merged = hybrid_first_seen(search_projection(hits, corpus, columns), k, text)
    found = ctx.result_lists(asked, merged, columns)
    prompted = found.withColumn(
        "context", ctx.context_web(F.col("results"), text, url)
    ).withColumn("prompt", prompt_web(F.col("chat_history"), F.col("context"), F.col("question")))
    answered = complete(prompted.drop("results"), settings)
    body = markup.body_part(F.col("response"))
    return answered.select(
        "qid",
        "question",
        "chat_history",
        "search_query",
        "context",
        "response",
        markup.list_spacing(body, markup.sources_part(F.col("response"))).alias("formatted"),
        markup.citation_superscript(F.col("response")).alias("display"),
    )


def answer_bot(
    questions: DataFrame, corpus: DataFrame, search: Search, settings: Settings
) -> DataFrame:
    """Answers to bot questions, without history.

    Returns ``(qid, question, context, citations, response, shown)``; ``shown`` is the apology when
    there is no response.
    """
    k, text = settings.num_chunks, settings.search_column
    # The content may come under several names, so a corpus without the configured column answers too.
    content = [c for c in (text, *CONTENT_NAMES) if c in corpus.columns][:1]
    columns = [*content, *[c for c in (settings.title_column, settings.url_column) if c in corpus.columns]]
    asked = questions.withColumn("question", question_normalize(F.col("question"), "bot"))
    hits = written(search(asked.select("qid", "question"), k), "hits")
    results = content_fallback(search_projection(hits, corpus, columns), text, columns).select(
        "qid",
        "rank",
        "content_text",
        ctx.title_or_unknown(corpus, settings.title_column).alias("title"),
        ctx.url_or_unknown(corpus, settings.url_column).alias("url"),
    )
    found = ctx.result_lists(asked, results, ["content_text", "title", "url"])
    prompted = (
        found.withColumn("context", ctx.context_bot(F.col("results"), "content_text"))
        .withColumn("citations", ctx.citations_by_url(F.col("results")))
        .withColumn("prompt", prompt_bot(F.col("context"), F.col("citations"), F.col("question")))
    )
    answered = complete(prompted.drop("results"), settings)
    return answered.withColumn("shown", response_or_apology(F.col("response"))).drop("prompt", "response_error")


def web_transcript(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Transcript rows of web answers for ``(qid, turn, question)``: the question as it was typed, and
    the response as it came, always both."""
    pairs = questions.select("qid", "turn", "question").join(answered.select("qid", "response"), "qid")
    return transcript_rows(pairs.withColumnRenamed("qid", "conv_id"), only_answered=False)


def answer_pages(answered: DataFrame) -> DataFrame:
    """Message pages of the answers of `answer_bot` that have a response."""
    told = answered.filter(F.coalesce("response", F.lit("")) != "")
    return rendered_pages(told.select(F.col("qid").alias("response_id"), "response"))
