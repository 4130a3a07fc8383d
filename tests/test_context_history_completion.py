import json

import pytest
from pyspark.sql import functions as F

from citeflow.operators import completion, context, history, prompts
from citeflow.settings import Settings
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def found(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "none")], "qid long, question string")
    hits = spark.createDataFrame(
        [
            (1, 2, " two ", "T2", " http://b "),
            (1, 1, "one", "T1", "http://a"),
            (1, 3, "three", "T3", None),
            (1, 4, "four", "T4", "http://a"),
            (1, 5, "five", None, " "),
            (1, 6, "six", "T6", None),
        ],
        "qid long, rank int, chunk string, title string, url string",
    )
    return context.result_lists(questions, hits, ["chunk", "title", "url"])


def test_context_web(found):
    rows = dict(found.select("qid", context.context_web(F.col("results"))).collect())
    assert rows[2] == ""
    assert rows[1] == (
        "Context document 1: one [URL: http://a]\n\nContext document 2: two [URL: http://b]\n\n"
        "Context document 3: three [URL: #]\n\nContext document 4: four [URL: http://a]\n\n"
        "Context document 5: five [URL: #]\n\nContext document 6: six [URL: #]\n\n"
    )


def test_context_bot_keeps_text_and_prints_none(found):
    rows = dict(found.select("qid", context.context_bot(F.col("results"))).collect())
    assert rows[1].startswith("Context document 1: one [URL: http://a]\n\nContext document 2:  two  [URL:  http://b ]")
    assert "Context document 3: three [URL: None]" in rows[1] and rows[2] == ""


def test_citation_numbers_drift_from_documents(found):
    cited = dict(found.select("qid", context.citations_by_url(F.col("results"))).collect())
    assert [tuple(c) for c in cited[1]] == [
        (1, "T1", "http://a"), (2, "T2", " http://b "), (3, "T3", None), (4, None, " "),
    ]
    assert cited[2] == []


def test_defaults_for_missing_columns(spark):
    df = spark.createDataFrame([(None, 1)], "source_url string, n int")
    rows = df.select(
        context.url_or_unknown(df, "source_url"),
        context.url_or_unknown(df, "url"),
        context.title_or_unknown(df, "document_title"),
        context.url_default(F.col("source_url")),
    ).first()
    assert tuple(rows) == (None, "Unknown Source", "Unknown Title", "#")


def test_context_and_citations_share_one_shuffle(found):
    both = found.select(
        context.context_web(F.col("results")).alias("a"), context.citations_by_url(F.col("results")).alias("b")
    )
    assert plan_of(both).count("Exchange hashpartitioning") <= 2


def conversation(spark, n):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")


@pytest.mark.parametrize("length, n, turns", [(1, 10, []), (4, 4, [0, 1, 2]), (9, 4, [5, 6, 7]), (3, 1, []), (3, 20, [0, 1])])
def test_history_window_leaves_out_the_newest(spark, length, n, turns):
    window = history.history_window(conversation(spark, length), n)
    assert sorted(r["turn"] for r in window.collect()) == turns
    assert "WindowGroupLimit" in plan_of(window)


def test_strip_citations(spark):
    text = " a[^1][^23] b [^x] Sources: [^1] t Sources: u"
    df = spark.createDataFrame([(text,), ("Sources: x",), ("plain",)], "t string")
    got = [r[0] for r in df.select(history.strip_citations(F.col("t"))).collect()]
    assert got == ["a b [^x]", "", "plain"]


def test_route(spark):
    asked = spark.createDataFrame([(1, "now"), (2, "alone")], "qid long, question string")
    rewritten = F.concat(F.lit("R:"), "question")
    told = history.with_history(asked, conversation(spark, 3), 10, True)
    rows = {r.qid: r for r in history.query_route(told, rewritten).collect()}
    assert rows[1].search_query == "R:now" and json.loads(rows[1].chat_history) == [
        {"role": "user", "content": "m0"}, {"role": "assistant", "content": "m1"},
    ]
    assert rows[2].search_query == "alone" and rows[2].chat_history == "[]"
    off = history.query_route(history.with_history(asked, conversation(spark, 3), 10, False), rewritten)
    assert {(r.search_query, r.chat_history) for r in off.collect()} == {("now", ""), ("alone", "")}
    line = told.select(history.history_render(F.col("history"))).collect()
    assert {r[0] for r in line} == {"user: m0\nassistant: m1", ""}


def test_normalize(spark):
    df = spark.createDataFrame([("  It's OK \n",)], "t string")
    bot, web = df.select(
        history.question_normalize(F.col("t"), "bot"), history.question_normalize(F.col("t"), "web")
    ).first()
    assert bot == "it's ok" and web == "  Its OK \n"
    with pytest.raises(ValueError):
        history.question_normalize(F.col("t"), "phone")


def test_offline_provider(spark):
    text = (
        "Context document 1: First one. Second. [URL: http://a]\n\n"
        "Context document 2: no stop\nhere [URL: #]\n\n"
    )
    df = spark.createDataFrame([(1, text), (2, "")], "qid long, context string")
    prompted = df.withColumn("prompt", prompts.prompt_web(F.lit("[]"), F.col("context"), F.lit("q")))
    out = dict(completion.complete(prompted, Settings()).select("qid", "response").collect())
    assert out[1] == (
        "First one. [^1]\nno stop\nhere [^2]\n\nSources:\n"
        "[^1] [Context document 1](http://a)\n[^2] [Context document 2](#)"
    )
    assert out[2] == prompts.REFUSAL
    asked = df.limit(1).select(prompts.rewrite_prompt(F.lit("user: hi\nassistant: yes"), F.lit("why?")).alias("prompt"))
    assert completion.complete(asked, Settings()).first()["response"] == "why? user: hi assistant: yes"
    none = df.limit(1).select(F.lit(None).cast("string").alias("prompt"))
    assert completion.complete(none, Settings()).first()["response"] is None
    assert "Python" not in plan_of(completion.complete(prompted, Settings()))


def test_pluggable_provider(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, prompt string")
    settings = Settings(provider="echo", models={"echo": ("m1", "m2")})
    out = completion.complete(df, settings, providers={"echo": lambda: lambda model, p: f"{model}:{p}"}, tasks=2)
    assert dict(out.select("id", "response").collect()) == {1: "m1:a", 2: None}
    with pytest.raises(ValueError):
        completion.complete(df, settings, providers={})


def test_a_failing_call_costs_only_its_row(spark):
    def client(model, prompt):
        if prompt == "bad":
            raise TimeoutError("too slow")
        return prompt.upper()

    df = spark.createDataFrame([(i, "bad" if i % 3 == 0 else f"p{i}") for i in range(9)], "id int, prompt string")
    out = completion.complete(df, Settings(provider="x", models={"x": ("m",)}), providers={"x": lambda: client}, tasks=1)
    got = {r["id"]: (r["response"], r["response_error"]) for r in out.collect()}
    assert got == {i: (None, "TimeoutError: too slow") if i % 3 == 0 else (f"P{i}", None) for i in range(9)}
    assert "MapInPandas" not in plan_of(out)


def test_brackets_in_a_url(spark):
    text = "Context document 1: First one. Second. [URL: https://x/[1]]\n\nContext document 2: Two. [URL: #]\n\n"
    df = spark.createDataFrame([(text,)], "context string")
    prompted = df.withColumn("prompt", prompts.prompt_web(F.lit("[]"), F.col("context"), F.lit("q")))
    said = completion.complete(prompted, Settings()).first()["response"]
    assert said == (
        "First one. [^1]\nTwo. [^2]\n\nSources:\n"
        "[^1] [Context document 1](https://x/[1])\n[^2] [Context document 2](#)"
    )


def test_model_and_apology(spark):
    df = spark.createDataFrame([("offline", "x"), ("openai", ""), ("openai", None)], "p string, r string")
    rows = df.select(
        completion.model_select(F.col("p"), Settings().models),
        completion.response_or_apology(F.col("r")),
        completion.is_answered(F.col("r")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("extractive", "x", True), ("gpt-4.1", completion.APOLOGY, False), ("gpt-4.1", completion.APOLOGY, False),
    ]
    with pytest.raises(Exception, match="unknown completion provider"):
        df.select(completion.model_select(F.lit("nobody"), Settings().models)).collect()
