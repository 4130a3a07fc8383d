import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from checks import inputs as I
from checks.compare import compare, duck
from checks.registry import QUERIES
from citeflow.operators import retrieval
from citeflow.operators.prompts import REFUSAL
from citeflow.plans import answering
from citeflow.session import scratch_folder
from citeflow.settings import Settings
from citeflow.streaming import answering as stream_answering
from citeflow.streaming import channels
from tests.conftest import plan_of

# streamed and indexed ones run in the full comparison; these cover each plan at the smallest scale
COMPARED = sorted(
    set(QUERIES) - {"first_contact", "clear_history", "end_session", "default_search", "answer_stream"}
)


@pytest.fixture(scope="module")
def con(sf) -> duckdb.DuckDBPyConnection:
    return duck(sf)


def test_registry_and_sql_agree():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    # learnt vectors are beyond SQL; tests/test_latent.py compares them with a plain decomposition
    beyond = {"pipeline", "semantic_search_latent"}
    assert {n for n in queries if not n.startswith("op")} - beyond <= set(sql)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, sf, con, name):
    result = compare(spark, con, sf, name)
    assert result.startswith(("ok", "ROWS ONLY")), result
    assert "types" not in result, result


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.count() == 40 and "shown" in rows.columns


def test_no_pairs_of_everything(spark, sf, monkeypatch):
    for name in ("hybrid_boosted", "answer_bot", "deletion_plan", "clear_history_batch"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    for name in ("top_k_per_query", "history_window", "dedupe_by_text", "log_tail_by_source"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf)), name
    # searches store their blocks: what each block runs is seen where it is ranked
    plans, ranked = [], retrieval._ranked

    def seen(*args):
        plans.append(plan_of(ranked(*args)))
        return ranked(*args)

    monkeypatch.setattr(retrieval, "_ranked", seen)
    for name in ("keyword_search", "semantic_search"):
        QUERIES[name](spark, sf)
    assert len(plans) == 2
    for plan in plans:
        assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_corpus_without_the_configured_column_answers(spark):
    corpus = spark.createDataFrame([(1, "rivers run. More.", "T", "https://x/[1]")], "chunk_id long, content string, document_title string, source_url string")
    asked = spark.createDataFrame([(5, "rivers")], "qid long, question string")
    told = answering.answer_bot(
        asked, corpus, lambda q, k: retrieval.keyword_search(corpus, q, k, text="content"), Settings(search_column="body")
    )
    assert told.first()["response"] == "rivers run. [^1]\n\nSources:\n[^1] [Context document 1](https://x/[1])"


def test_without_history_the_raw_question_is_searched(spark, sf):
    settings = Settings(use_history=False)
    rows = answering.searched_questions(I.web_questions(spark, sf), I.messages(spark, sf), settings)
    assert rows.filter("search_query <> question or chat_history <> ''").count() == 0


def test_answer_stream_in_batches(spark, sf):
    raw = spark.read.parquet(f"{sf}/conversations.parquet")
    folder = scratch_folder(spark, "conversations")
    raw.repartition(3).write.parquet(folder)
    corpus = I.corpus(spark, sf)

    def search(q, k):
        return retrieval.keyword_search(corpus, q, k)

    from checks.registry import user_messages

    stream = user_messages(channels.read_events(spark, folder, raw.schema, files_per_batch=1))
    told, pages = stream_answering.answer_stream(stream, corpus, search, Settings(num_chunks=3))
    asked = user_messages(raw).filter("bot_id is null").select(F.col("event_id").alias("qid"), F.col("text").alias("question"))
    batch = answering.answer_bot(asked, corpus, search, Settings(num_chunks=3))
    want = {(r.qid, r.response) for r in batch.collect()}
    assert {(r.turn, r.content) for r in told.filter("role = 'assistant'").collect()} == want
    assert told.select("batch_id").distinct().count() == 3
    assert pages.select("response_id").distinct().count() == len(want)


def test_bot_answers_when_columns_or_texts_are_missing(spark):
    questions = spark.createDataFrame([(1, " TERM "), (2, "nothing like it")], "qid long, question string")
    corpus = spark.createDataFrame([(1, "term here. More."), (2, None)], "chunk_id long, chunk string")
    both = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, rank int, chunk_id long")
    rows = {r.qid: r for r in answering.answer_bot(questions, corpus, lambda q, k: both, Settings()).collect()}
    assert rows[1].question == "term"
    assert rows[1].context == (
        "Context document 1: term here. More. [URL: Unknown Source]\n\n"
        "Context document 2: Content not found - available keys: ['chunk'] [URL: Unknown Source]\n\n"
    )
    assert [tuple(c) for c in rows[1].citations] == [(1, "Unknown Title", "Unknown Source")]
    assert rows[2].context == "" and rows[2].citations == [] and rows[2].response == REFUSAL


def test_web_answers_without_url_column(spark, sf):
    corpus = I.corpus(spark, sf).drop("source_url")
    asked = I.web_questions(spark, sf)

    def search(q, k):
        return retrieval.keyword_search(corpus, q, k)

    answered = answering.answer_web(asked, I.messages(spark, sf), corpus, search, search, Settings(num_chunks=2))
    assert answered.filter("context like '%[URL: #]%'").count() == asked.count()
    told = answering.web_transcript(asked, answered)
    assert told.count() == 2 * asked.count()
    raw = {(r.qid, r.question) for r in asked.collect()}
    assert {(r.conv_id, r.content) for r in told.filter("role = 'user'").collect()} == raw
