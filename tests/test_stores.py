"""The stored term index and the chunk store: what they read, and that results are those of a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.operators import index as ix
from citeflow.operators import retrieval
from citeflow.sources.chunk_store import read_chunk_store, write_chunk_store


def as_set(df):
    return {tuple(r) for r in df.collect()}


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def texts(spark):
    """Words of very uneven frequency; a rare word in few ranges, a common one in all."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(3, 40)) if x < 200] + ["all"]
        if i in (17, 18, 444):
            words += ["needle"] * (i % 5 + 1)
        rows.append((i * 3, " ".join(words)))
    rows += [(5000, None), (5001, "")]
    corpus = spark.createDataFrame(rows, "chunk_id long, chunk string").repartition(4)
    asked = spark.createDataFrame(
        [(1, "needle"), (2, "needle all w1"), (3, "w3 w9 w50"), (4, "nothing here"), (5, ""), (6, "all"), (7, None)],
        "qid long, question string",
    )
    return corpus, asked


@pytest.fixture(scope="module")
def stored(texts, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ix.write_term_index(texts[0], path, buckets=8, width=64)
    return path


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_block_index_equals_scan(texts, stored, spark, k):
    corpus, asked = texts
    want = as_set(retrieval.keyword_search(corpus, asked, k))
    index = ix.read_term_index(spark, stored)
    assert as_set(retrieval.keyword_search_indexed(index, asked, k)) == want
    assert as_set(retrieval.keyword_search_indexed(index, asked, k, block_entries=2)) == want


def test_segments_are_appended_and_merged(texts, spark, tmp_path):
    corpus, asked = texts
    want = as_set(retrieval.keyword_search(corpus, asked, 5))
    path = str(tmp_path / "index")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(3))
    ix.write_term_index(corpus.where(part == 0), path, buckets=4, width=128)
    ix.append_term_index(corpus.where(part == 1), path)
    ix.append_term_index(corpus.where(part == 2), path)
    index = ix.read_term_index(spark, path)
    assert index.segments == (0, 1, 2) and index.size()[0] == corpus.count()
    assert as_set(retrieval.keyword_search_indexed(index, asked, 5)) == want
    ix.merge_term_index(spark, path)
    merged = ix.read_term_index(spark, path)
    assert merged.segments == (3,) and merged.size() == index.size()
    # a reader of the old list is not disturbed until old segments are dropped
    assert as_set(retrieval.keyword_search_indexed(index, asked, 5)) == want
    ix.drop_old_segments(spark, path)
    assert as_set(retrieval.keyword_search_indexed(merged, asked, 5)) == want
    one = merged.blocks(["all"]).groupBy("range").count()
    assert one.where("count > 1").isEmpty()
    ix.write_term_index(corpus.limit(0), path, buckets=4)
    assert retrieval.keyword_search_indexed(ix.read_term_index(spark, path), asked, 5).count() == 0


def test_asked_tokens_are_pushed_to_the_scan(stored, spark):
    index = ix.read_term_index(spark, stored)
    plan = plan_of(index.blocks(["needle", "all", "w1", "w2"]))
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    asked = {ix.zlib.crc32(t.encode()) % 8 for t in ("needle", "all", "w1", "w2")}
    listed = filters.split("IN (")[1].split(")")[0].split(",")
    assert {int(b) for b in listed} == asked and 1 < len(asked) < 8
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(token" in pushed and "LessThanOrEqual(token" in pushed
    # deciding on blocks reads no postings
    schema = [line for line in plan_of(index.blocks(["all"]).groupBy("term").agg(F.sum("n"))).splitlines() if "ReadSchema" in line]
    assert all("chunk_ids" not in line for line in schema)


def test_ranges_out_of_reach_are_skipped(texts, stored, spark):
    corpus, asked = texts
    index = ix.read_term_index(spark, stored)
    rare = asked.where("qid = 2")
    block, _ = retrieval._asked_tokens(rare, 100)
    qids, offsets, terms, vocabulary = retrieval._question_terms(block)
    n, total = index.size()
    weights = retrieval._idf(index.frequencies(vocabulary), n)
    state = (qids, offsets, terms, weights, total / n, 2, retrieval.K1, retrieval.B)
    floor, ranges = index.open_ranges(*state, vocabulary, retrieval._ranked)
    assert np.isfinite(floor).all()
    every = index.blocks(vocabulary)
    left = every.join(ranges, "range", "left_semi")
    assert left.count() * 4 < every.count()
    assert as_set(retrieval.keyword_search_indexed(index, rare, 2)) == as_set(retrieval.keyword_search(corpus, rare, 2))


def test_corpus_is_tokenised_once_for_all_blocks(texts, spark, monkeypatch):
    corpus, asked = texts
    made = []
    original = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, purpose: made.append(purpose) or original(df, purpose))
    assert as_set(retrieval.keyword_search(corpus, asked, 5, block_entries=1)) == as_set(retrieval.keyword_search(corpus, asked, 5))
    assert made == ["tokens"]


def test_only_ranges_that_were_hit_are_read(spark, tmp_path):
    rows = [(i * 7, f"text {i}", f"title {i}") for i in range(1000)] + [(None, "no id", "t")]
    corpus = spark.createDataFrame(rows, "chunk_id long, chunk string, document_title string").repartition(5)
    path = str(tmp_path / "store")
    write_chunk_store(corpus, path, rows_a_range=100)
    store = read_chunk_store(spark, path, corpus.schema)
    assert len(store.ranges) == 10 and store.columns == corpus.columns
    assert as_set(store.corpus()) == as_set(corpus.where("chunk_id is not null"))
    hits = spark.createDataFrame([(1, r, (200 + r) * 7) for r in range(10)] + [(2, 1, 1401)], "qid long, rank int, chunk_id long")
    assert store.hit_ranges(hits) == [2]
    files = store.read(store.hit_ranges(hits)).inputFiles()
    assert files and all("/range=2/" in f for f in files)
    got = retrieval.search_projection(hits, store, ["chunk"])
    assert as_set(got) == as_set(hits.join(corpus.select("chunk_id", "chunk"), "chunk_id").select("qid", "rank", "chunk_id", "chunk"))
    plan = plan_of(got)
    assert "document_title" not in [x for line in plan.splitlines() if "ReadSchema" in line for x in line.split(",")]
    none = spark.createDataFrame([(1, 1, 10**9), (1, 2, None)], "qid long, rank int, chunk_id long")
    assert store.project(none, ["chunk"]).count() == 0


def test_empty_store(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id long, chunk string")
    path = str(tmp_path / "store")
    write_chunk_store(empty, path)
    store = read_chunk_store(spark, path, empty.schema)
    hits = spark.createDataFrame([(1, 1, 5)], "qid long, rank int, chunk_id long")
    assert store.project(hits, ["chunk"]).count() == 0 == store.corpus().count()
