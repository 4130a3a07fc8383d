import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from citeflow.operators import best_matches, retrieval
from citeflow.operators import index as ix
from citeflow.operators.embedding import embed_text, fit_embedder, search, text_search
from tests.conftest import plan_of

WORDS = [f"t{i}" for i in range(40)]


def corpus_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=rng.randint(1, 30))
        rows.append((i, " ".join(words)))
    rows += [(n, ""), (n + 1, rows[0][1]), (n + 2, rows[0][1])]
    return rows


def bm25(rows, questions, k, k1=1.2, b=0.75):
    docs = {i: Counter(t.split()) for i, t in rows}
    size = {i: sum(c.values()) for i, c in docs.items()}
    mean = sum(size.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    hits = set()
    for qid, text in questions:
        scored = []
        for i, c in docs.items():
            terms = [t for t in set(text.split()) if t in c]
            if terms:
                total = sum(
                    round(
                        math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                        * (c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * size[i] / mean)))
                        * 1e9
                    )
                    for t in terms
                )
                scored.append((-total, i))
        for rank, (total, i) in enumerate(sorted(scored)[:k], 1):
            hits.add((qid, rank, Decimal(-total).scaleb(-9), i))
    return hits


QUESTIONS = [(1, "t0 t5 t39"), (2, "t1 t1 t2"), (3, "nowhere"), (4, ""), (5, " ".join(WORDS)), (6, "t38 nowhere")]


@pytest.fixture(scope="module")
def small(spark):
    rows = corpus_rows()
    corpus = spark.createDataFrame(rows, "chunk_id long, chunk string").repartition(3)
    questions = spark.createDataFrame(QUESTIONS, "qid long, question string")
    return rows, corpus, questions


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_keyword_is_brute_force(small):
    rows, corpus, questions = small
    for k in (1, 7, 1000):
        assert as_set(retrieval.keyword_search(corpus, questions, k)) == bm25(rows, QUESTIONS, k)


def test_keyword_in_many_blocks(small, monkeypatch):
    """Blocks of a few terms each go the way one block goes."""
    rows, corpus, questions = small
    monkeypatch.setattr(best_matches, "BLOCK_CELLS", 50)
    monkeypatch.setattr(best_matches, "PENDING_ROWS", 10)
    for entries in (1, 5, 10):
        found = retrieval.keyword_search(corpus, questions, 4, block_entries=entries)
        assert as_set(found) == bm25(rows, QUESTIONS, 4)


def test_keyword_over_stored_index(small, spark, tmp_path):
    rows, corpus, questions = small
    path = str(tmp_path / "index")
    ix.write_term_index(corpus, path, buckets=4)
    index = ix.read_term_index(spark, path)
    assert index.buckets == 4
    assert as_set(retrieval.keyword_search_indexed(index, questions, 6)) == bm25(rows, QUESTIONS, 6)


def test_keyword_without_questions_or_corpus(small, spark):
    _, corpus, questions = small
    assert retrieval.keyword_search(corpus, questions.filter("qid = 4"), 3).count() == 0
    assert retrieval.keyword_search(corpus, questions.filter("false"), 3).count() == 0
    assert retrieval.keyword_search(corpus.filter("false"), questions, 3).count() == 0


def test_matches_that_weigh_nothing_stay():
    # a term in every document of a huge corpus: its weight rounds to zero, the match still counts
    import pyarrow as pa

    run = best_matches.term_scorer(
        np.array([9]), np.array([0, 1]), np.array([0]), np.array([1e-12]), 1.0, 5, 1.2, 0.75
    )
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([1, 2], pa.int64()),
            pa.array([1, 1], pa.int32()),
            pa.array([[0], []], pa.list_(pa.int32())),
            pa.array([[1.0], []], pa.list_(pa.float64())),
        ],
        names=["chunk_id", "length", "term_ids", "term_counts"],
    )
    out = [b.to_pylist() for b in run(iter([batch]))]
    assert out == [[{"qid": 9, "chunk_id": 1, "score_units": 0}]]


def vectors(n, dim, seed):
    m = np.random.default_rng(seed).standard_normal((n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vector_frames(spark):
    docs, asked = vectors(400, 16, 1), vectors(23, 16, 2)
    docs[7] = docs[3]
    corpus = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(docs)] + [(999, None)], "chunk_id long, vector array<float>"
    )
    questions = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "qid long, vector array<float>"
    )
    scores = np.rint(docs.astype(np.float64) @ asked.astype(np.float64).T * 1e9)
    want = {
        (q, rank, int(scores[i, q]), int(i))
        for q in range(len(asked))
        for rank, i in enumerate(np.lexsort((np.arange(len(docs)), -scores[:, q]))[:6], 1)
    }
    return corpus.repartition(5), questions, want


def units(df):
    return {(r.qid, r["rank"], int(r.score.scaleb(9)), r.chunk_id) for r in df.collect()}


def test_semantic_is_brute_force(vector_frames, monkeypatch):
    corpus, questions, want = vector_frames
    assert units(retrieval.semantic_search(corpus, questions, 6)) == want
    monkeypatch.setattr(best_matches, "BLOCK_CELLS", 64)
    monkeypatch.setattr(best_matches, "PENDING_ROWS", 10)
    assert units(retrieval.semantic_search(corpus, questions, 6, block_entries=100)) == want


def test_ann_recall(vector_frames, spark):
    corpus, questions, want = vector_frames
    every = retrieval.semantic_search_ann(corpus, questions, 6, planes=4, probes=16)
    assert units(every) == want
    some = units(retrieval.semantic_search_ann(corpus, questions, 6, planes=4, probes=8))
    exact = {(q, i) for q, _, _, i in want}
    recall = len(exact & {(q, i) for q, _, _, i in some}) / len(exact)
    assert recall >= 0.8


def test_ann_recall_on_supplied_vectors(spark, sf):
    corpus, asked = I.stored_vectors(spark, sf), I.question_vectors(spark, sf)
    exact = {(r.qid, r.chunk_id) for r in retrieval.semantic_search(corpus, asked, 10).collect()}
    found = {(r.qid, r.chunk_id) for r in retrieval.semantic_search_ann(corpus, asked, 10).collect()}
    # these vectors have hardly any structure; 24 of 64 cells are looked at
    assert len(exact & found) / len(exact) >= 0.55


def test_search_by_strategy(small):
    _, corpus, questions = small
    assert as_set(search(None, corpus, questions, 2)) == as_set(text_search(corpus, questions, 2))
    assert as_set(search("keyword", corpus, questions, 2)) == as_set(retrieval.keyword_search(corpus, questions, 2))
    with pytest.raises(ValueError):
        search("psychic", corpus, questions, 2)


def test_postings_and_stats(small):
    rows, corpus, _ = small
    posted = ix.postings(corpus)
    want = {
        (i, len(t.split()), w, n) for i, t in rows for w, n in Counter(t.split()).items()
    }
    assert as_set(posted) == want
    stats = ix.corpus_stats(corpus).first()
    assert stats.n_docs == len(rows) and stats.total_length == sum(len(t.split()) for _, t in rows)
    df = {r.token: (r.df, r.cf) for r in ix.term_stats(posted).collect()}
    assert df["t0"] == (sum("t0" in t.split() for _, t in rows), sum(t.split().count("t0") for _, t in rows))


def test_postings_do_not_shuffle_or_tokenise_twice(spark, sf):
    stored = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk")
    )
    plan = plan_of(ix.postings(stored))
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "")], "chunk_id long, chunk string")
    rows = embed_text(fit_embedder(df, dimensions=64), df, "chunk").collect()
    norms = {r.chunk_id: float(np.linalg.norm(r.vector)) for r in rows}
    assert norms[1] == pytest.approx(1, abs=1e-5) and norms[2] == pytest.approx(1, abs=1e-5) and norms[3] == 0


def test_text_decides_what_is_found(spark):
    """Questions are searched by their texts: the same id with another text finds other chunks."""
    corpus = spark.createDataFrame(
        [(1, "rivers and bridges of the north"), (2, "bread and butter and salt"), (3, "")], "chunk_id long, chunk string"
    )
    def best(text):
        asked = spark.createDataFrame([(7, text)], "qid long, question string")
        return [r.chunk_id for r in text_search(corpus, asked, 1).collect()]

    assert (best("bridges over rivers"), best("salt on bread")) == ([1], [2])


# --- merging -------------------------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(
        [(q, r, None if s is None else Decimal(s), c, t) for q, r, s, c, t in rows],
        "qid long, rank int, score decimal(18,9), chunk_id long, chunk string",
    )


def merged(df):
    return [(r.chunk, r.chunk_id, None if r.score is None else float(r.score)) for r in df.orderBy("qid", "rank").collect()]


def test_first_seen(spark):
    sem = hits(spark, [(1, 1, "0.9", 10, "a"), (1, 2, "0.8", 11, "b"), (1, 3, "0.7", 12, "a")])
    kw = hits(spark, [(1, 1, "5", 20, "b"), (1, 2, "4", 21, "c"), (1, 3, "3", 22, "d")])
    out = retrieval.hybrid_first_seen(retrieval.legs(sem, kw), 3)
    assert [x[:2] for x in merged(out)] == [("a", 10), ("b", 11), ("c", 21)]
    assert [r["rank"] for r in out.orderBy("rank").collect()] == [1, 2, 3]
    # fewer texts than k
    assert retrieval.hybrid_first_seen(retrieval.legs(sem, kw), 9).count() == 4


@pytest.mark.parametrize(
    "keyword_score, winner",
    [("1.19", 10), ("1.2", 10), ("1.200000001", 20)],
)
def test_boosted_needs_strictly_more(spark, keyword_score, winner):
    sem, kw = hits(spark, [(1, 1, "1", 10, "a")]), hits(spark, [(1, 1, keyword_score, 20, "a")])
    out = merged(retrieval.hybrid_boosted(retrieval.legs(sem, kw), 5, normalize=None))
    assert [x[1] for x in out] == [winner]


def test_boosted_order_and_ties(spark):
    sem = hits(spark, [(1, 1, "1", 10, "a"), (1, 2, "0.5", 11, "b"), (1, 3, "0.9", 12, "b"), (1, 4, None, 13, "n")])
    kw = hits(
        spark,
        [(1, 1, "0.6", 20, "c"), (1, 2, "1.2", 21, "c"), (1, 3, "1.2", 22, "b"), (1, 4, "0.6", 23, "d"), (1, 5, "1.2", 24, "c")],
    )
    out = merged(retrieval.hybrid_boosted(retrieval.legs(sem, kw), 10, normalize=None))
    # a 1.2 (first place), b replaced by its keyword row but in b's place, c keeps its first place
    # with the earlier of its best rows, then d, and the row without a score counts nothing
    assert out == [("a", 10, 1.2), ("b", 22, 1.2), ("c", 21, 1.2), ("d", 23, 0.6), ("n", 13, 0.0)]
    top = merged(retrieval.hybrid_boosted(retrieval.legs(sem, kw), 2, normalize=None))
    assert top == out[:2]


def test_boosted_normalised(spark):
    sem = hits(spark, [(1, 1, "0.8", 10, "a"), (1, 2, "0.4", 11, "b")])
    kw = hits(spark, [(1, 1, "40", 20, "b"), (1, 2, "10", 21, "c")])
    out = merged(retrieval.hybrid_boosted(retrieval.legs(sem, kw), 5))
    assert out == [("a", 10, 1.2), ("b", 20, 1.0), ("c", 21, 0.25)]
    with pytest.raises(ValueError):
        retrieval.hybrid_boosted(retrieval.legs(sem, kw), 5, normalize="median")


def test_union_and_top_k(spark):
    sem = hits(spark, [(1, 1, "0.9", 10, "a"), (1, 2, "0.8", 11, "b")])
    kw = hits(spark, [(1, 1, "5", 20, "a"), (2, 1, "5", 21, "z")])
    out = retrieval.union_all_ranked(sem, kw).orderBy("qid", "rank").collect()
    assert [(r.qid, r["rank"], r.chunk_id, r.leg) for r in out] == [(1, 1, 10, 0), (1, 2, 11, 0), (1, 3, 20, 1), (2, 1, 21, 1)]
    top = retrieval.top_k_per_query(sem, 1, [F.col("score").desc()])
    assert "WindowGroupLimit" in plan_of(top) and top.first().chunk_id == 10
    assert "WindowGroupLimit" in plan_of(retrieval.dedupe_by_text(sem))


def test_projection_prunes_and_does_not_shuffle_the_corpus(spark, sf):
    hits_ = spark.createDataFrame([(1, 1, 3)], "qid long, rank int, chunk_id long")
    stored = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_url")
    )
    out = retrieval.search_projection(hits_, stored, ["source_url"])
    plan = plan_of(out)
    assert "BroadcastHashJoin" in plan and "text" not in plan.split("ReadSchema")[1]
    assert out.columns == ["qid", "rank", "chunk_id", "source_url"]


def test_projection_of_many_hits(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"c{i}") for i in range(50)], "chunk_id long, chunk string")
    many = spark.createDataFrame([(q, 1, (q * 7) % 20) for q in range(40)], "qid long, rank int, chunk_id long")
    want = {(q, 1, (q * 7) % 20, f"c{(q * 7) % 20}") for q in range(40)}
    for rows, ids in ((100, 100), (10, 100), (10, 5)):
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(retrieval, "BROADCAST_IDS", ids)
        assert as_set(retrieval.search_projection(many, corpus, ["chunk"])) == want
