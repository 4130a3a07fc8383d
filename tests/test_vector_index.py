"""The stored vector index against a scan: exact results, recall of the default, and what is read for it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from citeflow.operators import retrieval
from citeflow.operators import vector_index as vx


def as_set(df):
    return {tuple(r) for r in df.collect()}


def frame(spark, rows, name):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{name} long, vector array<float>")


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    """Twenty bundles of directions, one of them of a third of all rows, half of these exact copies."""
    rng = np.random.default_rng(5)
    heads = rng.standard_normal((20, 24))
    bundle = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 20, 1500))
    x = heads[bundle] + 0.35 * rng.standard_normal((1500, 24))
    copies = np.flatnonzero(bundle == 0)[::2]
    x[copies] = x[copies[0]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = heads[rng.integers(0, 20, 30)] + 0.35 * rng.standard_normal((30, 24))
    asked[0] = x[copies[0]]
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    vectors = frame(spark, [*((i * 2, v.tolist()) for i, v in enumerate(x)), (1, None), (None, x[0].tolist())], "chunk_id")
    questions = frame(spark, [*((i, v.tolist()) for i, v in enumerate(asked)), (77, None)], "qid")
    path = str(tmp_path_factory.mktemp("vectors"))
    vx.write_vector_index(vectors.repartition(4), path, cells=20)
    return vectors.where("chunk_id is not null"), questions, path


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_exact_search_equals_a_scan(clusters, spark, k):
    vectors, questions, path = clusters
    want = as_set(retrieval.semantic_search(vectors, questions, k))
    index = vx.read_vector_index(spark, path)
    for options in ({}, {"probes": 1}, {"block_entries": 200}):
        assert as_set(vx.search(index, questions, k, exact=True, **options)) == want


def test_default_finds_most_of_the_result_in_few_cells(clusters, spark):
    vectors, questions, path = clusters
    index = vx.read_vector_index(spark, path)
    assert index.probes <= 6
    exact = as_set(retrieval.semantic_search(vectors, questions, 10).select("qid", "chunk_id"))
    found = as_set(vx.search(index, questions, 10).select("qid", "chunk_id"))
    assert len(exact & found) / len(exact) >= 0.9


def test_recall_and_files_on_supplied_vectors(spark, sf, tmp_path, monkeypatch):
    """Question by question: at least nine tenths of the exact result, from under a third of the files."""
    vectors, questions = I.stored_vectors(spark, sf), I.question_vectors(spark, sf)
    path = str(tmp_path / "vectors")
    vx.write_vector_index(vectors, path)
    index = vx.read_vector_index(spark, path)
    files = sum(n.endswith(".parquet") for table in ("codes", "vectors") for _, _, names in os.walk(f"{path}/{table}") for n in names)
    exact = {}
    for q, c in as_set(retrieval.semantic_search(vectors, questions, 10).select("qid", "chunk_id")):
        exact.setdefault(q, set()).add(c)
    read = []
    original = vx.VectorIndex._read
    monkeypatch.setattr(
        vx.VectorIndex, "_read", lambda *a: [df := original(*a), read.append(len(df.inputFiles()) if a[-1] else 0)][0]
    )
    for q in sorted(exact)[:4]:
        read.clear()
        found = {r["chunk_id"] for r in vx.search(index, questions.where(F.col("qid") == q), 10).collect()}
        assert len(found & exact[q]) >= 9
        assert 3 * sum(read) < files, (read, files)


def test_codes_bound_the_scores(clusters, spark):
    vectors, questions, path = clusters
    index = vx.read_vector_index(spark, path)
    rows = questions.where("vector is not null").limit(5).collect()
    qids, matrix = np.array([r["qid"] for r in rows]), np.array([r["vector"] for r in rows], float)
    every = np.ones((5, len(index.centroids)), bool)
    found = vx._candidates(index, qids, matrix, every, 50).collect()
    held = {r["chunk_id"]: np.array(r["vector"], float) for r in vectors.where("vector is not null").collect()}
    place = {q: i for i, q in enumerate(qids)}
    assert len(found) < 5 * 300
    for r in found:
        score = matrix[place[r["qid"]]] @ held[r["chunk_id"]] * 1e9
        assert r["low"] <= score <= r["high"] and r["high"] - r["low"] < 5e7


def test_no_vectors_and_no_questions(spark, tmp_path):
    none = frame(spark, [], "chunk_id")
    path = str(tmp_path / "none")
    vx.write_vector_index(none, path)
    index = vx.read_vector_index(spark, path)
    assert vx.search(index, frame(spark, [], "qid"), 3, exact=True).count() == 0
    one = frame(spark, [(5, [1.0, 0.0])], "chunk_id")
    vx.write_vector_index(one, path)
    asked = frame(spark, [(1, [0.0, 1.0])], "qid")
    assert [(r["qid"], r["chunk_id"]) for r in vx.search(vx.read_vector_index(spark, path), asked, 3).collect()] == [(1, 5)]
