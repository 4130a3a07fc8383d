"""Vectors of texts, and the memory of scoring."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from citeflow.operators import best_matches, embedding
from tests.conftest import plan_of


def test_embedding_is_that_of_the_plain_rule(spark):
    """The vectors of the plain rule, from plans that hash no token in an interpreted expression."""
    texts = ["The cat, the CAT.", None, "", "a1 été b " * 50, "dog cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk string")
    model = embedding.fit_embedder(df, dimensions=16)
    made = embedding.embed_text(model, df, "chunk")
    assert "md5" not in plan_of(made) and made.columns == ["chunk_id", "chunk", "vector"]
    words = [(t or "").lower().replace(",", "").replace(".", "").split() for t in texts]
    dims = [[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16 for w in ws] for ws in words]
    counts = np.array([np.bincount(d, minlength=16) if d else np.zeros(16) for d in dims])
    plain = counts * np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    norm = np.linalg.norm(plain, axis=1, keepdims=True)
    plain = plain / np.where(norm > 0, norm, 1)
    for r in made.collect():
        assert r["vector"] == pytest.approx(plain[r["chunk_id"]], abs=1e-12)


def test_scoring_holds_small_blocks():
    """A task's memory while scoring does not grow with the rows of a batch."""
    import tracemalloc

    n, dim = 20_000, 64
    values = pa.array(np.random.default_rng(1).standard_normal(n * dim))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), values)], names=["chunk_id", "vector"]
    )
    asked = np.random.default_rng(2).standard_normal((1024, dim))
    scorer = best_matches.vector_scorer(np.arange(1024), asked, 3)
    tracemalloc.start()
    rows = sum(b.num_rows for b in scorer(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3 * 1024 and peak < 60e6
