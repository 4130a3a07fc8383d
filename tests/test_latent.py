"""Learnt vectors against a plain decomposition, and what they are for."""

import random

import numpy as np
import pytest

from citeflow.operators import latent
from citeflow.operators.embedding import embed_text, fit_embedder

CONTEXT = {"motor": "engine wheel road driver garage", "fruit": "peel sweet tree basket juice", "sky": "cloud rain star moon wind"}
PAIRS = {"motor": ("car", "automobile"), "fruit": ("banana", "plantain"), "sky": ("heaven", "firmament")}


@pytest.fixture(scope="module")
def topics(spark):
    """Two words for each thing, never in one text, with the same company."""
    rng, rows = random.Random(2), []
    for i in range(240):
        topic = rng.choice(sorted(CONTEXT))
        words = [rng.choice(PAIRS[topic]), *rng.choices(CONTEXT[topic].split(), k=6)]
        rows.append((i, " ".join(words)))
    rows += [(900, ""), (901, None)]
    return spark.createDataFrame(rows, "chunk_id long, chunk string").repartition(3)


def cosine(model_rows, a, b):
    return float(np.dot(model_rows[a], model_rows[b]))


def test_words_in_the_same_company_come_near(spark, topics):
    model = latent.fit_latent(topics, rank=3)
    words = [w for pair in PAIRS.values() for w in pair]
    asked = spark.createDataFrame(list(enumerate(words)), "qid long, question string")
    learnt = {words[r["qid"]]: r["vector"] for r in latent.embed_latent(model, asked, "qid", "question").collect()}
    plain = {words[r["qid"]]: r["vector"] for r in embed_text(fit_embedder(topics), asked, "question").collect()}
    for topic, (a, b) in PAIRS.items():
        assert cosine(plain, a, b) == 0
        assert cosine(learnt, a, b) > 0.9
        for other in PAIRS:
            if other != topic:
                assert cosine(learnt, a, PAIRS[other][0]) < 0.5
    # a search finds texts that do not hold the asked word
    found = latent.latent_search(topics, asked.where("qid = 0"), 60, model).join(topics, "chunk_id").collect()
    assert any("automobile" in r["chunk"] for r in found) and all("cloud" not in r["chunk"] for r in found)


def test_directions_equal_a_plain_decomposition(spark, topics):
    words, rank = 256, 5
    model = latent.fit_latent(topics, words=words, rank=rank, passes=12)
    hashed = topics.select(latent._hashed(topics["chunk"], words).alias("w")).collect()
    counts = np.array([np.bincount(r["w"], minlength=words) if r["w"] else np.zeros(words) for r in hashed])
    df = (counts > 0).sum(axis=0)
    rows = counts * np.log((len(counts) + 1) / (df + 1))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norm > 0, norm, 1)
    _, values, axes = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(model.values, values[:rank], rtol=1e-3)
    assert np.allclose(model.directions.T @ model.directions, np.eye(rank), atol=1e-9)
    # the first three stand well apart from the rest, and span what the plain ones span
    shared = np.linalg.svd(axes[:3] @ model.directions[:, :3])[1]
    assert shared.min() > 0.999


def test_model_is_stored(spark, topics, tmp_path):
    model = latent.fit_latent(topics, words=128, rank=4)
    latent.write_latent(spark, model, str(tmp_path / "model"))
    again = latent.read_latent(spark, str(tmp_path / "model"))
    assert (again.directions == model.directions).all() and (again.idf == model.idf).all() and (again.values == model.values).all()
    rows = {r["chunk_id"]: np.array(r["vector"]) for r in latent.embed_latent(again, topics, "chunk_id", "chunk").collect()}
    assert not rows[900].any() and not rows[901].any()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for i, v in rows.items() if i < 900)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "chunk_id long, chunk string")
    model = latent.fit_latent(none, words=32, rank=4)
    assert len(model.values) == 0
    asked = spark.createDataFrame([(1, "a word")], "qid long, question string")
    assert latent.latent_search(none, asked, 3, model).count() == 0
