"""What grows with the square of a cluster or the size of a batch, and what must not."""

import random

import numpy as np
from pyspark.sql import functions as F

from citeflow.llm import line_dedup, masked_lm
from tests.llm import plain


def test_cluster_in_pieces_is_joined_by_hubs(spark, monkeypatch):
    """Variants of one line, many of them unlike each other, leave few pairs to compare; and all links are found."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9)))
    base, lines = [word() for _ in range(80)], []
    for _ in range(400):
        own = list(base)
        for at in draw.sample(range(80), draw.randint(0, 4)):
            own[at] = word()
        lines.append(" ".join(own))
    rows = list(enumerate(lines))
    made, compared = line_dedup._prefix_pairs, []

    def kept(crowd, scratch):
        compared.append(made(crowd, scratch))
        return compared[-1]

    monkeypatch.setattr(line_dedup, "_prefix_pairs", kept)
    monkeypatch.setattr(line_dedup.Scratch, "drop", lambda self, *names: None)
    got = {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain.deduped_lines(rows)
    assert sum(bool(t) for t in want.values()) < 20
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert sum(df.count() for df in compared) <= 50 * len(rows)


def test_lines_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """Lines that share a passage meet in many buckets, but are too unlike to be laid out by shingles or compared."""
    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, own = word(80), [word(100) for _ in range(800)]
    lines = [passage + w for w in own] + [passage + w[:-3] + word(3) for w in own[:40]]
    laid, compared = [], []
    ranked, similar = line_dedup._ranked, line_dedup._similar
    monkeypatch.setattr(line_dedup, "_ranked", lambda crowd, scratch: laid.append(crowd.count()) or ranked(crowd, scratch))
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, lines: compared.append(pairs.count()) or similar(pairs, lines))
    rows = list(enumerate(lines))
    got = {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.deduped_lines(rows)
    assert sum(not t for t in got.values()) == 40
    assert sum(laid) <= len(lines) / 10 and sum(compared) <= 2 * len(lines)


def test_sketches_tell_like_lines_from_unlike_ones(spark):
    """Pairs at the limit agree in half of the values; the count is the one of the values themselves."""
    draw, n = random.Random(12), 2000
    word = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    lines = [common + word(8) for _ in range(n) for common in [word(72)] for _ in range(2)]
    signed = line_dedup._signatures(spark.createDataFrame(list(enumerate(lines)), "id long, norm string"))
    values = [f"m{i}" for i in range(line_dedup.BANDS * line_dedup.ROWS)]
    held = signed.select("id", line_dedup._bands().alias("keys"), *line_dedup._sketch(), *values).localCheckpoint()
    at = {r["id"]: r for r in held.collect()}
    pairs = held.alias("x").join(held.alias("y"), F.expr("y.id = x.id + 1 OR y.id = x.id + 2 AND x.id % 2 = 0"))
    for r in pairs.select("x.id", "y.id", line_dedup._agreeing("x", "y")).toDF("a", "b", "n").collect():
        same = sum(at[r["a"]][v] == at[r["b"]][v] for v in values)
        assert same <= r["n"] <= same + 4
        if r["a"] // 2 == r["b"] // 2 and set(at[r["a"]]["keys"]) & set(at[r["b"]]["keys"]):
            assert r["n"] >= line_dedup.AGREE
        elif r["a"] // 2 != r["b"] // 2:
            assert r["n"] < line_dedup.AGREE


def test_masked_lm_lays_out_a_bounded_number_of_words(monkeypatch):
    """However long a batch and its texts are; and sums are those of the whole texts."""
    draw = np.random.default_rng(4)
    monkeypatch.setattr(masked_lm, "SLICE", 64)
    lengths = [0, 1, 3, 500, 64, 0, 63, 65, 129] + [9] * 100
    texts = [masked_lm.padded(draw.integers(0, 32, n).astype(np.uint16), 32) for n in lengths]
    size = sum(int(np.prod(s)) for s in masked_lm.Network.shapes(32).values())
    net = masked_lm.Network.of(draw.normal(0, 0.3, size), 32)
    whole, laid = masked_lm.windows, []
    around, of, owner = whole(texts)
    chances = np.bincount(owner, net.log_chances(around, of), len(texts))
    steps = [net.gradient(*whole(texts, step)[:2]) for step in range(masked_lm.STEPS)]
    met = np.zeros((4, 33, 32))
    np.add.at(met, (np.arange(4)[None, :], around, of[:, None]), 1)

    def seen(part, step=None):
        laid.append(sum(len(t) // 2 - masked_lm.PLACES for t in part))
        return whole(part, step)

    monkeypatch.setattr(masked_lm, "windows", seen)
    assert np.array_equal(sum(masked_lm._met(texts, 32)).reshape(met.shape), met)
    assert np.allclose(masked_lm.class_sums(texts, net), chances, atol=1e-3)
    for step, want in enumerate(steps):
        found = sum(masked_lm._gradients(texts, net, step)) / masked_lm.UNIT
        assert np.allclose(found[:-1], want, atol=1e-3)
        assert found[-1] == len(whole(texts, step)[1])
    assert max(laid) < 2 * masked_lm.SLICE
