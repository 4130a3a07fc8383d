"""Scoring by terms: frequent ones by matrix product, with the same sums."""

import numpy as np
import pytest

from citeflow.operators import best_matches
from citeflow.operators import index as ix
from tests.conftest import plan_of


@pytest.mark.parametrize("share", [0.0, 0.05, 2.0])
def test_frequent_terms_by_matrix_give_the_same_rows(monkeypatch, share):
    """Against a plain sum; a document may come twice, and a question may repeat a term."""
    monkeypatch.setattr(best_matches, "DENSE_SHARE", share)
    draw = np.random.default_rng(5)
    vocabulary, n, docs = 40, 60, 90
    asked = [np.sort(draw.choice(vocabulary, 6, p=np.arange(1, 41)[::-1] / 820)) for _ in range(n)]
    offsets, terms = np.arange(n + 1) * 6, np.concatenate(asked)
    df = draw.integers(1, docs, vocabulary)
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    lengths = draw.integers(5, 50, docs)
    entries = [(d, t, draw.integers(1, 5)) for d in range(docs) for t in draw.choice(vocabulary, 8)]
    doc, term, tf = (np.array(x) for x in zip(*entries, strict=True))
    state = (np.arange(n) + 100, offsets, terms, idf, 20.0, 5, 1.2, 0.75)
    scores = best_matches.TermScores(*state)
    assert (len(scores.asks) > 0) == (share < 1)
    for a in range(0, docs, 40):
        some = (doc >= a) & (doc < a + 40)
        scores.add(np.arange(a, min(a + 40, docs)), lengths[a : a + 40], doc[some] - a, term[some], tf[some].astype(float))
    found = {(q, d, s) for b in scores.rows() for q, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    plain = set()
    for i, ts in enumerate(asked):
        sums = {}
        for d, t, f in entries:
            norm = 1.2 * (0.25 + 0.75 * float(lengths[d]) / 20.0)
            weight = int(np.rint(idf[t] * (float(f) * 2.2 / (f + norm)) * best_matches.UNITS))
            if (times := int((ts == t).sum())):
                sums[d] = sums.get(d, 0) + times * weight
        plain |= {(i + 100, d, s) for d, s in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert found == plain


def test_many_asked_tokens_make_a_short_condition(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a b c"), (2, "b d")], "chunk_id long, chunk string")
    ix.write_term_index(corpus, str(tmp_path))
    index = ix.read_term_index(spark, str(tmp_path))
    many = index.blocks(["a", "b", *(f"w{i}" for i in range(500))])
    assert plan_of(many).count("token") < 60 and many.count() == 2
    assert list(index.frequencies(["a", "b", "zz"])) == [1, 2, 0]
