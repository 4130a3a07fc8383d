"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeflow.llm import bpe, jaccard_join, line_dedup, masked_lm, mixing, quality, secrets, syncmers, token_counts
from citeflow.llm.components import components
from citeflow.llm.tables import Scratch


def rows_of(df):
    return df.collect()


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_mixing(odd, nothing):
    got = rows_of(mixing.with_copies(odd))
    assert len(got) == odd.count()
    assert all(r["copies"] == 1 for r in got if r["size"] == 0)
    assert {r["row"]["source"]: r["source_size"] for r in got}[None] == sum(r["size"] for r in got if r["row"]["source"] is None)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mixed_rows(nothing).count() == 0


def test_lines(odd, nothing):
    got = rows_of(line_dedup.dedup_lines(odd))
    assert len(got) == odd.count()
    for r in got:
        if r["row"]["text"] is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (None, 0, 0)
        if r["row"]["doc_id"] in (3, 4):
            assert r["text"] == r["row"]["text"]
    # Rows 1 and 6 hold the same line: the least id keeps it. Equal rows are one document.
    assert [r["text"] for r in got if r["row"]["doc_id"] == 6 and r["row"]["text"].startswith("The quick")] == ["", ""]
    assert line_dedup.deduplicated(odd).columns == odd.columns
    assert line_dedup.deduplicated(nothing).count() == 0


def test_secrets(odd, nothing):
    got = rows_of(secrets.scan(odd))
    assert len(got) == odd.count()
    eight = next(r["found"] for r in got if r["doc_id"] == 8)
    assert [(s["kind"], s["start"], s["end"]) for s in eight] == [(0, 0, 25), (1, 29, 49)]
    assert secrets.scan(nothing).count() == 0


def test_masked_lm(odd, nothing):
    got = rows_of(masked_lm.token_score(odd, masked_lm.fit(odd)))
    assert len(got) == odd.count()
    assert all((r["log_likelihood"], r["per_token"]) == (0.0, None) for r in got if r["n_tokens"] == 0)
    assert masked_lm.token_score(nothing, masked_lm.fit(nothing)).count() == 0


def test_quality(odd, nothing):
    got = rows_of(quality.verdicts(odd))
    assert len(got) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] == 0)
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(nothing).count() == 0 == quality.verdicts(nothing).count()


def test_fingerprints(odd, nothing, spark):
    got = rows_of(syncmers.fingerprints(odd))
    assert len(got) == odd.count()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    assert syncmers.fingerprints(nothing).count() == 0
    alone = rows_of(syncmers.fingerprints(odd.where("doc_id = 1")))[0]
    assert alone["near_next"] == 1.0
    same = rows_of(syncmers.fingerprints(spark.createDataFrame([(5, "x" * 50)] * 4, "doc_id long, text string")))
    assert [(r["near_edited"], r["near_next"]) for r in same] == [(1.0, 1.0)] * 4


def test_bpe_and_counts(odd, nothing):
    got = rows_of(bpe.encoded(odd))
    assert len(got) == odd.count() and all(not r["ids"] for r in got if not (r["text"] or "").strip())
    assert set(bpe.encoded(odd).columns) == set(odd.columns) | {"decoded"}
    assert bpe.encoded(nothing).count() == 0
    lengths = Counter((r["doc_id"], len(r["ids"])) for r in got)
    counted = rows_of(token_counts.token_counts(odd))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted) == lengths
    tables = rows_of(token_counts.prefix_counts(odd))
    assert Counter((r["doc_id"], r["counts"][-1] if r["counts"] else 0) for r in tables) == lengths
    cut = rows_of(token_counts.truncated(odd, 10))
    assert all(r["n_tokens"] <= 10 for r in cut)
    assert token_counts.token_counts(nothing).count() == 0


def test_jaccard(odd, nothing, spark):
    got = rows_of(jaccard_join.near_duplicates(odd))
    assert len(got) == odd.count()
    prose = [r["component_id"] for r in got if r["doc_id"] in (1, 6) and r["n_shingles"] > 10]
    assert prose == [1, 1, 1]
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sum(n for (_, t), n in texts(kept).items() if t and t.startswith("The quick")) == 1
    assert sum(n for (_, t), n in texts(kept).items() if not (t or "").strip()) == 4
    assert jaccard_join.keep_one(nothing).count() == 0
    copies = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(None, "")] * 2, "doc_id long, text string")
    assert texts(jaccard_join.keep_one(copies)) == Counter({(None, "a b c d e f"): 1, (None, ""): 2})


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(i, 1000) for i in range(500, 900)] + [(3, 3), (7, None), (1, 0)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 500 for i in range(500, 900)}, 1000: 500}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("table", ["odd", "nothing"])
def test_pipeline_stages(spark, sf, table, request):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
    assert stage(spark, docs, sf).count() >= 0
