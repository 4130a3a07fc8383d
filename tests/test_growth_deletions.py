"""Deletions whose price does not grow faster than the number of messages."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeflow.operators import deletions
from tests.conftest import plan_of

PLAN = "channel bigint, end_event_id bigint, event_id bigint, page_no int, credential string"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_are_whole_whatever_batches_they_come_in(spark, small_batches, tmp_path):
    rows = [(c, c * 100 + e, c * 1000 + e * 50 + i, p, "bot") for c in range(6) for e in range(3) for p in range(2)
            for i in range(p * 20, p * 20 + 3 + (c * 5 + e) % 16)]
    rows += [(None, 1, 2**60 + 1, 0, None), (None, 1, 2**60 + 2, 0, None), (7, None, 2**60 + 3, 0, None)]
    folder = tmp_path / "calls"
    folder.mkdir()

    def delete(page):
        keys = [None if v != v or v is None else int(v) for v in (page[c].iloc[0] for c in deletions.PAGE)]
        (folder / uuid.uuid4().hex).write_text(repr((*keys, [int(i) for i in page["event_id"]])))
        return [None] * len(page)

    done = deletions.apply_deletions(spark.createDataFrame(rows, PLAN), str(tmp_path / "ledger"), delete, pages_a_wave=5)
    assert Counter((r["channel"], r["end_event_id"], r["event_id"], r["page_no"], r["credential"]) for r in done.collect()) == Counter(rows)
    assert done.where("deleted AND error IS NULL").count() == len(rows)
    pages = {}
    for c, e, i, p, _ in rows:
        pages.setdefault((c, e, p), []).append(i)
    assert sorted(f.read_text() for f in folder.iterdir()) == sorted(repr((*k, sorted(v))) for k, v in pages.items())


def test_a_wave_reads_its_own_rows(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("channel"), F.col("id").alias("end_event_id"), F.col("id").alias("event_id"),
        F.lit(0).alias("page_no"), F.lit("bot").alias("credential"),
    )
    laid = deletions._by_wave(rows, 10)
    assert laid.count() == 2000 and laid.select("_wave").distinct().count() == 10
    assert "PartitionFilters: [isnotnull(_wave" in plan_of(laid.where("_wave = 3"))
