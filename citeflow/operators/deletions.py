"""Applying deletion plans page by page, with a ledger of what was done.

A run asks only for messages that no earlier run has deleted, so one that broke off is simply started again. The ledger's
successes are the tombstones that readers leave out; its failures name the ends whose sessions still hold messages.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.session import delete_folder, scratch_folder, written

PAGES_A_WAVE = 100_000  # pages whose outcome is stored together; a broken run loses at most these
PAGE = ["channel", "end_event_id", "page_no"]
LEDGER = (
    "channel bigint, end_event_id bigint, event_id bigint, page_no int, credential string, deleted boolean, error string, "
    "wave int"
)

# Takes the rows of one page and says for each what went wrong, or None. Messages that are gone already count as deleted.
Delete = Callable[[pd.DataFrame], list]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Waves whose rows are complete."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/waves")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    waves = [f.getPath() for f in files.listStatus(folder) if f.isDirectory()]
    return [w.getName() for w in waves if files.exists(hadoop.Path(w, "_SUCCESS"))]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt: the rows of the plan with ``deleted``, ``error`` and ``wave``, which counts up over all runs."""
    folders = [f"{path}/waves/{name}" for name in _folders(spark, path)]
    if not folders:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", f"{path}/waves").parquet(*folders)


def tombstones(spark: SparkSession, path: str) -> DataFrame:
    """``(channel, event_id)`` of the messages that are gone."""
    return ledger(spark, path).where("deleted").select("channel", "event_id").distinct()


def live_messages(events: DataFrame, path: str) -> DataFrame:
    """Events without the messages that are gone."""
    return events.join(tombstones(events.sparkSession, path), ["channel", "event_id"], "left_anti")


def failed_ends(spark: SparkSession, path: str) -> DataFrame:
    """``event_id`` of the ends with a message that could not be deleted yet, as `sessions.end_session` takes them."""
    tried = ledger(spark, path).groupBy("channel", "end_event_id", "event_id").agg(F.bool_or("deleted").alias("gone"))
    return tried.where("NOT gone").select(F.col("end_event_id").alias("event_id")).distinct()


def apply_deletions(plan: DataFrame, path: str, delete: Delete, pages_a_wave: int = PAGES_A_WAVE) -> DataFrame:
    """Delete the messages of a plan ``(channel, end_event_id, event_id, page_no, credential)`` that are not gone yet.

    A page is one call of ``delete``, and all pages are independent: a channel with a third of all messages is many pages in
    many tasks. What a wave did is stored before the next begins. A page whose call raises has failed as a whole; the
    others go on. If a task is lost before its wave is stored, its pages are asked for again, so ``delete`` has to bear
    messages that are gone already. Returns the ledger.
    """
    spark = plan.sparkSession
    open_ = written(plan.join(tombstones(spark, path), ["channel", "event_id"], "left_anti").select(*PAGE, "event_id", "credential"), "open")
    pages = open_.select(*PAGE).distinct().count()
    waves = math.ceil(pages / pages_a_wave)
    begin = 1 + max((int(name.split("=")[1]) for name in _folders(spark, path)), default=-1)

    def outcomes(rows: pd.DataFrame) -> list:
        try:
            errors = list(delete(rows))
            if len(errors) != len(rows):
                raise ValueError(f"{len(errors)} outcomes for {len(rows)} messages")
        except Exception as broken:  # noqa: BLE001 - whatever the caller's function raises is the page's outcome
            errors = [f"{type(broken).__name__}: {broken}"] * len(rows)
        return errors

    def run(batches):
        # The last page of a batch may go on in the next one, so it waits for it.
        rest = None
        for batch in itertools.chain(batches, [None]):
            parts = [b for b in (rest, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            rows, rest = pa.Table.from_batches(parts).combine_chunks(), None
            cuts = _page_starts(rows)
            if batch is not None:
                rest = rows.slice(cuts[-1]).to_batches()[0]
                rows = rows.slice(0, cuts[-1])
            if not rows.num_rows:
                continue
            cuts = [c for c in cuts if c < rows.num_rows] + [rows.num_rows]
            # A null would turn the whole numbers of its column into fractions, so such rows are converted by page.
            frame = None if any(c.null_count for c in rows.columns[:4]) else rows.to_pandas()
            errors = []
            for a, z in itertools.pairwise(cuts):
                errors += outcomes(rows.slice(a, z - a).to_pandas() if frame is None else frame.iloc[a:z])
            told = {"deleted": pa.array([e is None for e in errors]), "error": pa.array(errors, pa.string())}
            done = pa.table({c: rows[c] for c in rows.column_names} | told)
            yield from done.select([c.split()[0] for c in columns.split(", ")]).to_batches()

    columns = LEDGER.removesuffix(", wave int")
    laid = _by_wave(open_, waves)
    for i in range(waves):
        part = laid.where(F.col("_wave") == i).drop("_wave").repartition(F.xxhash64(*PAGE))
        # a page is a run of rows, with a fixed number of messages at most
        pages = part.sortWithinPartitions(*PAGE, F.asc_nulls_last("event_id"))
        pages.mapInArrow(run, columns).write.mode("overwrite").parquet(f"{path}/waves/wave={begin + i}")
    return ledger(spark, path)


def _by_wave(open_: DataFrame, waves: int) -> DataFrame:
    """Rows with ``_wave``, laid out by it, so that a wave reads its own rows only, however many waves there are."""
    if waves < 2:
        return open_.withColumn("_wave", F.lit(0))
    numbered = open_.withColumn("_wave", F.pmod(F.hash(*PAGE), F.lit(waves)))
    path = scratch_folder(open_.sparkSession, "waves")
    numbered.repartition("_wave").write.partitionBy("_wave").parquet(path)
    return open_.sparkSession.read.schema(numbered.schema).parquet(path)


def _page_starts(rows: pa.Table) -> list[int]:
    """Where pages begin in rows that lie page by page."""
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for name in PAGE:
        column = rows[name]
        change[1:] |= np.diff(column.fill_null(0).to_numpy()) != 0
        change[1:] |= np.diff(column.is_null().to_numpy().astype(np.int8)) != 0
    return np.flatnonzero(change).tolist()


def compact(spark: SparkSession, path: str) -> None:
    """One wave in place of all: each message once, with its success or else its latest failure. The new wave is complete
    before old ones go, and until then readers see rows twice, which changes no result."""
    old = _folders(spark, path)
    if len(old) < 2:
        return
    rank = F.struct("deleted", "wave")
    best = ledger(spark, path).groupBy("channel", "end_event_id", "event_id").agg(
        F.max_by(F.struct("page_no", "credential", "deleted", "error"), rank).alias("_b")
    )
    target = max(int(name.split("=")[1]) for name in old) + 1
    best.select("channel", "end_event_id", "event_id", "_b.*").write.mode("overwrite").parquet(f"{path}/waves/wave={target}")
    for name in old:
        delete_folder(spark, f"{path}/waves/{name}")
