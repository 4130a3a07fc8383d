"""Per-channel state of a stream in which one channel may hold most of the events.

State is a summary that can be put together from parts: entries since the latest reset, number of resets, whether
the channel is known. A micro-batch sums a hot channel slice by slice and adds what earlier batches left, so no task has a
channel to itself. What a batch writes lies under its id: a retry replaces it, and a table of past events can stand in
front of the first batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.operators.completion import is_answered
from citeflow.operators.history import question_normalize
from citeflow.operators.running import running_totals
from citeflow.operators.sessions import ENDED, clear_notice, is_accepted, is_reset, relevant_events

FULL_EVERY = 20  # batches after which the summary of all channels is written again
BOOTSTRAP = -1  # the batch id of a table of past events

ROWS = (
    "channel bigint, event_id bigint, kind string, known boolean, welcome boolean, epoch bigint, "
    "history_len bigint, notice string, batch_id bigint"
)
SUMMARY = "channel bigint, known boolean, epoch bigint, length bigint, batch_id bigint"
ENTRIES = "channel bigint, epoch bigint, ts timestamp, event_id bigint, question string, response string, batch_id bigint"


def apply_batch(events: DataFrame, path: str, batch_id: int, **slicing) -> None:
    """Bring the state under ``path`` forward by a batch of events, and store the rows they give."""
    spark = events.sparkSession
    message = F.when(is_accepted(), 1).otherwise(0)
    answered = is_accepted() & is_answered(F.col("response"))
    counted = running_totals(
        relevant_events(events),
        ["channel"],
        "ts",
        "event_id",
        {
            "_entries": F.when(answered, 2).otherwise(0),
            "_resets": F.when(is_reset(), 1).otherwise(0),
            "_messages": message,
        },
        {"_at_reset": ("_entries", is_reset())},
        **slicing,
    )
    before = summary(spark, path, batch_id).select(
        "channel", F.col("known").alias("_known"), F.col("epoch").alias("_epoch"), F.col("length").alias("_length")
    )
    # one row a channel on the right; adaptive execution splits a hot channel on the left
    placed = counted.join(before, "channel", "left")
    known = F.coalesce("_known", F.lit(False)) | (F.col("_messages") - message > 0)
    length = F.when(F.col("_resets") == 0, F.coalesce("_length", F.lit(0)) + F.col("_entries")).otherwise(
        F.col("_entries") - F.col("_at_reset")
    )
    told = placed.select(
        "channel", "event_id", "kind", known.alias("known"), ((message == 1) & ~known).alias("welcome"),
        (F.coalesce("_epoch", F.lit(0)) + F.col("_resets")).cast("bigint").alias("epoch"),
        length.cast("bigint").alias("history_len"),
        F.when(F.col("kind") == "end", F.lit(ENDED)).when(F.col("kind") == "clear", clear_notice(known)).alias("notice"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(answered, question_normalize(F.col("text"), "bot")).alias("question"),
        F.when(answered, F.col("response")).alias("response"),
    )
    told.write.mode("overwrite").parquet(f"{path}/told/batch_id={batch_id}")
    told = spark.read.schema(told.schema).parquet(f"{path}/told/batch_id={batch_id}")
    latest = F.max_by(F.struct("epoch", "history_len"), F.struct("ts", "event_id"))
    changed = told.groupBy("channel").agg(
        F.bool_or(F.col("known") | (F.col("kind") == "message")).alias("known"), latest.alias("_l")
    ).select("channel", "known", "_l.epoch", F.col("_l.history_len").alias("length"))
    if batch_id % FULL_EVERY == 0:
        others = summary(spark, path, batch_id).drop("batch_id").join(changed, "channel", "left_anti")
        changed = changed.unionByName(others)
    changed.write.mode("overwrite").parquet(f"{path}/summary/batch_id={batch_id}")


def summary(spark: SparkSession, path: str, before: int) -> DataFrame:
    """``(channel, known, epoch, length)`` of every channel as batches below ``before`` left it. Folders of batches
    from before the last full summary are not read."""
    oldest = (before - 1) // FULL_EVERY * FULL_EVERY
    folders = [f"{path}/summary/batch_id={b}" for b in range(max(oldest, BOOTSTRAP), before)]
    there = [f for f in folders if _exists(spark, f)]
    if not there:
        return spark.createDataFrame([], SUMMARY)
    parts = spark.read.schema(SUMMARY).option("basePath", f"{path}/summary").parquet(*there)
    latest = F.max_by(F.struct("known", "epoch", "length", "batch_id"), "batch_id").alias("_l")
    return parts.groupBy("channel").agg(latest).select("channel", "_l.*")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def bootstrap(events: DataFrame, path: str, **slicing) -> None:
    """Start the state under ``path`` from a table of past events, as if a stream had seen them."""
    apply_batch(events, path, BOOTSTRAP, **slicing)


def channel_state_split(events: DataFrame, path: str, **slicing) -> DataFrame:
    """State rows of a stream of events: those of `channels.channel_state_stream`, with ``batch_id``.

    Rows of one micro-batch are put in order of ``(ts, event_id)``; between micro-batches the order of
    arrival stands. Rows of a bootstrap have the batch id -1.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, path, batch_id, **slicing)

    query = (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return events.sparkSession.read.schema(ROWS).parquet(f"{path}/told")


def split_history(spark: SparkSession, path: str, **slicing) -> DataFrame:
    """``(channel, position, role, content)``: the history each channel holds after the batches under ``path``."""
    entries = spark.read.schema(ENTRIES).parquet(f"{path}/told").where("response is not null")
    last = max(int(f.rsplit("=", 1)[1]) for f in _folders(spark, f"{path}/summary"))
    now = summary(spark, path, last + 1).select("channel", "epoch")
    held = running_totals(
        entries.join(now, ["channel", "epoch"]), ["channel"], "ts", "event_id", {"_row": F.lit(1)}, **slicing
    )
    pair = F.array(
        F.struct(F.lit(0).alias("_i"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("_i"), F.lit("assistant").alias("role"), F.col("response").alias("content")),
    )
    each = held.select("channel", "_row", F.inline(pair))
    position = (2 * (F.col("_row") - 1) + F.col("_i")).cast("int").alias("position")
    return each.select("channel", position, "role", "content")


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
