"""The newest messages of every conversation, kept up to date from batches of a transcript.

Conversations lie in folders by hash. A batch reads and writes only the folders its conversations fall into; of
each conversation as many messages stay as the longest history asks for, so the store does not grow with a transcript's
length and no search for a history reads the transcript.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.operators.history import history_window
from citeflow.session import delete_folder
from citeflow.settings import MESSAGE_RANGE

KEPT = MESSAGE_RANGE[1]  # messages of a conversation that stay
BUCKETS = 64
SCHEMA = "conv_id bigint, turn bigint, role string, content string"


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Finished versions of every folder, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for mark in files.globStatus(hadoop.Path(f"{path}/version=*/_SUCCESS")) or []:
        folder = mark.getPath().getParent()
        for part in files.listStatus(folder):
            name = part.getPath().getName()
            if name.startswith("bucket="):
                found.setdefault(int(name[7:]), []).append(int(folder.getName()[8:]))
    return {b: sorted(v) for b, v in found.items()}


def _newest(spark: SparkSession, path: str, buckets: list[int] | None, before: int | None = None) -> DataFrame:
    """The latest version of some folders, or of all."""
    folders = []
    for bucket, versions in sorted(_versions(spark, path).items()):
        versions = [v for v in versions if before is None or v < before]
        if versions and (buckets is None or bucket in buckets):
            folders.append(f"{path}/version={versions[-1]}/bucket={bucket}")
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def update_recent(messages: DataFrame, path: str, batch_id: int, kept: int = KEPT, buckets: int = BUCKETS) -> None:
    """Take in a batch ``(conv_id, turn, role, content)``. Batch ids rise; running one again replaces what it wrote, and a
    turn that comes twice counts once, as in its latest batch. Turns may arrive in any order."""
    spark = messages.sparkSession
    new = messages.select("conv_id", "turn", "role", "content")
    touched = [r[0] for r in new.select(bucket_of(buckets)).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    both = _newest(spark, path, touched, batch_id).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # ranks are limited right above the windows, so a conversation of any length is cut down inside the tasks
    same = Window.partitionBy("conv_id", "turn").orderBy(F.desc("_new"))
    once = both.withColumn("_place", F.row_number().over(same)).where(F.col("_place") == 1)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = once.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= kept)
    (
        last.select("conv_id", "turn", "role", "content", bucket_of(buckets).alias("bucket"))
        .repartition("bucket", F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(8)))
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
    )


def read_recent(spark: SparkSession, path: str, conversations: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(conv_id, turn, role, content)``: the stored messages, of ``conversations(conv_id)`` only if given; then only
    their folders are read."""
    if conversations is None:
        return _newest(spark, path, None)
    asked = conversations.select("conv_id").distinct()
    touched = [r[0] for r in asked.select(bucket_of(buckets)).distinct().collect()]
    return _newest(spark, path, touched).join(asked, "conv_id", "left_semi")


def recent_window(spark: SparkSession, path: str, n: int, conversations: DataFrame | None = None) -> DataFrame:
    """As `history.history_window` over the whole transcript, for ``n`` up to the number of messages that are kept."""
    return history_window(read_recent(spark, path, conversations), n)


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete versions of folders that a later batch has written again."""
    for bucket, versions in _versions(spark, path).items():
        for v in versions[:-1]:
            delete_folder(spark, f"{path}/version={v}/bucket={bucket}")
