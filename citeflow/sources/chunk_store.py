"""A corpus stored by ranges of ``chunk_id``, so that the few chunks of a search are read without a scan.

Every range is a folder, and a manifest lists them. Which range an id lies in is arithmetic, so hits name their
ranges without a look at any chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_RANGE = 50_000
ROWS_A_FILE = 500_000  # ids may lie unevenly; a crowded range is several files


@dataclass(frozen=True)
class ChunkStore:
    """Stored chunks; takes the place of a corpus wherever hits are projected."""

    spark: SparkSession
    path: str
    width: int
    schema: T.StructType
    ranges: frozenset[int]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.schema.names if c != "range"]

    def range_of(self, chunk_id="chunk_id"):
        return F.floor(F.col(chunk_id) / F.lit(self.width)).cast("bigint")

    def corpus(self) -> DataFrame:
        """All chunks."""
        return self.read(sorted(self.ranges)).drop("range")

    def read(self, ranges: list[int]) -> DataFrame:
        """The chunks of some ranges; other folders are neither listed nor opened."""
        folders = [f"{self.path}/chunks/range={r}" for r in ranges if r in self.ranges]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/chunks").parquet(*folders)

    def hit_ranges(self, hits: DataFrame) -> list[int]:
        """Ranges that hold a hit: at most as many numbers as there are ranges."""
        return sorted(r[0] for r in hits.select(self.range_of()).distinct().collect() if r[0] is not None)

    def project(self, hits: DataFrame, columns: list[str]) -> DataFrame:
        """Add ``columns`` to ranked hits: only ranges that were hit are read, and of these only ``columns``. The join is the
        same at any size; adaptive execution broadcasts a small side and splits a skewed one."""
        chunks = self.read(self.hit_ranges(hits)).select("chunk_id", *columns)
        return hits.join(chunks, "chunk_id").select(*hits.columns, *columns)


def write_chunk_store(corpus: DataFrame, path: str, rows_a_range: int = ROWS_A_RANGE) -> None:
    """Store ``corpus`` with its columns under ``path``. Chunks without an id cannot be hit and are left out."""
    held = corpus.where("chunk_id is not null")
    n, low, high = held.agg(F.count("*"), F.min("chunk_id"), F.max("chunk_id")).first()
    ranges = max(1, -(-n // rows_a_range))
    width = max(1, -(-(high - low + 1) // ranges)) if n else 1
    numbered = held.withColumn("range", F.floor(F.col("chunk_id") / F.lit(width)).cast("bigint"))
    (
        numbered.repartitionByRange(ranges, "range", "chunk_id").sortWithinPartitions("range", "chunk_id")
        .write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("range").parquet(f"{path}/chunks")
    )
    manifest = held.sparkSession.read.schema(numbered.schema).parquet(f"{path}/chunks").groupBy("range").agg(
        F.count("*").alias("rows"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")
    )
    manifest.withColumn("width", F.lit(width).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_chunk_store(spark: SparkSession, path: str, schema: T.StructType) -> ChunkStore:
    """The store under ``path`` with chunks of ``schema``. The manifest has a row a range."""
    rows = spark.read.schema("range bigint, rows bigint, low bigint, high bigint, width bigint").parquet(
        f"{path}/manifest"
    ).select("range", "width").collect()
    fields = T.StructType([f for f in schema.fields if f.name != "range"]).add("range", "long")
    return ChunkStore(spark, path, rows[0]["width"] if rows else 1, fields, frozenset(r["range"] for r in rows))
