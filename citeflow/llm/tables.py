"""What the operators share: intermediate tables, row keys and the definition of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.session import scratch_folder

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
GAP = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables one job writes to the shared folder: they cut lineage, survive lost executors and are
    deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.paths = spark, purpose, {}

    def write(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` and read it back. Its shuffle files go right after the write, because later
        steps read the table and never the shuffle. ``codec`` is for tables of texts, which shrink well."""
        path = scratch_folder(self.spark, f"{self.purpose}-{name}")
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=codec)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step and no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def row_key(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits naming a row by its id and text. Rows equal in both share the key, which needs no
    numbering that a recomputed task could deal out differently."""
    fields = [F.col(id_col).isNull(), F.col(id_col), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*fields).alias("_ka"), F.xxhash64(F.lit("b"), *fields).alias("_kb")]
