"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "citeflow") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OPEN: list[list[str]] = []


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may use a machine-local folder: on a cluster every executor has to see what is
    written here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not local and (not root or root.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = root or tempfile.mkdtemp(prefix="citeflow-")
    path = f"{root.rstrip('/')}/citeflow/{purpose}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the scratch folders made inside when the block ends, for work whose result lies elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_folder(spark, path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back: later steps reuse the rows, and a
    lost executor costs a re-read, not the whole lineage."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
