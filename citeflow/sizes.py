"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a hinted broadcast side may hold. The sides hinted here are narrow (ids, ranks, short keys);
# at 200 bytes a row this bounds one broadcast at about 100 MB.
BROADCAST_ROWS = 500_000
# Bound for a broadcast of nothing but one whole-number id a row: about 160 MB.
BROADCAST_IDS = 10_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; otherwise return ``df`` unhinted, so that the
    join shuffles and adaptive execution splits skewed partitions."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out over the cores a table that is read in fewer tasks than there are cores.

    One small file often is one row group, which only one task can read. The plan's own number of tasks decides;
    nothing is read or counted for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
