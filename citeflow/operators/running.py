"""Running totals over groups of any size."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 10_000


def running_totals(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: str,
    sums: dict[str, Column],
    marks: dict[str, tuple[str, Column]] | None = None,
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add inclusive running sums per ``keys`` in order of ``(time, tie)``.

    ``marks`` maps a name to ``(sum, condition)``: the running sum's value at the latest row so far
    where the condition holds, or 0. Summed values must not be negative.

    A window by key alone would put a key with a third of all rows into one task. Large inputs are
    cut into time slices of about equal size. The row-level window runs per (key, slice); what came
    before a slice is found by a window over one row per (key, slice).
    """
    marks = marks or {}
    largest, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    n_slices = 1
    if largest and largest > rows_per_slice:
        n_slices = min(MAX_SLICES, math.ceil(rows / rows_per_slice))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (time, tie)]
    sliced = df.withColumn("_slice", F.lit(0))
    if n_slices > 1:
        micros = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
        placed = df.withColumn("_x", -micros if descending else micros)
        cuts = placed.approxQuantile("_x", [i / n_slices for i in range(1, n_slices)], 0.25 / n_slices)
        splits = [-math.inf, *sorted(set(cuts)), math.inf]
        found = Bucketizer(splits=splits, inputCol="_x", outputCol="_found").transform(placed)
        # rows without a time come where the order puts nulls: first, or last when descending
        timeless = F.lit(n_slices if descending else -1)
        sliced = found.withColumn("_slice", F.coalesce(F.col("_found").cast("int"), timeless))

    here = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = sliced.withColumns({f"_in_{c}": F.sum(e).over(here) for c, e in sums.items()}).withColumns(
        {f"_in_{m}": F.max(F.when(cond, F.col(f"_in_{c}"))).over(here) for m, (c, cond) in marks.items()}
    )
    if n_slices <= 1:
        return within.select(
            *df.columns,
            *[F.col(f"_in_{c}").alias(c) for c in sums],
            *[F.coalesce(F.col(f"_in_{m}"), F.lit(0)).alias(m) for m in marks],
        )

    # the windowed rows already lie by (key, slice), so this adds no shuffle of rows
    ends = within.groupBy(*keys, "_slice").agg(
        *[F.max(f"_in_{name}").alias(f"_end_{name}") for name in (*sums, *marks)]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumns(
        {f"_to_{c}": F.coalesce(F.sum(f"_end_{c}").over(before), F.lit(0)) for c in sums}
    ).withColumns(
        {
            f"_to_{m}": F.coalesce(F.max(F.col(f"_to_{c}") + F.col(f"_end_{m}")).over(before), F.lit(0))
            for m, (c, _) in marks.items()
        }
    )
    joined = within.join(
        offsets.select(*keys, "_slice", *[f"_to_{name}" for name in (*sums, *marks)]), [*keys, "_slice"]
    )
    return joined.select(
        *df.columns,
        *[(F.col(f"_to_{c}") + F.col(f"_in_{c}")).alias(c) for c in sums],
        *[
            F.coalesce(F.col(f"_to_{c}") + F.col(f"_in_{m}"), F.col(f"_to_{m}")).alias(m)
            for m, (c, _) in marks.items()
        ],
    )
