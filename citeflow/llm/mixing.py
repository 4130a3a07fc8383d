"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeflow.llm.tables import Scratch, row_key

WEIGHTS = (5, 2, 1)
MAX_RATE = 3  # copies of a document, and times its size that a source may be taken
SALTS = 64  # parts in which the documents of one source and size are ranked
STEPS, PRECISION = 80, 1e-9


def sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of ``docs`` (``_row``) with the words of their texts (null: 0), a key for the source (null is a
    source of its own) and the order in which equally long documents of a source are taken."""
    key = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("_row"), *row_key(), count.alias("_size"), key.alias("_source"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit("mix"), "_ka", "_kb"))
    return rows.withColumn("_salt", F.pmod(F.col("_order"), F.lit(SALTS)).cast("int"))


def targets(sources: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``_source, source_size, target`` from ``_source, source_size``: all words shared by weight, no source
    above `MAX_RATE` times its words, the excess shared again among the others.

    Weights follow the code point order of the sources, null last. Sources are ranked by ranges and by place
    in their range, so no task orders all of them. A water level replaces the repeated sharing: sources
    above it are full, and every round moves the level by two sums.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("_source") == "n", F.col("_source")]
    dealt = scratch.write(
        sources.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "sources"
    )
    # One row a range.
    before = dealt.groupBy("_part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.row_number().over(W.partitionBy("_part").orderBy(*by)) + F.col("before") - 1
    weight = F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights))).cast("int")]
    ranked = scratch.write(
        dealt.join(before, "_part").select("_source", "source_size", weight.alias("w")), "weights"
    )
    total, level = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while True:
        full = F.col("w") * F.lit(level) > MAX_RATE * F.col("source_size")
        sums = ranked.agg(
            F.coalesce(F.sum(F.when(full, MAX_RATE * F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)).alias("open"),
        ).first()
        after = (total - sums["full"]) / sums["open"] if sums["open"] else level
        if after <= level:
            break
        level = after
    return ranked.select(
        "_source", "source_size",
        F.least(F.lit(float(MAX_RATE)) * F.col("source_size"), F.col("w") * F.lit(level)).alias("target"),
    )


def _rate(tilt: Column, size: Column, scale: Column) -> Column:
    return F.least(F.lit(float(MAX_RATE)), F.exp(F.least(F.lit(50.0), tilt * size / scale)))


def rates(cells: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``_source, _size, n, rate`` for the documents of each source and size.

    Entropy balancing asks for the rates nearest to one, in relative entropy and with at most `MAX_RATE`
    each, that give every source its target of words. The solution tilts the rates exponentially,
    ``min(3, exp(tilt * size / mean size))``, and the tilts solve the convex dual. Its Hessian is diagonal as a
    document counts for one source, so each Newton step is one aggregation over ``cells`` (source, size and count, a
    fraction of the documents) for all sources at once. A step that leaves the bracket of the root is replaced
    by its middle.
    """
    scale = cells.groupBy("_source").agg((F.sum(F.col("n") * F.col("_size")) / F.sum("n")).alias("scale"))
    start = wanted.join(scale, "_source").select(
        "_source", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.col("source_size")
    )
    state = scratch.write(
        start.select(
            "_source", "target", "scale", F.lit(0.0).alias("tilt"), (F.col("scale") * -40.0).alias("low"),
            (F.col("scale") * math.log(MAX_RATE)).alias("high"),
            (F.col("source_size") == 0).alias("done"),
        ), "tilt0"
    )
    for step in range(1, STEPS + 1):
        at = cells.where("_size > 0").join(state.where("NOT done"), "_source")
        rate = _rate(F.col("tilt"), F.col("_size"), F.col("scale"))
        words = F.col("n") * F.col("_size") * rate
        slope = F.when(rate < MAX_RATE, words * F.col("_size") / F.col("scale")).otherwise(0.0)
        sums = at.groupBy("_source").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        gap = F.col("got") - F.col("target")
        # A target of all the source can give is reached at the upper end, where nothing changes any more.
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        near = F.abs(gap) <= F.col("target") * PRECISION
        moved = state.join(sums, "_source", "left").withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high)})
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step_to = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.select(
            "_source", "target", "scale", F.when(F.col("done") | near, F.col("tilt")).otherwise(step_to).alias("tilt"),
            "low", "high", (F.col("done") | F.coalesce(near, F.lit(False)) | (F.col("high") - F.col("low") < 1e-12)).alias("done"),
        )
        state = scratch.write(moved, f"tilt{step}")
        scratch.drop(f"tilt{step - 1}")
        if not state.where("NOT done").limit(1).count():
            break
    # Rounded, so that the order in which sums were made never shows in the copies.
    rate = F.round(_rate(F.col("tilt"), F.col("_size"), F.col("scale")), 9)
    return cells.join(state, "_source").select("_source", "_size", "n", rate.alias("rate"))


def _whole_copies(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one source's sizes, the longest first; what rounding leaves is made up by the shorter ones, so
    a size is rounded up or down as far as these can follow. A source has at most as many rows here as different
    sizes of documents."""
    group = group.sort_values("_size", ascending=False)
    words = (group["n"] * group["_size"]).to_numpy(float)
    planned = words * group["rate"].to_numpy(float)
    after = planned[::-1].cumsum()[::-1] - planned  # planned for the shorter ones
    room = MAX_RATE * (words[::-1].cumsum()[::-1] - words) - after
    carry, base, extra = 0.0, [], []
    for size, n, plan, give, take in zip(group["_size"], group["n"], planned, after, room, strict=True):
        if not size:
            base.append(1)
            extra.append(0)
            continue
        wanted = (plan + carry) / size
        least, most = math.ceil(wanted - take / size - 1e-9), math.floor(wanted + give / size + 1e-9)
        copies = min(MAX_RATE * n, max(0, most if most < least else min(most, max(least, math.floor(wanted + 0.5)))))
        carry += plan - copies * size
        base.append(copies // n)
        extra.append(copies % n)
    return group.assign(base=base, extra=extra)[["_source", "_size", "base", "extra"]]


def with_copies(docs: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, which keeps any names apart), ``size``, ``source_size``,
    ``target`` and ``copies`` (0 to 3) of every row.

    Defined cases: a null or blank text has size 0 and is taken once; it moves no target. A null source is a
    source, the last. Rows with one doc_id, and equal rows, are separate documents. With no words at all every target
    is 0. No rows give no rows. Extra columns are carried along. Reruns give the same copies.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = sizes(docs, source)
    parts = scratch.write(rows.groupBy("_source", "_size", "_salt").agg(F.count("*").alias("here")), "parts")
    cells = scratch.write(parts.groupBy("_source", "_size").agg(F.sum("here").alias("n")), "cells")
    total = cells.groupBy("_source").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    wanted = scratch.write(targets(total, scratch, weights), "targets")
    rated = scratch.write(rates(cells, wanted, scratch), "rates")
    whole = rated.groupBy("_source").applyInPandas(_whole_copies, "_source string, _size long, base int, extra long")
    before = F.sum("here").over(W.partitionBy("_source", "_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    plan = (
        parts.withColumn("before", F.coalesce(before, F.lit(0))).join(whole, ["_source", "_size"]).join(wanted, "_source")
        .select("_source", "_size", "_salt", "base", (F.col("extra") - F.col("before")).alias("left"), "source_size", "target")
    )
    plan = scratch.write(plan, "plan")
    scratch.drop("parts", "cells", "rates", "sources", "weights", "targets")
    place = F.row_number().over(W.partitionBy("_source", "_size", "_salt").orderBy("_order", "_ka", "_kb"))
    taken = rows.join(plan, ["_source", "_size", "_salt"]).withColumn("_place", place)
    copies = F.col("base") + (F.col("_place") <= F.col("left")).cast("int")
    return taken.select(F.col("_row").alias("row"), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    taken = with_copies(docs).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return with_copies(docs).select("row.doc_id", "size", "source_size", "target", taken, "copies")
