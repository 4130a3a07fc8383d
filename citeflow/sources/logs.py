"""Logs held as text: split to numbered lines and take the tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions.text import lines
from citeflow.settings import LOG_TAIL_ROWS


def log_lines(logs: DataFrame, text: str) -> DataFrame:
    """``(…, index, value)`` per line that is not blank after trimming spaces; index starts at 1.

    The outer generator spares a filter on the split text, which would split every log twice.
    """
    kept = [c for c in logs.columns if c != text]
    return (
        logs.select(*kept, F.posexplode_outer(lines(F.col(text))).alias("_pos", "value"))
        .filter(F.trim("value") != "")
        .select(*kept, (F.col("_pos") + 1).alias("index"), "value")
    )


def log_tail(logs: DataFrame, text: str, limit: int = LOG_TAIL_ROWS) -> DataFrame:
    """Last ``limit`` non-blank lines of each log, newest first.

    A log is one row, so its tail is cut inside the row: no shuffle and no window.
    """
    kept = [c for c in logs.columns if c != text]
    numbered = F.transform(
        lines(F.col(text)), lambda v, i: F.struct((i + 1).alias("index"), v.alias("value"))
    )
    filled = logs.select(
        *kept, F.reverse(F.filter(numbered, lambda e: F.trim(e["value"]) != "")).alias("_lines")
    )
    tail = F.slice("_lines", 1, limit)
    return filled.select(*kept, F.inline_outer(tail)).filter(F.col("index").isNotNull())


def last_lines(
    log: DataFrame, order: list[str], limit: int = LOG_TAIL_ROWS, by: list[str] | None = None
) -> DataFrame:
    """Newest ``limit`` rows of a log that spans many rows, overall or per source.

    Overall this is a top-k over partitions. Per source, the rank limit sits right above the window,
    so each task keeps at most ``limit`` rows of a source before the shuffle, however hot it is.
    """
    newest = [F.col(c).desc() for c in order]
    if not by:
        return log.orderBy(*newest).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    return log.withColumn("tail_rank", rank).filter(F.col("tail_rank") <= limit)
