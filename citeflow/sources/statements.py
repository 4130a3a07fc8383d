"""Statements that feed one another: pipes, listings, bound values, earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.session import written


def piped_query(df: DataFrame, label: str) -> DataFrame:
    """Feed a result into a second SELECT that puts a literal ``description`` before all columns."""
    return df.sparkSession.sql(
        "FROM {source} |> SELECT ? AS description, *", args=[label], source=df
    )


def like_filter_concat(df: DataFrame, column: str, prefix: str, lead: str, out: str) -> DataFrame:
    """Keep rows whose ``column`` starts with ``prefix`` and return ``lead`` joined to it.

    ``prefix`` is a LIKE pattern's fixed part; ``%`` and ``_`` in it keep their LIKE meaning. Spark
    turns a plain prefix into a pushed-down StartsWith.
    """
    return df.filter(F.col(column).like(prefix + "%")).select(
        F.concat(F.lit(lead), F.col(column)).alias(out)
    )


def remember_result(df: DataFrame, name: str = "last_result") -> DataFrame:
    """Keep the rows of a statement so that later ones query the rows, not the statement again."""
    kept = written(df, name)
    kept.createOrReplaceTempView(name)
    return kept


def result_scan(spark: SparkSession, name: str = "last_result") -> DataFrame:
    return spark.table(name)


def bound_query(spark: SparkSession, sql: str, values: list, **frames: DataFrame) -> DataFrame:
    """Run ``sql`` with positional ``?`` values bound, never spliced into the text; ``{name}`` marks
    refer to the given frames."""
    return spark.sql(sql, args=values, **frames)
