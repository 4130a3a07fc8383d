"""Conversation history: window, cleaning, rendering, and the choice of search query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions.text import strip

# A citation mark, and the heading that starts the sources of an answer.
CITATION = r"\[\^[0-9]+\]"
SOURCES = "Sources:"


def history_window(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation without the newest, which is the question just
    asked: at most ``n - 1`` rows.

    The upper bound sits right above the window, so tasks keep only ``n`` rows of a conversation
    before the shuffle, however long it is.
    """
    newest_first = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (
        messages.withColumn("_age", F.row_number().over(newest_first))
        .filter(F.col("_age") <= n)
        .filter(F.col("_age") >= 2)
        .drop("_age")
    )


def strip_citations(content: Column) -> Column:
    """Drop citation marks, cut at the first sources heading, strip."""
    return strip(F.substring_index(F.regexp_replace(content, CITATION, ""), SOURCES, 1))


def histories(window: DataFrame) -> DataFrame:
    """One row per conversation: ``history``, its messages in order as ``{role, content}``.

    Takes the output of `history_window`, so an array holds at most ``n - 1`` messages.
    """
    row = F.struct("turn", "role", "content")
    grouped = window.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    slim = F.transform("_rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select("conv_id", slim.alias("history"))


def history_render(history: Column) -> Column:
    """``role: content`` lines with citations removed, in order."""
    line = F.transform(
        history,
        lambda m: F.concat(
            m["role"], F.lit(": "), strip_citations(F.coalesce(m["content"], F.lit("")))
        ),
    )
    return F.array_join(line, "\n")


def question_normalize(question: Column, surface: str) -> Column:
    """Bot: lower-case, then strip. Web: drop apostrophes."""
    if surface == "bot":
        return strip(F.lower(question))
    if surface == "web":
        return F.replace(question, F.lit("'"), F.lit(""))
    raise ValueError(f"unknown surface {surface!r}")


def with_history(questions: DataFrame, messages: DataFrame, n: int, use_history: bool) -> DataFrame:
    """Add ``history`` to each question (``qid`` is the conversation); null when history is off."""
    if not use_history:
        none = F.lit(None).cast("array<struct<role:string,content:string>>")
        return questions.withColumn("history", none)
    held = histories(history_window(messages, n)).withColumnRenamed("conv_id", "qid")
    empty = F.from_json(F.lit("[]"), "array<struct<role:string,content:string>>")
    return questions.join(held, "qid", "left").withColumn("history", F.coalesce("history", empty))


def query_route(routed: DataFrame, rewritten: Column) -> DataFrame:
    """Add ``search_query`` and ``chat_history``.

    History off: the raw question, and no history shown. On but empty: the raw question, and ``[]``
    shown. On and non-empty: the rewritten query, and the history shown as JSON.
    """
    has_history = F.coalesce(F.size("history") > 0, F.lit(False))
    return routed.withColumn(
        "search_query", F.when(has_history, rewritten).otherwise(F.col("question"))
    ).withColumn("chat_history", F.coalesce(F.to_json("history"), F.lit("")))
