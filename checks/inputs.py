"""How the supplied tables become the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.sizes import spread

# Tables of long texts, with the key they are dealt out by when they lie in one small file.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("chunk"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("document_title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang").alias("source_url"),
    )


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )


def stored_vectors(spark, sf) -> DataFrame:
    """Every row of the table of stored vectors is a chunk."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )


def question_vectors(spark, sf) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")
    )
    return asked.join(vectors, "qid")


def messages(spark, sf) -> DataFrame:
    """Conversation rows without the ``system`` role, which has no counterpart here."""
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") != "system")
        .select("conv_id", "turn", "role", F.col("text").alias("content"))
    )


def web_questions(spark, sf) -> DataFrame:
    """The newest message of each conversation is its current question."""
    newest = messages(spark, sf).groupBy("conv_id").agg(
        F.max_by("content", "turn").alias("question"), F.max("turn").alias("turn")
    )
    return newest.select(F.col("conv_id").alias("qid"), "question", "turn")


def channel_events(spark, sf) -> DataFrame:
    return as_channel_events(table(spark, sf, "events"))


def as_channel_events(events: DataFrame) -> DataFrame:
    """The events table read as chat events; also applied to a stream of it."""
    kind = (
        F.when(F.col("event_type") == "purchase", "clear")
        .when(F.col("event_type") == "signup", "end")
        .otherwise("message")
    )
    is_bot = F.col("event_type") == "error"
    text = F.when(is_bot | (F.col("value") >= 1), F.col("props"))
    return events.select(
        F.col("user_id").alias("channel"),
        "event_id",
        "ts",
        kind.alias("kind"),
        F.when(kind == "message", text).alias("text"),
        F.when(is_bot, F.lit("b1")).alias("bot_id"),
        F.when(F.col("value") >= 2, F.concat(F.lit("re: "), "props")).alias("response"),
    )


def join_events(spark, sf) -> DataFrame:
    return as_join_events(table(spark, sf, "events"))


def as_join_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("channel"),
        "event_id",
        (F.col("user_id") % 7).cast("string").alias("user"),
    )


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


def logs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


LONG_PARAGRAPHS = 120


def responses(spark, sf) -> DataFrame:
    """One marked-up answer per assistant row."""
    n = "\n"
    rows = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    rid = F.col("conv_id") * 10 + F.col("turn")
    variant = F.col("response_id") % 5
    m = (F.col("conv_id") % 7).cast("string")
    body = F.when(
        variant == 4, F.concat(F.repeat(F.concat("text", F.lit(n + n)), LONG_PARAGRAPHS), F.col("text"))
    ).otherwise(F.col("text"))
    head = F.concat(
        F.lit("# Answer\n\n**"), "role", F.lit("** "), body, F.lit(" [^1][^2]\n- item one [^3]\n- item two\n"),
        F.lit("\nafter list\n```sql\nselect 1\n"),
        F.when(variant == 2, F.lit("")).otherwise(F.lit("```\n")),
        F.lit("\nend.\n"),
    )
    section = F.concat(
        F.lit("\nSources:\n[^1] [Context document 1](https://a.example.org/"), m,
        F.lit(")\n[^2] [Context document 2](https://b.example.org/"), m,
        F.lit(")\n[^3] [Context document 3](https://a.example.org/"), m, F.lit(")"),
    )
    tail = F.when(variant == 1, F.lit("")).otherwise(section)
    extra = F.when(variant == 3, F.lit("\nSources:\n[^9] [Late](https://late.example.org/)")).otherwise(
        F.lit("")
    )
    return rows.withColumn("response_id", rid).select(
        "response_id", F.concat(head, tail, extra).alias("response")
    )
