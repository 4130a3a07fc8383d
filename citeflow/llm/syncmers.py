"""Document fingerprints of closed syncmers.

A window of `K` characters is an anchor if the least of its inner `S`-character substrings, by hash, is
the first or the last of them. Whether a window is an anchor depends on its own characters alone, so the
anchors of a text cut out of others are those of its parts and the few windows across the seams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeflow.llm.quality import let
from citeflow.llm.tables import row_key, text_or_empty

S, INNER = 9, 32
K = S + INNER - 1  # 40 characters; one window in 16 is an anchor
BLOCK = 4096  # windows looked at together
LOW = (1 << 32) - 1
BUCKETS = 4  # for each shuffle partition, when texts are brought next to each other


def _anchors_of_block(code: Column, offset: Column) -> Column:
    """Anchors of a piece of text in UTF-32, as ``position << 32 | 32-bit hash``."""
    def wider(m: Column, step: int) -> Column:
        return let(m, lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b)))

    def inner(h: Column) -> Column:
        eight = wider(wider(wider(h, 1), 2), 4)  # the least of eight neighbours

        def chosen(m: Column) -> Column:
            def rest(x: Column, *at: Column) -> Column:
                return (x <= F.get(m, at[0])) & (x <= F.get(m, at[1])) & (x <= F.get(m, at[2]))

            def edge(i: Column) -> Column:
                first, last = F.get(h, i), F.get(h, i + (INNER - 1))
                return ((first == F.get(m, i)) & rest(first, i + 8, i + 16, i + 24)) | (
                    (last == F.get(m, i + 24)) & rest(last, i, i + 8, i + 16)
                )

            return F.filter(F.sequence(F.lit(0), F.size(h) - INNER), edge)

        return let(eight, chosen)

    hashes = F.transform(
        F.sequence(F.lit(1), F.length(code) - (4 * S - 1), F.lit(4)), lambda p: F.xxhash64(F.substring(code, p, F.lit(4 * S)))
    )
    return F.transform(
        let(hashes, inner),
        lambda i: F.shiftleft((offset + i).cast("long"), 32).bitwiseOR(
            F.xxhash64(F.substring(code, 4 * i + 1, F.lit(4 * K))).bitwiseAND(F.lit(LOW))
        ),
    )


def anchors(text: Column) -> Column:
    """Anchors of a text in order, an empty array if it has none. Long texts go block by block, so the
    arrays in between stay small."""
    def blocks(code: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.floor(F.length(code) / 4).cast("int") - K, F.lit(BLOCK)),
                lambda o: let(F.substring(code, 4 * o + 1, F.lit(4 * (BLOCK + K - 1))), lambda c: _anchors_of_block(c, o)),
            )
        )

    return F.when(F.length(text) < K, F.array().cast("array<bigint>")).otherwise(let(F.encode(text, "UTF-32"), blocks))


def positions(found: Column) -> Column:
    return F.transform(found, lambda x: F.shiftright(x, 32))


def marks(found: Column, text: Column) -> Column:
    """The anchors' hashes in order; a text without anchors has one, that of all of it."""
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(LOW)))
    return F.when(F.size(found) == 0, whole).otherwise(F.transform(found, lambda x: x.bitwiseAND(F.lit(LOW))))


def fingerprint(found_marks: Column) -> Column:
    """Eight hexadecimal digits a mark, in order of position."""
    return F.lower(F.array_join(F.transform(found_marks, lambda m: F.lpad(F.hex(m), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of common marks among all distinct marks of two fingerprints, from 0 to 1."""
    return F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 9)


def shifted(found: Column, by: Column) -> Column:
    return let(F.shiftleft(by.cast("long"), 32), lambda d: F.transform(found, lambda x: x + d))


def joined_anchors(a: Column, a_text: Column, b: Column, b_text: Column) -> Column:
    """Anchors of ``a_text || b_text`` from the anchors that lie inside the two: theirs, and those of the windows
    across the seam."""
    left, right = F.right(a_text, F.lit(K - 1)), F.left(b_text, F.lit(K - 1))
    seam = shifted(anchors(F.concat(left, right)), F.length(a_text) - F.length(left))
    return F.concat(a, seam, shifted(b, F.length(a_text)))


def _inside(found: Column, length: Column) -> Column:
    return let(length, lambda n: F.filter(found, lambda x: F.shiftright(x, 32) + K <= n))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each document and the one after it by descending doc_id, null last, ties
    by the row's key; the first follows the last.

    Documents are dealt into ranges of doc_id, and each range gets a copy of the first document of the next
    one, so the texts are shuffled once and no task orders more than its range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bound = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bound, lambda c: c <= F.col("doc_id"))))
    dealt = docs.withColumn("bucket", bucket)
    # At most one row a range: its highest doc_id.
    tops = sorted(((r["bucket"], r["top"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    after = [(b, tops[(i + 1) % len(tops)][1]) for i, (b, _) in enumerate(tops)]
    follow = spark.createDataFrame(after, "_for int, _id long")
    keyed = dealt.select("*", *row_key())
    heads = keyed.join(F.broadcast(follow.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    order = F.struct("_ka", "_kb")
    heads = heads.groupBy("doc_id").agg(F.min_by("text", order).alias("text"))
    guests = heads.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        F.col("doc_id"), "text", F.col("_for").alias("bucket"), F.lit(0).cast("long").alias("_ka"), F.lit(0).cast("long").alias("_kb"), F.lit(True).alias("guest")
    )
    window = W.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "_ka", "_kb")
    both = keyed.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.withColumn("next_text", F.lead("text").over(window)).withColumn("_found", anchors(F.col("text"))).withColumn(
        "_next_found", F.lead("_found").over(window)
    ).where("NOT guest").drop("guest", "bucket", "_ka", "_kb")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text (the last third replaced by the beginning of the
    next document) and how alike they are.

    Defined cases: a null text counts as empty; a text without anchors, empty ones too, has one mark, the hash of all
    of it. A null doc_id comes last, rows with one doc_id in order of their keys. A single document is its own
    next. No rows give no rows. Other columns are not looked at.
    """
    rows = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("_head", F.left(F.col("text"), F.length("text") - third)).withColumn(
        "_tail", F.left(F.col("next_text"), third)
    )
    rows = rows.withColumn("edited", F.concat("_head", "_tail"))
    rows = rows.withColumn(
        "_edited_found",
        joined_anchors(
            _inside(F.col("_found"), F.length("_head")), F.col("_head"), _inside(F.col("_next_found"), F.length("_tail")), F.col("_tail")
        ),
    )
    rows = (
        rows.withColumn("_own", marks(F.col("_found"), F.col("text")))
        .withColumn("_edit", marks(F.col("_edited_found"), F.col("edited")))
        .withColumn("_other", marks(F.col("_next_found"), F.col("next_text")))
    )
    return rows.select(
        "doc_id", "text", "edited", F.col("_found").alias("anchors"), F.col("_edited_found").alias("edited_anchors"),
        fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"), likeness(F.col("_own"), F.col("_other")).alias("near_next"),
        # Positional matching: anchors of the edited text at the very place they have in the text.
        F.size(F.array_intersect("_found", "_edited_found")).cast("long").alias("aligned"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next", "aligned",
    )
