"""Ranked retrieval and the merging of ranked lists.

Hits are rows ``(qid, rank, score, chunk_id)``: ``rank`` counts from 1 within a question and
``score`` is ``decimal(18,9)``. A list's order is its ``rank`` column.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.functions.text import tokens
from citeflow.operators.best_matches import OUTPUT, cell_scorer, range_scorer, term_scorer, vector_scorer
from citeflow.session import scratch_folder, written
from citeflow.sizes import BROADCAST_IDS, BROADCAST_ROWS, broadcast_if_small
from citeflow.sources.chunk_store import ChunkStore

SCORE = "decimal(18,9)"
K1 = 1.2
B = 0.75
# Fixed value: boost of the semantic leg in the scored merge.
SEMANTIC_BOOST = Decimal("1.2")
# One block of questions holds at most this many (question, term) entries or vector numbers. That bounds what the
# driver collects and broadcasts at a time; the blocks of a larger question set follow one another.
BLOCK_ENTRIES = 2_000_000


# --- top-k -----------------------------------------------------------------------------------


def top_k_per_query(scored: DataFrame, k: int, order: list[Column], by: str = "qid") -> DataFrame:
    """First ``k`` rows of each question in ``order``, numbered from 1 as ``rank``.

    The limit sits directly above the window, so tasks drop all but ``k`` rows of a question before
    the shuffle; a question with a third of all candidates costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    unit = F.lit(Decimal("0.000000001"))
    score = (F.col("score_units").cast("decimal(18,0)") * unit).cast(SCORE)
    top = top_k_per_query(scored, k, [F.col("score_units").desc(), F.col("chunk_id")])
    return top.select("qid", "rank", score.alias("score"), "chunk_id")


def _in_blocks(asked: DataFrame, n: int, run) -> DataFrame:
    """Answer questions in ``n`` blocks: ``run(block, store)`` gives a block's ranked hits to ``store``, which appends
    them to one table before the next block begins, so neither plans nor broadcasts pile up. Any number of blocks, also a
    single one, takes this path."""
    spark = asked.sparkSession
    path = scratch_folder(spark, "hits")
    _no_hits(spark).write.parquet(path)
    for i in range(n):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        run(part, lambda hits: hits.write.mode("append").parquet(path))
    return spark.read.schema(_no_hits(spark).schema).parquet(path)


def _best_rows(held: DataFrame, scorer, state: tuple, k: int, store) -> None:
    """Score ``held`` in place against the broadcast ``state``, store the ranked best, and let the broadcast go."""
    asked = held.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        return scorer(*asked.value)(batches)

    store(_ranked(held.mapInArrow(run, OUTPUT), k))
    asked.destroy()


def _no_hits(spark) -> DataFrame:
    return spark.createDataFrame([], f"qid bigint, rank int, score {SCORE}, chunk_id bigint")


# --- keyword leg -----------------------------------------------------------------------------


def keyword_search(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    text: str = "chunk",
    k1: float = K1,
    b: float = B,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Best ``k`` chunks per question by BM25 over ``(qid, question)``.

    The corpus is tokenised once, whatever the number of blocks, and never shuffled. A block's vocabulary is
    counted inside the rows of the corpus: what is written is one compact row per chunk.
    """
    held = corpus.select("chunk_id", tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    asked, blocks = _asked_tokens(questions, block_entries)
    if blocks > 1:
        held = written(held, "tokens")

    def run(block, store):
        if found := _question_terms(block):
            _keyword_block(held, *found, k, k1, b, store)

    return _in_blocks(asked, blocks, run)


def keyword_search_indexed(
    index, questions: DataFrame, k: int, k1: float = K1, b: float = B, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """As `keyword_search`, over a stored term index: reads only the buckets and token ranges of asked tokens, and scores
    only ranges of chunks that can still hold one of a question's best ``k`` (see `index.TermIndex.open_ranges`)."""
    asked, blocks = _asked_tokens(questions, block_entries)
    n_docs, total_length = index.size()

    def run(block, store):
        if total_length and (found := _question_terms(block)):
            _indexed_block(index, n_docs, total_length / n_docs, *found, k, k1, b, store)

    return _in_blocks(asked, blocks, run)


def _asked_tokens(questions: DataFrame, block_entries: int) -> tuple[DataFrame, int]:
    """``(qid, tokens)`` with distinct tokens, and the number of blocks they are asked in."""
    asked = questions.select("qid", F.array_distinct(tokens(F.col("question"))).alias("tokens"))
    entries = asked.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return asked, math.ceil(entries / block_entries)


def _question_terms(block: DataFrame):
    """A block on the driver: question ids, where each one's terms begin, their terms, and the vocabulary."""
    rows = block.where(F.size("tokens") > 0).collect()
    vocabulary = sorted({t for r in rows for t in r["tokens"]})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    qids = np.array([r["qid"] for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r["tokens"]) for r in rows])]).astype(np.int64)
    terms = np.array([number[t] for r in rows for t in r["tokens"]], np.int64)
    return qids, offsets, terms, vocabulary


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _keyword_block(held, qids, offsets, terms, vocabulary, k, k1, b, store) -> None:
    spark = held.sparkSession
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="terms")
    counted = model.transform(held).select("chunk_id", F.size("tokens").alias("length"), "terms")
    path = scratch_folder(spark, "counts")
    counted.write.parquet(path)
    vector = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    stored = spark.read.schema(f"chunk_id bigint, length int, terms {vector}").parquet(path)
    # plain arrays, which Arrow can carry
    counts = stored.select(
        "chunk_id", "length", F.col("terms.indices").alias("term_ids"), F.col("terms.values").alias("term_counts")
    )
    # one pass over the compact rows: document frequency per term, and under -1 the corpus size
    seen = F.concat(F.array(F.lit(-1)), F.col("term_ids"))
    totals = (
        counts.select("length", F.explode(seen).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("length").alias("total"))
        .toPandas()
        .set_index("term")
    )
    n_docs, total_length = (0, 0) if totals.empty else (int(v) for v in totals.loc[-1, ["df", "total"]])
    if total_length == 0:
        return
    df = np.zeros(len(vocabulary))
    known = totals[totals.index >= 0]
    df[known.index.to_numpy()] = known["df"].to_numpy()
    matching = counts.filter(F.size("term_ids") > 0)
    state = (qids, offsets, terms, _idf(df, n_docs), total_length / n_docs, k, k1, b)
    _best_rows(matching, term_scorer, state, k, store)


def _indexed_block(index, n_docs, mean_length, qids, offsets, terms, vocabulary, k, k1, b, store) -> None:
    df = index.frequencies(vocabulary)
    weights = _idf(df, n_docs)
    state = (qids, offsets, terms, weights, mean_length, k, k1, b)
    floor, ranges = index.open_ranges(*state, vocabulary, _ranked)
    _best_rows(index.by_range(vocabulary, ranges), range_scorer, (*state, floor), k, store)


# --- semantic leg ----------------------------------------------------------------------------


def semantic_search(
    corpus_vectors: DataFrame,
    question_vectors: DataFrame,
    k: int,
    vector: str = "vector",
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Best ``k`` chunks per question by cosine of unit vectors, exact.

    Takes ``(chunk_id, vector)`` and ``(qid, vector)``. A block of question vectors is broadcast at a time; the corpus
    is scanned in place and only best rows are shuffled.
    """
    return _semantic(
        corpus_vectors, question_vectors, k, vector, vector_scorer, lambda qids, m: (qids, m, k), block_entries
    )


def semantic_search_ann(
    corpus_vectors: DataFrame,
    question_vectors: DataFrame,
    k: int,
    vector: str = "vector",
    planes: int = 6,
    probes: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """As `semantic_search`, scoring a question only against the ``probes`` nearest of
    ``2 ** planes`` cells cut by random hyperplanes; all of them unless fewer are asked for.

    With fewer probes it is approximate by choice: the share of the exact result it finds grows with
    ``probes``, up to all of it when every cell is probed. Work is split by corpus partition, not by cell, so a cell
    that holds a third of the corpus is no hot spot, and scores are exact for every pair looked at.
    """
    if not 1 <= planes <= 12:
        raise ValueError("planes must be between 1 and 12")

    def state(qids, matrix):
        cut = np.random.default_rng(seed).standard_normal((planes, matrix.shape[1]))
        return (qids, matrix, cut, min(probes or 1 << planes, 1 << planes), k)

    return _semantic(corpus_vectors, question_vectors, k, vector, cell_scorer, state, BLOCK_ENTRIES)


def _semantic(corpus_vectors, question_vectors, k, vector, scorer, state, block_entries) -> DataFrame:
    asked = question_vectors.filter(F.col(vector).isNotNull()).select("qid", vector)
    n, dim = asked.agg(F.count("*"), F.max(F.size(vector))).first()
    held = corpus_vectors.filter(F.col(vector).isNotNull()).select("chunk_id", vector)
    blocks = math.ceil(n * (dim or 0) / block_entries)
    # Several blocks read the vectors again and again: what made them is then done once.
    held = written(held, "vectors") if blocks > 1 else held

    def run(block, store):
        rows = block.toPandas()
        if len(rows):
            qids = rows["qid"].to_numpy(dtype=np.int64)
            matrix = np.stack(rows[vector].to_numpy()).astype(np.float64)
            _best_rows(held, scorer, state(qids, matrix), k, store)

    return _in_blocks(asked, blocks, run)


# --- columns of hits ------------------------------------------------------------------------


def search_projection(hits: DataFrame, corpus: DataFrame | ChunkStore, columns: list[str]) -> DataFrame:
    """Add the requested corpus columns to ranked hits.

    Runs after the top-k, so texts are read for at most questions x k ids. From a chunk store only the ranges that were
    hit are read. A plain table has to be scanned: counted hits are broadcast and the corpus is not shuffled. With too many
    hits for that, their distinct ids alone are broadcast, up to a larger bound, and only chunks that were hit are
    shuffled to the join.
    """
    if isinstance(corpus, ChunkStore):
        return corpus.project(hits, columns)
    wanted = corpus.select("chunk_id", *columns)
    if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = F.broadcast(hits).join(wanted, "chunk_id")
    else:
        ids = broadcast_if_small(hits.select("chunk_id").distinct(), BROADCAST_IDS)
        joined = hits.join(wanted.join(ids, "chunk_id", "left_semi"), "chunk_id")
    return joined.select(*hits.columns, *columns)


# --- merging ranked lists --------------------------------------------------------------------


def legs(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both lists of each question, told apart by ``leg``: 0 semantic, 1 keyword."""
    return semantic.withColumn("leg", F.lit(0)).unionByName(keyword.withColumn("leg", F.lit(1)))


def union_all_ranked(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` followed by ``second`` within each question: ``leg`` 0 or 1 and a new ``rank``."""
    order = Window.partitionBy("qid").orderBy("leg", F.col("rank"))
    return legs(first, second).withColumn("rank", F.row_number().over(order))


def dedupe_by_text(hits: DataFrame, text: str = "chunk", order: tuple[str, ...] = ("rank",)) -> DataFrame:
    """First hit in order per question and distinct text; keeps its rank.

    A limit of one above the window lets every task drop repeats before the shuffle. The hash in front
    of the text keeps sorting from comparing long texts that differ.
    """
    same = Window.partitionBy("qid", F.xxhash64(text), text)
    place = F.row_number().over(same.orderBy(*order))
    return hits.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def hybrid_first_seen(both: DataFrame, k: int, text: str = "chunk") -> DataFrame:
    """Semantic list then keyword list (see `legs`), repeats by text dropped, first ``k`` kept.

    A question has at most two short lists here, so one shuffle by question serves both windows.
    """
    first = dedupe_by_text(both.repartition("qid"), text, ("leg", "rank"))
    return top_k_per_query(first, k, [F.col("leg"), F.col("rank")])


def hybrid_boosted(
    both: DataFrame, k: int, text: str = "chunk", normalize: str | None = "max"
) -> DataFrame:
    """Scored merge of two lists (see `legs`) of up to ``2k`` rows each.

    A text's first semantic row counts 1.2 times its score. A keyword row takes its place only with
    a strictly greater score of its own, and keeps the place's position among ties. Missing scores
    count 0. ``normalize="max"`` first divides each list by the question's best score, since cosine
    and term scores have different scales.
    """
    score = F.coalesce(F.col("score"), F.lit(0)).cast(SCORE)
    rest = [c for c in both.columns if c not in ("qid", "score", "rank", "leg", text)]
    both = both.repartition("qid").withColumn("score", score)
    if normalize == "max":
        top = F.max("score").over(Window.partitionBy("qid", "leg"))
        scaled = (F.col("score").cast("double") / F.col("_top").cast("double")).cast(SCORE)
        both = (
            both.withColumn("_top", top)
            .withColumn("score", F.when(F.col("_top") > 0, scaled).otherwise(F.col("score")))
            .drop("_top")
        )
    elif normalize is not None:
        raise ValueError(f"unknown normalisation {normalize!r}")

    boosted = F.when(F.col("leg") == 0, F.col("score") * F.lit(SEMANTIC_BOOST)).otherwise(
        F.col("score").cast("decimal(21,10)")
    )
    row = F.struct(boosted.alias("score"), F.col("rank"), F.col("leg"), *rest)
    is_semantic, is_keyword = F.col("leg") == 0, F.col("leg") == 1
    merged = both.groupBy("qid", text).agg(
        F.min_by(F.when(is_semantic, row), F.when(is_semantic, F.col("rank"))).alias("sem"),
        F.min(F.when(is_keyword, F.col("rank"))).alias("kw_first"),
        F.max_by(
            F.when(is_keyword, row),
            F.when(is_keyword, F.struct("score", (-F.col("rank")).alias("r"))),
        ).alias("kw"),
    )
    use_keyword = F.col("sem").isNull() | (F.col("kw.score") > F.col("sem.score"))
    chosen = merged.select(
        "qid",
        text,
        F.when(use_keyword, F.col("kw")).otherwise(F.col("sem")).alias("row"),
        F.col("sem").isNull().alias("late"),
        F.coalesce("sem.rank", "kw_first").alias("place"),
    ).select("qid", text, "row.score", "row.leg", *[f"row.{c}" for c in rest], "late", "place")
    order = [F.col("score").desc(), F.col("late"), F.col("place")]
    return top_k_per_query(chosen, k, order).drop("late", "place")
