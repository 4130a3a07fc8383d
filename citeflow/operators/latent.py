"""Learnt text vectors: words that stand in the same company come near each other, without a word in common.

The matrix of texts by hashed words, weighted and of unit rows, is cut down to its strongest directions by randomised
subspace iteration. A pass over the texts multiplies a block of directions by the matrix and its transpose; what a task
sends on, and what the driver holds, is as large as the number of hashed words times that of directions, whatever the
size of the corpus. The number of passes is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions.text import tokens
from citeflow.operators.best_matches import flat_lists
from citeflow.operators.retrieval import semantic_search
from citeflow.session import written

WORDS = 4096  # hashed words
RANK = 64  # directions of a vector
SPARE = 8  # directions more while iterating
PASSES = 4
DENSE_CELLS = 2_000_000  # cells of a block of weighted rows


@dataclass(frozen=True)
class LatentModel:
    """Weight of each hashed word, and the directions as columns with their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray


def _hashed(text: Column, words: int) -> Column:
    return F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(words)).cast("int"))


def _weighted(column: pa.Array, idf: np.ndarray):
    """Blocks of rows ``(first row, counts times weights of unit length)``; rows without words are zero."""
    words = len(idf)
    values, lengths = flat_lists(column)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    step = max(1, DENSE_CELLS // words)
    for at in range(0, len(column), step):
        stop = min(at + step, len(column))
        row = np.repeat(np.arange(stop - at), lengths[at:stop])
        cells = row * words + values[ends[at] : ends[stop]]
        block = np.bincount(cells, minlength=(stop - at) * words).reshape(stop - at, words) * idf
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        yield at, block / np.where(norm > 0, norm, 1)


def fit_latent(
    corpus: DataFrame, text: str = "chunk", words: int = WORDS, rank: int = RANK, passes: int = PASSES, seed: int = 7
) -> LatentModel:
    """Learn from all texts of ``corpus``. Directions are fewer where the matrix has a lower rank."""
    spark = corpus.sparkSession
    held = written(corpus.select(_hashed(F.col(text), words).alias("w")), "words")
    n = held.count()
    idf = np.full(words, np.log(n + 1.0))
    for r in held.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").count().collect():  # one row a word
        idf[r["w"]] = np.log((n + 1.0) / (r["count"] + 1.0))
    width = min(words, rank + SPARE)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((words, width)))[0]
    for _ in range(passes):
        product = _gram_times(spark, held, idf, block)
        last, block = block, np.linalg.qr(product)[0]
    # Rayleigh-Ritz on the block that the last product was made of
    values, turn = np.linalg.eigh(last.T @ product)
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * 1e-9]
    return LatentModel(idf, last @ turn[:, order], np.sqrt(values[order]))


def _gram_times(spark: SparkSession, held: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times ``block``: a pass over the texts."""
    shared = spark.sparkContext.broadcast((idf, block))

    def run(batches):
        weights, given = shared.value
        total = np.zeros_like(given)
        for batch in batches:
            for _, rows in _weighted(batch.column(0), weights):
                total += rows.T @ (rows @ given)
        cells = np.flatnonzero(total.ravel())
        for at in range(0, len(cells), 100_000):
            part = cells[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part, pa.int64()), "v": pa.array(total.ravel()[part])})

    sums = held.mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    shared.destroy()
    out = np.zeros(block.size)
    out[sums["cell"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(block.shape)


def embed_latent(model: LatentModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, vector)``: unit vectors of the texts; all zeros where no word is known to the directions."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    words, rank = model.directions.shape

    def run(batches):
        held = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, rank))
            for at, rows in _weighted(batch.column(1), held.idf):
                out[at : at + len(rows)] = rows @ held.directions
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.where(norm > 1e-9, out / np.where(norm > 1e-9, norm, 1), 0.0)
            bounds = pa.array(np.arange(batch.num_rows + 1) * rank, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))], names=[key, "vector"]
            )

    hashed = df.select(key, _hashed(F.col(text), words).alias("w"))
    kind = df.schema[key].dataType.simpleString()
    return hashed.mapInArrow(run, f"{key} {kind}, vector array<double>")


def write_latent(spark: SparkSession, model: LatentModel, path: str) -> None:
    rows = [(i, float(w), d.tolist()) for i, (w, d) in enumerate(zip(model.idf, model.directions, strict=True))]
    spark.createDataFrame(rows, "word int, idf double, direction array<double>").write.mode("overwrite").parquet(f"{path}/words")
    spark.createDataFrame([(model.values.tolist(),)], "v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/values")


def read_latent(spark: SparkSession, path: str) -> LatentModel:
    rows = spark.read.parquet(f"{path}/words").orderBy("word").collect()  # one row a hashed word
    values = spark.read.parquet(f"{path}/values").first()["v"]
    return LatentModel(
        np.array([r["idf"] for r in rows]), np.array([r["direction"] for r in rows]).reshape(len(rows), -1), np.array(values)
    )


def latent_search(
    corpus: DataFrame, questions: DataFrame, k: int, model: LatentModel | None = None, text: str = "chunk"
) -> DataFrame:
    """Best ``k`` chunks per question ``(qid, question)`` by learnt vectors of both texts."""
    model = model or fit_latent(corpus, text)
    held = embed_latent(model, corpus, "chunk_id", text)
    return semantic_search(held, embed_latent(model, questions, "qid", "question"), k)
