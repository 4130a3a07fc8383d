"""A stored vector index: cells by k-means, compressed residuals, exact scores for what the residuals leave open.

Vectors lie in folders by cell. Their codes, a byte for each dimension, lie apart in folders of several cells, with a bound of
what the code leaves out. A search reads the codes of the cells it probes, which bound every score from
both sides, and then only the vectors that may belong to the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeflow.operators.best_matches import OUTPUT, UNITS, flat_lists
from citeflow.operators.retrieval import BLOCK_ENTRIES, _in_blocks, _ranked
from citeflow.session import written

FIT_ROWS = 200_000  # rows k-means is fitted on at most; every row is indexed
TRIAL_QUESTIONS = 100  # stored vectors that are asked to find out how many cells to probe
TRIAL_RECALL = 0.9  # of a question's exact result, for nineteen of twenty of them
CODE_CELLS = 8  # cells whose codes share a folder
PENDING_ROWS = 500_000

CODED = "chunk_id bigint, cell int, code binary, scale double, error double, same bigint, distance double, vector array<double>"
CODE = "chunk_id bigint, cell int, code binary, scale double, error double, same bigint, part int"
VECTOR = "chunk_id bigint, vector array<double>, cell int"
CELL = "cell int, centroid array<double>, radius double, n bigint"
CANDIDATE = "qid bigint, chunk_id bigint, cell int, low bigint, high bigint, same bigint"


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int

    def codes(self, cells: list[int]) -> DataFrame:
        """Codes of some cells; folders of others are not listed."""
        parts = sorted({c // CODE_CELLS for c in cells})
        return self._read("codes", CODE, "part", parts).where(F.col("cell").isin(cells))

    def vectors(self, cells: list[int]) -> DataFrame:
        return self._read("vectors", VECTOR, "cell", cells)

    def _read(self, table: str, schema: str, key: str, values: list[int]) -> DataFrame:
        if not values:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{table}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{key}={v}" for v in values])

    def cells_by_likeness(self, questions: np.ndarray) -> np.ndarray:
        """Cells that hold vectors, for each question those of the most similar centroid first."""
        likeness = np.where(np.isfinite(self.radius), questions @ self.centroids.T, -np.inf)
        return np.argsort(-likeness, axis=1, kind="stable")[:, : int(np.isfinite(self.radius).sum())]


def _coded(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]
    squares = (centroids**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, lengths = flat_lists(batch.column(1))
            if not (lengths == dim).all():
                raise ValueError(f"every vector must have {dim} numbers")
            x = values.astype(np.float64).reshape(-1, dim)
            cell = np.argmin(squares - 2 * x @ centroids.T, axis=1)
            rest = x - centroids[cell]
            scale = np.abs(rest).max(axis=1) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            # a little more than the true distances, so that bounds hold after rounding
            error = np.linalg.norm(rest - scale[:, None] * code, axis=1) * (1 + 1e-9) + 1e-12
            distance = np.linalg.norm(rest, axis=1) * (1 + 1e-9) + 1e-12
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array(scale), pa.array(error), batch.column(2), pa.array(distance),
                 batch.column(1).cast(pa.list_(pa.float64()))],
                names=["chunk_id", "cell", "code", "scale", "error", "same", "distance", "vector"],
            )

    return vectors.mapInArrow(run, CODED)


def write_vector_index(
    vectors: DataFrame, path: str, cells: int = 64, vector: str = "vector", seed: int = 7, k: int = 10
) -> None:
    """Index ``(chunk_id, vector)`` under ``path``; rows without an id or a vector are left out.

    Cells come from distributed k-means over at most ``FIT_ROWS`` rows. The number of cells that a search probes unless told
    otherwise is found by asking stored vectors for their ``k`` most similar ones.
    """
    spark = vectors.sparkSession
    held = vectors.where(F.col(vector).isNotNull() & F.col("chunk_id").isNotNull()).select(
        "chunk_id", F.col(vector).cast("array<double>").alias("vector")
    ).withColumn("same", F.xxhash64("vector"))
    n, first = held.count(), held.first()
    if not n:
        centroids = np.zeros((1, 1))
    elif held.where(F.col("same") != first["same"]).isEmpty():  # k-means wants two different vectors
        centroids = np.array([first["vector"]])
    else:
        fitted = held.sample(fraction=min(1.0, FIT_ROWS / n), seed=seed) if n > FIT_ROWS else held
        model = KMeans(k=max(2, min(cells, n)), seed=seed, maxIter=10, featuresCol="_v").fit(
            fitted.select(array_to_vector("vector").alias("_v"))
        )
        centroids = np.array(model.clusterCenters())
    coded = written(_coded(held, centroids), "coded")
    code = coded.select(
        "chunk_id", "cell", "code", "scale", "error", "same", F.floor(F.col("cell") / CODE_CELLS).cast("int").alias("part")
    )
    _write(code, f"{path}/codes", "part", ["part", "cell", "chunk_id"])
    _write(coded.select("chunk_id", "vector", "cell"), f"{path}/vectors", "cell", ["cell", "chunk_id"])
    sizes = {r["cell"]: r for r in coded.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect()}
    rows = [
        (i, c.tolist(), float(sizes[i]["r"]) if i in sizes else None, sizes[i]["n"] if i in sizes else 0)
        for i, c in enumerate(centroids)
    ]
    spark.createDataFrame(rows, CELL).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _write_probes(spark, path, _probes_needed(_read(spark, path, len(rows)), coded, k) if n else 1)


def _write(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    # ranges are cut by size, so a cell with a third of all rows is several tasks and files
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy(key).parquet(path)


def _write_probes(spark: SparkSession, path: str, probes: int) -> None:
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def _probes_needed(index: VectorIndex, coded: DataFrame, k: int) -> int:
    """The least number of cells that hold ``TRIAL_RECALL`` of the exact result of nineteen of twenty trial questions."""
    trial = coded.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRIAL_QUESTIONS)
    asked = written(trial.select(F.monotonically_increasing_id().alias("qid"), "vector"), "trial")
    exact = search(index, asked, k, exact=True).join(coded.select("chunk_id", "cell"), "chunk_id")
    rows = asked.toPandas().sort_values("qid")
    order = index.cells_by_likeness(np.stack(rows["vector"].to_numpy()))
    place = {int(q): {int(c): p for p, c in enumerate(cells)} for q, cells in zip(rows["qid"], order, strict=True)}
    found: dict[int, list[int]] = {}
    for r in exact.select("qid", "cell").collect():  # trial questions times k
        found.setdefault(r["qid"], []).append(place[r["qid"]][r["cell"]] + 1)
    needed = sorted(sorted(p)[math.ceil(TRIAL_RECALL * len(p)) - 1] for p in found.values())
    return needed[math.ceil(0.95 * len(needed)) - 1]


def _read(spark: SparkSession, path: str, probes: int) -> VectorIndex:
    rows = sorted(spark.read.schema(CELL).parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    radius = np.array([-np.inf if r["radius"] is None else r["radius"] for r in rows])
    return VectorIndex(spark, path, np.array([r["centroid"] for r in rows]), radius, probes)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    return _read(spark, path, spark.read.schema("probes int").parquet(f"{path}/probes").first()[0])


class Candidates:
    """Rows that may still be among a question's best ``k``, given bounds of their scores. Of equal vectors only the ``k``
    least ids can be, so copies without number do not pile up."""

    def __init__(self, n_questions: int, k: int):
        self.k, self.held, self.pending = k, [], 0
        self.floor = np.full(n_questions, np.iinfo(np.int64).min)

    def offer(self, question, ids, cell, low, high, same) -> None:
        keep = high >= self.floor[question]
        self.held.append([x[keep] for x in (question, ids, cell, low, high, same)])
        self.pending += int(keep.sum())
        if self.pending > PENDING_ROWS:
            self.compact()

    def compact(self) -> list[np.ndarray] | None:
        if not self.held:
            return None
        rows = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        order = np.lexsort((rows[1], rows[5], rows[0]))
        rows = [x[order] for x in rows]
        starts = np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[5]) != 0))
        place = np.arange(len(starts)) - np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        rows = [x[place < self.k] for x in rows]
        order = np.lexsort((-rows[3], rows[0]))
        question, low = rows[0][order], rows[3][order]
        kth = np.arange(len(question)) - np.searchsorted(question, question) == self.k - 1
        self.floor[question[kth]] = np.maximum(self.floor[question[kth]], low[kth])
        keep = rows[4] >= self.floor[rows[0]]
        rows = [x[keep] for x in rows]
        self.held, self.pending = [rows], len(rows[0])
        return rows


def code_scorer(qids, questions, centroids, asked, k):
    """Bounds of the scores of coded rows; ``asked`` says which question probes which cell."""
    norms = np.linalg.norm(questions, axis=1) * (1 + 1e-9)
    dim = questions.shape[1]

    def run(batches):
        found = Candidates(len(qids), k)
        for batch in batches:
            ids, cells, scale, error, same = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4, 5)
            )
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, dim)
            for cell in np.unique(cells):
                who, rows = np.flatnonzero(asked[:, cell]), np.flatnonzero(cells == cell)
                if not len(who):
                    continue
                base = questions[who] @ centroids[cell]
                step = max(1, 4_000_000 // len(who))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    score = base + scale[part, None] * (code[part].astype(np.float64) @ questions[who].T)
                    slack = error[part, None] * norms[who] + 1e-9
                    doc, question = (x.ravel() for x in np.indices(score.shape))
                    low, high = np.floor((score - slack) * UNITS), np.ceil((score + slack) * UNITS)
                    found.offer(who[question], ids[part][doc], cells[part][doc], low.ravel().astype(np.int64),
                                high.ravel().astype(np.int64), same[part][doc])
        if (rows := found.compact()) is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[rows[0]]), *(pa.array(x) for x in rows[1:])],
                names=["qid", "chunk_id", "cell", "low", "high", "same"],
            )

    return run


def search(
    index: VectorIndex, question_vectors: DataFrame, k: int, probes: int | None = None, exact: bool = False,
    vector: str = "vector", block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Best ``k`` chunks per question ``(qid, vector)``.

    Probes the ``probes`` cells of the most similar centroids, by default as many as the trial at writing asked for. With
    ``exact`` it goes on to every cell whose centroid and radius allow a score that the question's ``k``-th best does not
    exceed, and finds what a scan of all vectors finds.
    """
    asked = question_vectors.where(F.col(vector).isNotNull()).select("qid", F.col(vector).cast("array<double>").alias("vector"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()

    def run(block, store):
        rows = block.collect()
        if rows:
            qids, matrix = np.array([r["qid"] for r in rows], np.int64), np.array([r["vector"] for r in rows])
            _search_block(index, qids, matrix, k, probes or index.probes, exact, store)

    return _in_blocks(asked, math.ceil(n * (dim or 0) / block_entries), run)


def _search_block(index, qids, matrix, k, probes, exact, store) -> None:
    spark = index.spark
    order = index.cells_by_likeness(matrix)
    if not order.shape[1]:
        return
    asked = np.zeros((len(qids), len(index.centroids)), bool)
    np.put_along_axis(asked, order[:, :probes], True, axis=1)
    found = _candidates(index, qids, matrix, asked, k)
    if exact:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low")))
        kth = found.withColumn("_place", place).where(F.col("_place") == k).select("qid", "low").collect()
        least = {r["qid"]: r["low"] for r in kth}  # one row a question of the block
        reach = (matrix @ index.centroids.T + np.linalg.norm(matrix, axis=1)[:, None] * index.radius) * UNITS + 2
        wanted = reach >= np.array([least.get(int(q), -np.inf) for q in qids], float)[:, None]
        more = wanted & ~asked & np.isfinite(index.radius)
        if more.any():
            found = found.unionByName(_candidates(index, qids, matrix, more, k))
    top = found.withColumn("_place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low"))))
    floor = top.where(F.col("_place") <= k).groupBy("qid").agg(F.count("*").alias("n"), F.min("low").alias("least"))
    open_ = found.join(floor, "qid").where((F.col("n") < k) | (F.col("high") >= F.col("least"))).select("qid", "chunk_id", "cell")
    open_ = written(open_, "open")
    cells = sorted(r[0] for r in open_.select("cell").distinct().collect())
    pairs = open_.join(index.vectors(cells), ["cell", "chunk_id"]).select("qid", "chunk_id", "vector")
    shared = spark.sparkContext.broadcast((qids, matrix))

    def scored(batches):
        names, questions = shared.value
        by_id = np.argsort(names)
        for batch in batches:
            if batch.num_rows:
                qid = batch.column(0).to_numpy(zero_copy_only=False)
                own = by_id[np.searchsorted(names[by_id], qid)]
                x = flat_lists(batch.column(2))[0].reshape(len(qid), -1)
                units = np.rint(np.einsum("ij,ij->i", x, questions[own]) * UNITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(units)], names=["qid", "chunk_id", "score_units"]
                )

    store(_ranked(pairs.mapInArrow(scored, OUTPUT), k))
    shared.destroy()


def _candidates(index: VectorIndex, qids, matrix, asked: np.ndarray, k: int) -> DataFrame:
    """Rows of the probed cells that may be in a result, each task's share cut down by bounds."""
    state = index.spark.sparkContext.broadcast((qids, matrix, index.centroids, asked, k))
    cells = [int(c) for c in np.flatnonzero(asked.any(axis=0))]
    coded = index.codes(cells).select("chunk_id", "cell", "code", "scale", "error", "same")
    found = written(coded.mapInArrow(lambda x: code_scorer(*state.value)(x), CANDIDATE), "candidates")
    state.destroy()
    return found
