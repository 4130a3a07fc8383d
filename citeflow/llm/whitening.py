"""Embedding whitening: principal components by contour integration (FEAST), rows scaled to unit variance.

Two passes of sums over all vectors give the exact covariance, which has as many entries as the dimension squared
whatever the number of rows. Eigenvalue intervals are found by counting the negative pivots of shifted
factorisations. Each interval is one Spark task: it projects a block of vectors onto the interval's eigenspace by
a quadrature of complex shifted solves around it, and extracts eigenpairs by Rayleigh-Ritz.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.tables import Scratch

SCALE, SHIFT = 1024, 100_000  # x = floor(SCALE * entry) + SHIFT
FAR = 2.0**40  # scaled entries beyond this are set to it, so that squares and sums stay in range
NODES = 16  # quadrature nodes on the upper half of the contour
SPARE = 6  # vectors a block has beyond the eigenvalues of its interval
ROUNDS = 40
PER_INTERVAL = 4  # eigenvalues one interval holds where they can be told apart


def scaled(vector: Column) -> Column:
    """Entries as whole numbers; null where a vector is null or holds a null or non-finite entry."""
    whole = F.transform(
        vector, lambda c: (F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-FAR)), F.lit(FAR))) + SHIFT)
    )
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & finite, whole)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension. Vectors are of the length that most have (of
    several, the greatest); others are not part of the fit."""

    def per_task(batches):
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = column.value_lengths().to_numpy()
            for length in np.unique(lengths):
                x = _rows(column.filter(pa.array(lengths == length)))
                had = found.get(int(length), [0, np.zeros(length, object)])
                # Halves keep the sums exact.
                high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
                found[int(length)] = [had[0] + len(x), had[1] + (high.astype(object) << 20) + low.astype(object)]
        for length, (n, s) in found.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([length] * length, pa.int32()), "i": pa.array(range(length), pa.int32()),
                "n": pa.array([n] * length, pa.int64()), "high": pa.array([int(v) >> 20 for v in s], pa.int64()),
                "low": pa.array([int(v) & 0xFFFFF for v in s], pa.int64()),
            })

    parts = vectors.select("x").mapInArrow(per_task, "length int, i int, n long, high long, low long")
    big = "decimal(38,0)"
    total = (
        parts.groupBy("length", "i")
        .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low"))
    )
    if not (most := total.where("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()):
        return 0, []
    rows = total.where(F.col("length") == most[0]["length"]).orderBy("i").collect()  # one row a dimension
    return int(most[0]["n"]), [(int(r["high"]) << 20) + int(r["low"]) for r in rows]


def covariance(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, exact before one last rounding: whole numbers, centred by the whole
    number next to the mean before they are multiplied, the rest of the mean taken off afterwards."""
    size = len(total)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    upper = np.array([a * size + b for a, b in pairs])

    def per_task(batches):
        found = np.zeros((size, size), object)
        for batch in batches:
            x = _rows(batch.column(0)) - centre
            # In double precision whole numbers are exact up to 2^53; blocks are as long as that allows.
            most = max(1, int(np.abs(x).max(initial=0)))
            block = max(1, (1 << 53) // most**2)
            for at in range(0, len(x), block):
                part = x[at : at + block].astype(np.float64)
                product = part.T @ part
                found += np.array([int(v) for v in product.ravel()], object).reshape(size, size)
        flat = found.ravel()
        values = [int(flat[k]) for k in upper]
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(upper, pa.int64()), "high": pa.array([v >> 40 for v in values], pa.int64()),
            "low": pa.array([v & ((1 << 40) - 1) for v in values], pa.int64()),
        })

    big = "decimal(38,0)"
    parts = vectors.select("x").mapInArrow(per_task, "cell long, high long, low long")
    cells = parts.groupBy("cell").agg(
        F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low")
    )
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    out = np.zeros((size, size))
    for r in cells.collect():  # dimension squared, whatever the number of rows
        a, b = divmod(r["cell"], size)
        exact = n * ((int(r["high"]) << 40) + int(r["low"])) - rest[a] * rest[b]
        out[a, b] = out[b, a] = exact / (n * n)
    return out


def above(matrix: np.ndarray, at: float) -> int:
    """Number of eigenvalues greater than ``at``: positive pivots of the shifted matrix (Sylvester's inertia)."""
    size, norm = len(matrix), max(np.abs(matrix).max(initial=0.0), 1e-300)
    for attempt in range(60):
        rest = matrix - np.eye(size) * (at + attempt * norm * 1e-15)
        count = 0
        for k in range(size):
            pivot = rest[k, k]
            if abs(pivot) < norm * 1e-14:
                break  # too close to an eigenvalue of a leading part: shift by a rounding error
            count += int(pivot > 0)
            rest[k + 1 :, k + 1 :] -= np.outer(rest[k + 1 :, k], rest[k, k + 1 :] / pivot)
        else:
            return count
    raise ArithmeticError("no shift with usable pivots")


def intervals(matrix: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """Eigenvalue intervals (low, high, number inside) that hold the ``wanted`` greatest eigenvalues above ``floor``."""
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * 1.01  # no eigenvalue lies beyond the greatest row sum
    low, high = floor, bound
    wanted = min(wanted, above(matrix, floor))
    inside, least = above(matrix, low), 1e-10 * bound
    # Bisect for an edge below the last wanted eigenvalue; equal ones at the edge all come in.
    bottom, top = low, high
    while inside != wanted and top - bottom > least:
        middle = (bottom + top) / 2
        count = above(matrix, middle)
        if count >= wanted:
            bottom, inside = middle, count
        else:
            top = middle
    found, open_ = [], [(bottom, high, inside)] if inside else []
    while open_:
        a, b, k = open_.pop()
        if k <= PER_INTERVAL or b - a <= least:
            found.append((a, b, k))
            continue
        middle = (a + b) / 2
        upper = above(matrix, middle) - above(matrix, b)
        open_ += [(x, y, m) for x, y, m in ((a, middle, k - upper), (middle, b, upper)) if m]
    return sorted(found)


def eigenpairs(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``."""
    size = len(matrix)
    width = min(size, count + SPARE)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (angles + 1))
    shifts, weights = centre + radius * turns, radius * turns * weights / 4
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    norm = np.abs(matrix).max()
    slack = 1e-11 * norm  # equal eigenvalues lie in an interval about as narrow as their rounding errors
    best = None
    for _ in range(ROUNDS):
        # The half below the real axis gives the conjugate, so twice the real part is the whole contour.
        spread = sum(2 * (w * np.linalg.solve(z * np.eye(size) - matrix, block)).real
                     for z, w in zip(shifts, weights, strict=True))
        basis = np.linalg.qr(spread)[0]
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ turn
        off = np.linalg.norm(matrix @ block - block * values, axis=0)
        # A value of the reduced matrix that is no eigenvalue has a large residual. Those just outside count only where
        # too few lie inside.
        near = np.flatnonzero((values > low - slack) & (values <= high + slack))
        outside = (values[near] <= low) | (values[near] > high)
        inside = near[np.lexsort((off[near], outside))][:count]
        error = off[inside].max(initial=0.0) if len(inside) == count else np.inf
        if best is None or error < best[0]:
            best = (error, values[inside], block[:, inside])
        elif np.isfinite(best[0]) and best[0] <= 1e-10 * norm:
            break  # no further gain in double precision
    if not np.isfinite(best[0]):
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but they were not all found")
    return best[1], best[2]


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues in falling order and their unit eigenvectors as columns.

    Eigenvalues that are zero to double precision have no component. One task works out one interval; the number of
    eigenvalues inside is counted by inertia beforehand and must be found.
    """
    size = len(matrix)
    floor = float(np.trace(matrix) * size * np.finfo(float).eps * 16)
    parts = intervals(matrix, wanted, floor) if np.trace(matrix) > 0 else []
    if not parts:
        return np.empty(0), np.empty((size, 0))

    def per_task(batches):
        for batch in batches:
            for low, high, count in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                values, vectors = eigenpairs(matrix, low, high, count)
                yield pa.RecordBatch.from_pydict({
                    "value": pa.array(values), "vector": pa.array(list(vectors.T), pa.list_(pa.float64())),
                })

    jobs = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts))
    rows = jobs.mapInArrow(per_task, "value double, vector array<double>").collect()  # one row a component
    basis = np.linalg.qr(np.array([r["vector"] for r in rows]).T)[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], (basis @ turn)[:, order]
    for k in range(1, len(values)):
        between = (values[k - 1] + values[k]) / 2
        if values[k - 1] - values[k] > 1e-9 * values[0] and above(matrix, between) != k:
            raise ArithmeticError(f"an eigenvalue above {between} is missing")
    values, vectors = values[:wanted], vectors[:, :wanted]
    heads = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(heads < 0, -1.0, 1.0)


def _exact_squares(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact: halves of 24 bits, whose products are sums of longs."""
    high, low = d >> 24, d & 0xFFFFFF
    parts = zip((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1), strict=True)
    return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in parts]


def _error(table: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity."""

    def per_task(work: Callable[[np.ndarray], np.ndarray], name: str):
        def run(batches: Iterable[pa.RecordBatch]):
            total = None
            for batch in batches:
                part = work(_rows(batch.column(0)))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(range(total.size), pa.int32()), name: total.ravel()})

        return run

    def gathered(run) -> np.ndarray:
        parts = table.select("w").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
        return np.array([r["v"] for r in parts.orderBy("cell").collect()])  # at most width squared rows

    mean = gathered(per_task(lambda w: w.sum(axis=0), "v")) / n
    square = gathered(per_task(lambda w: (w - mean).T @ (w - mean), "v")) / n
    return float(np.abs(square.reshape(width, width) - np.eye(width)).max())


def whitened(docs: DataFrame, wanted: int = 8, vector: str = "embedding") -> DataFrame:
    """A row for each usable vector: ``row`` (its columns), ``n``, ``deviation`` (decimal, exact), ``w`` (array, one
    whitened coordinate a component), ``explained`` (array) and ``identity_error``.

    Defined cases: vectors that are null, empty or hold null or non-finite entries have no row, and neither have those of
    another length than most. Equal rows, null ids and extra columns are carried along. Entries
    beyond 2^30 count as that bound; ``deviation`` is exact while n times an entry's distance from the mean stays
    below 2^48. Fewer components come out where the covariance has a lower rank, none for one vector or for equal
    ones (``w`` is empty then). No rows give no rows.
    """
    spark = docs.sparkSession
    vectors = docs.select(F.struct(*docs.columns).alias("row"), scaled(F.col(vector)).alias("x")).where("x is not null")
    n, total = sums(vectors)
    size = len(total)
    vectors = vectors.where(F.size("x") == size)
    matrix = covariance(vectors, n, total) if n else np.zeros((0, 0))
    values, axes = components(spark, matrix, wanted) if n else (np.empty(0), np.empty((0, 0)))
    width = len(values)
    schema = vectors.select("row").schema.add("squares", "string").add("w", T.ArrayType(T.DoubleType()))
    weights = axes / np.sqrt(values) if width else axes
    offsets = np.array(total, np.int64) if n else None

    def per_task(batches):
        for batch in batches:
            if batch.num_rows:
                d = _rows(batch.column(1)) * n - offsets
                w = (d / n) @ weights
                bounds = pa.array(np.arange(len(d) + 1) * width, pa.int32())
                lists = pa.ListArray.from_arrays(bounds, pa.array(w.ravel()))
                squares = pa.array([str(v) for v in _exact_squares(d)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), squares, lists], names=schema.names
                )

    table = Scratch(spark, "whitening").write(vectors.mapInArrow(per_task, schema), "w")
    error = _error(table, n, width) if width else None
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)]) if width else F.array().cast("array<double>")
    return table.select(
        "row", F.lit(n).cast("long").alias("n"), F.col("squares").cast("decimal(38,0)").alias("deviation"), "w",
        shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component. ``deviation`` is null beyond a long."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = found.select(
        F.col("row.vec_id").alias("vec_id"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        "explained", "identity_error", F.posexplode("w").alias("k", "whitened"),
    )
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("k")).alias("explained"), "identity_error",
    )
