"""Masked pseudo-likelihood: a window network that sees both sides predicts every token."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from citeflow.llm.tables import Scratch, text_or_empty

SIDE, WIDTH = 2, 16  # words seen on each side, size of the hidden layer
PLACES = 2 * SIDE
STEPS, RATE = 8, 0.1  # step s trains on the places s, s + STEPS, ... of every text; all steps together on every word
SHARED = 0.4  # how far the places around a word count as independent before training
SMOOTH = 20.0  # words of context added, dealt out like the classes
BATCH = CHUNK = 2048  # words trained on, and scored, at once
BLOCK = 64  # rows of one product of matrices: so few that the library starts no threads beside the task's
SLICE = 1 << 16  # words whose windows are laid out at once: up to twice as many; a multiple of STEPS
UNIT = 1 << 24  # sums are of whole multiples of 1/UNIT, so they have no order
MEMO = 300_000
LISTED = 100_000  # counts of at most so many words go to every task


def half_for(types: int) -> int:
    """Words with a class of their own, and classes by ending: grows with the number of different words."""
    return max(WIDTH, round(3 * math.log2(types + 2)))


class Classes(dict):
    """Class of a word: one of its own for the most frequent ones, that of the last two bytes for the others, which
    are remembered for a while."""

    def __init__(self, frequent: list[bytes], half: int):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.half, self.base = half, dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
            self.update(self.base)
        found = self[word] = self.half + zlib.crc32(word[-2:]) % self.half
        return found

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint16, len(found))


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` in blocks of ``BLOCK``, and those left over."""
    whole = len(x) // BLOCK * BLOCK
    return x[:whole].reshape(-1, BLOCK, x.shape[1]), x[whole:]


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` block by block."""
    whole, rest = _blocks(x)
    return np.concatenate([(whole @ w).reshape(-1, w.shape[1]), rest @ w])


def product_of_columns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` block by block."""
    (a, a_rest), (b, b_rest) = _blocks(x), _blocks(y)
    return (a.transpose(0, 2, 1) @ b).sum(0) + a_rest.T @ b_rest


@dataclass
class Network:
    """Hidden layer: tanh of the sum of an embedding for each place in the window; then a softmax over classes."""

    e: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: np.ndarray

    @staticmethod
    def shapes(classes: int) -> dict[str, tuple[int, ...]]:
        return {"e": (PLACES, classes + 1, WIDTH), "b": (WIDTH,), "w": (WIDTH, classes), "c": (classes,)}

    @classmethod
    def from_counts(cls, met: np.ndarray) -> Network:
        """Start from ``met[place, x, c]``, how often class x was at that place around class c: the leading directions of
        the logarithm of how much more often than by chance."""
        classes = met.shape[2]
        share = met[0].sum(0) + 1.0
        share /= share.sum()
        seen = met.sum(2, keepdims=True)
        more = np.log((met + SMOOTH * share) / (seen + SMOOTH)) - np.log(share)
        rows, cols = np.sqrt(seen + 1), np.sqrt(share)
        u, s, v = np.linalg.svd((more * rows * cols).reshape(-1, classes), full_matrices=False)
        e = SHARED * (u[:, :WIDTH] * s[:WIDTH]).reshape(PLACES, classes + 1, WIDTH) / rows
        # Small enough for tanh to be nearly straight.
        scale = max(1e-6, 4 * np.sqrt((e * e * seen).sum() / max(1.0, seen.sum()) / WIDTH))
        return cls(*(x.astype(np.float32) for x in (e / scale, np.zeros(WIDTH), v[:WIDTH] / cols * scale, np.log(share))))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.e, self.b, self.w, self.c)]).astype(np.float64)

    @classmethod
    def of(cls, flat: np.ndarray, classes: int) -> Network:
        parts, at = {}, 0
        for k, shape in cls.shapes(classes).items():
            n = int(np.prod(shape))
            parts[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return cls(**parts)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.b + self.e[0][around[:, 0]]
        for place in range(1, PLACES):
            total += self.e[place][around[:, place]]
        return np.tanh(total)

    def log_chances(self, around: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each class ``of`` between the classes ``around`` it."""
        scores = product(self.hidden(around), self.w)
        scores += self.c
        scores -= scores.max(axis=1, keepdims=True)
        hit = scores[np.arange(len(of)), of]
        return hit - np.log(np.exp(scores, out=scores).sum(axis=1))

    def gradient(self, around: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Gradient of minus the sum of ``log_chances`` by all weights, in the order of ``flat``."""
        h = self.hidden(around)
        scores = product(h, self.w)
        scores += self.c
        scores -= scores.max(axis=1, keepdims=True)
        chance = np.exp(scores, out=scores)
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(of)), of] -= 1
        back = product(chance, self.w.T) * (1 - h * h)
        rows = self.e.shape[1]
        cells = ((around + np.arange(PLACES) * rows)[:, :, None] * WIDTH + np.arange(WIDTH)).ravel()
        e = np.bincount(cells, np.repeat(back, PLACES, axis=0).ravel(), self.e.size)
        return np.concatenate([e, back.sum(0, dtype=np.float64), product_of_columns(h, chance).ravel(), chance.sum(0, dtype=np.float64)])


def padded(ids: np.ndarray, edge: int) -> bytes:
    """A text's classes between marks for what lies beyond it."""
    ends = np.full(SIDE, edge, np.uint16)
    return np.concatenate([ends, ids, ends]).tobytes()


def windows(texts: list[bytes], step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``around``, ``of`` and the number of the text, for every word of padded texts, or for those that ``step`` trains on."""
    joined = np.frombuffer(b"".join(texts), np.uint16).astype(np.int64)
    sizes = np.array([len(t) // 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - SIDE
    inside = (place >= 0) & (place < sizes[owner] - PLACES)
    if step is not None:
        inside &= place % STEPS == step
    at = np.flatnonzero(inside)
    around = np.stack([joined[at + p] for p in range(-SIDE, SIDE + 1) if p], axis=1)
    return around, joined[at], owner[at]


def slices(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Padded texts in lists of a bounded number of words, with the number of each one's text. A long text comes in
    pieces, each between the classes next to it; they begin at multiples of ``STEPS``, so a word keeps its step."""
    part, owners, held = [], [], 0
    for i, text in enumerate(texts):
        n = len(text) // 2 - PLACES
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            part.append(text[2 * a : 2 * (b + PLACES)])
            owners.append(i)
            held += b - a
            if held >= SLICE:
                yield part, owners
                part, owners, held = [], [], 0
    if part:
        yield part, owners


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case, wherever its words are needed."""
    return text.lower().encode().split()


def counted(docs: DataFrame) -> DataFrame:
    """``w, n``: every word of all documents and how often it is there. Tasks count on their own first."""

    def rows(seen: Counter) -> pa.RecordBatch:
        named = pa.array([w.decode() for w in seen], pa.string())
        return pa.RecordBatch.from_arrays([named, pa.array(seen.values(), pa.int64())], names=["w", "n"])

    def per_part(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) >= MEMO:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    partial = docs.select(text_or_empty().alias("_text")).mapInArrow(per_part, "w string, n long")
    counts = partial.groupBy("w").agg(F.sum("n").alias("n"))
    return Scratch(docs.sparkSession, "lm").write(counts, "words")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words at least as frequent as the least count that no more than ``most`` words reach. The count comes from
    how many words have each count, so no task sends more than its part of the result."""
    total, least = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return []
    return [(r["w"].encode(), r["n"]) for r in counts.where(F.col("n") >= least).collect()]


def class_sizes(counts: DataFrame, half: int, frequent: list[bytes]) -> np.ndarray:
    """By class of endings, the count of its words, each seen once more than it was, with one for a word never seen."""
    own = [w.decode() for w in frequent]
    rest = counts.where(~F.col("w").isin(own)) if own else counts
    coded = F.col("w").cast("binary")
    ending = F.substring(coded, F.greatest(F.lit(1), F.length(coded) - 1), F.lit(2))
    sums = rest.groupBy((F.crc32(ending) % half).alias("b")).agg(F.sum(F.col("n") + 1).alias("n"))
    sizes = np.ones(half)
    for r in sums.collect():
        sizes[r["b"]] += r["n"]
    return sizes


@dataclass(frozen=True)
class Model:
    half: int
    frequent: list[bytes]
    weights: np.ndarray
    counts: DataFrame
    sizes: np.ndarray


def _encoded(docs: DataFrame, frequent: list[bytes], half: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def per_part(batches):
        classes = Classes(shared.value, half)
        for batch in batches:
            ids = [padded(classes.of(words_of(t)), 2 * half) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return docs.select(text_or_empty().alias("_text")).mapInArrow(per_part, "ids binary")


def _sums(encoded: DataFrame, size: int, per_batch) -> np.ndarray:
    """Sum over all texts of what ``per_batch`` yields for lists of them, ``size`` whole numbers each. A task sends its
    sum as rows, which meet by number: the driver gets one row for each."""

    def per_part(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in per_batch(batch.column(0).to_pylist()):
                total += part
        some = np.flatnonzero(total)
        whole = np.rint(total[some]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(whole)], names=["i", "v"])

    found = np.zeros(size)
    for r in encoded.mapInArrow(per_part, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        found[r["i"]] = float(r["v"])
    return found


def _met(texts: list[bytes], classes: int) -> Iterator[np.ndarray]:
    for part, _ in slices(texts):
        around, of, _ = windows(part)
        cells = (np.arange(PLACES) * (classes + 1) + around) * classes + of[:, None]
        yield np.bincount(cells.ravel(), minlength=PLACES * (classes + 1) * classes)


def _gradients(texts: list[bytes], net: Network, step: int) -> Iterator[np.ndarray]:
    """Gradient of the step's words, and their number, in units."""
    for part, _ in slices(texts):
        around, of, _ = windows(part, step)
        for a in range(0, len(of), BATCH):
            found = net.gradient(around[a : a + BATCH], of[a : a + BATCH])
            yield np.append(found, len(of[a : a + BATCH])) * UNIT


def fit(docs: DataFrame) -> Model:
    """Train on all of ``docs(text)``.

    Classes and start follow from counts over all documents. Then come ``STEPS`` steps; in each, all tasks compute the
    gradient of the same weights, and its sum moves them once. So the model does not depend on how rows are split.
    """
    counts = counted(docs)
    half = half_for(counts.count())
    top = counts.orderBy(F.desc("n"), "w").limit(half).collect()
    frequent, classes = [r["w"].encode() for r in top], 2 * half
    scratch = Scratch(docs.sparkSession, "lm")
    encoded = scratch.write(_encoded(docs, frequent, half), "encoded")
    met = _sums(encoded, PLACES * (classes + 1) * classes, lambda texts: _met(texts, classes))
    weights = Network.from_counts(met.reshape(PLACES, classes + 1, classes)).flat()
    # Each group of weights moves by a part of its own size.
    parts = np.split(weights, np.cumsum([int(np.prod(s)) for s in Network.shapes(classes).values()])[:-1])
    rate = np.concatenate([np.full(len(p), RATE * min(0.3, np.sqrt((p * p).mean()) + 0.01)) for p in parts])
    drift, spread = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(STEPS):
        net = Network.of(weights, classes)
        found = _sums(encoded, len(weights) + 1, lambda texts, net=net, step=step: _gradients(texts, net, step))
        if not found[-1]:
            continue
        g = found[:-1] / found[-1]
        drift, spread = 0.7 * drift + 0.3 * g, 0.9 * spread + 0.1 * g * g
        toward = drift / (1 - 0.7 ** (step + 1)) / (np.sqrt(spread / (1 - 0.9 ** (step + 1))) + 1e-5)
        weights = weights - rate * (1 - step / STEPS) * toward
    scratch.drop("encoded")
    return Model(half, frequent, weights, counts, class_sizes(counts, half, frequent))


def class_sums(texts: list[bytes], net: Network) -> np.ndarray:
    """By padded text, the sum of the log-probabilities of its words' classes."""
    sums = np.zeros(len(texts))
    for part, owners in slices(texts):
        around, of, owner = windows(part)
        for a in range(0, len(of), CHUNK):
            found = net.log_chances(around[a : a + CHUNK], of[a : a + CHUNK])
            some = np.bincount(owner[a : a + CHUNK], found.astype(np.float64), len(part))
            np.add.at(sums, owners, some)
    return sums


def token_score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` of every row of ``docs(doc_id, text, ...)``: the sum of the
    log-probability of each word given the words on both sides, and that by word. A word's probability is that of its
    class, times its share of the class by the counts of all documents; a word with a class of its own is its class.

    Words are counted once more than they were seen, and a word never seen once. The counts of the most frequent words
    go to every task; all other words meet theirs in a join.

    Defined cases: a null, empty or blank text has no words, the sum 0 and no value by word. doc_id may be null or
    repeated. No rows give no rows. Other columns are not looked at.
    """
    spark, half = docs.sparkSession, model.half
    listed = {w: math.log(n + 1) for w, n in most_frequent(model.counts, LISTED)}
    shared = spark.sparkContext.broadcast((model.frequent, model.weights, listed, np.log(model.sizes)))
    frame = docs.select("doc_id", text_or_empty().alias("_text"))
    schema = frame.drop("_text").schema.add("n_tokens", "long").add("_sum", "double").add("_rest", ArrayType(StringType()))

    def per_part(batches):
        named, flat, known, sizes = shared.value
        classes, net = Classes(named, half), Network.of(flat, 2 * half)
        # A word of its own is all of its class.
        off = np.append(np.zeros(half), sizes)
        logs = {**known, **dict.fromkeys(named, 0.0)}
        for batch in batches:
            coded, lengths, within, rests = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                ids = classes.of(found)
                share = np.array([logs.get(w, np.nan) for w in found], np.float64)
                unknown = np.isnan(share)
                rests.append([found[i].decode() for i in np.flatnonzero(unknown)])
                within.append(share[~unknown].sum() - off[ids].sum())
                lengths.append(len(found))
                coded.append(padded(ids, 2 * half))
            sums = class_sums(coded, net) + np.array(within)
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(sums), pa.array(rests, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # Written once: the row numbers are fixed from here on.
    scored = frame.mapInArrow(per_part, schema).withColumn("_row", F.monotonically_increasing_id())
    scored = Scratch(spark, "lm").write(scored, "scored")
    rest = scored.select("_row", F.explode("_rest").alias("w")).join(model.counts, "w")
    more = rest.groupBy("_row").agg(F.sum(F.log(F.col("n") + 1)).alias("_more"))
    total = F.round(F.col("_sum") + F.coalesce("_more", F.lit(0.0)), 3)
    found = scored.drop("_rest").join(more, "_row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return found.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.round(F.col("log_likelihood") / F.col("n_tokens"), 6)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_score(docs, fit(docs))
