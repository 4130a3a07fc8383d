"""Exact Jaccard join of documents on word 5-shingles, with signature trees.

How a link can't be missed: of two sets with a Jaccard similarity of 0.8, each shares at least 80% of
its own shingles with the other. Under one order of all shingles, the first 20% and one more of both
sets (their prefixes) therefore hold a common shingle. Documents are grouped by the shingles of
their prefixes, and only documents of one group are compared. The order puts the shingles that very
many documents share last; any order is exact, this one keeps groups small.

Within a group, a signature tree (bitmaps of the shingles, OR-combined upwards, with size ranges) is
walked against itself; a pair of nodes is left as soon as the most its documents could have in common
is too little, or when all of them already hang together. What is left is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeflow.llm.components import components
from citeflow.llm.tables import Scratch, row_key

SHINGLE = 5
PERCENT = 80
# A shingle counts as frequent from so many prefixes on. The list of frequent shingles is broadcast:
# at most HEAVY_LIST of the most frequent ones, 8 bytes each.
HEAVY_FROM, HEAVY_LIST = 4, 2_000_000
# Bytes of text hashed at once in a task.
SLICE_BYTES = 1 << 21
FANOUT = 8
# Groups of more rows are compared as pairs of blocks of about so many, each pair a group of its own.
BLOCK = 8192

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(256, dtype=np.uint64), 7)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACE = _mixed(np.arange(SHINGLE, dtype=np.uint64), 3) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that lie end to end in ``data``, and the text each is in."""
    gap = _GAP[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = starts_of[(starts_of > 0) & (starts_of < len(data))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.where(gap, np.uint64(0), _BYTE[data]) * up[:-1], dtype=np.uint64, out=total[1:])
        hashed = (total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)
    return _mixed(hashed, 1), np.searchsorted(starts_of, begin, "right") - 1


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text. Null and blank texts have none; a text of fewer
    than five words has one, its whole sequence of words."""
    raw = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) <= SLICE_BYTES):
            size += len(raw[to])
            to += 1
        yield from _sets_of(raw[at:to])
        at = to


def _sets_of(raw: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        yield from (np.empty(0, np.uint64) for _ in raw)
        return
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
    hashed, of = _word_hashes(data, starts)
    count = len(hashed)
    with np.errstate(over="ignore"):
        shingles = np.zeros(max(0, count - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            shingles += hashed[j : count - SHINGLE + 1 + j] * _PLACE[j] if len(shingles) else shingles
        shingles = _mixed(shingles, 2)
        lower = np.searchsorted(of, np.arange(len(raw)), "left")
        upper = np.searchsorted(of, np.arange(len(raw)), "right")
        for a, b in zip(lower, upper, strict=True):
            if b - a >= SHINGLE:
                yield np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                yield _mixed(np.array([(hashed[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)]), 10 + int(b - a))
            else:
                yield np.empty(0, np.uint64)


def _prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _prefix(found: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: the others by value, then the frequent ones by value."""
    need = _prefix_length(len(found))
    if not len(heavy):
        return found[:need]
    reach = min(len(found), need + need // 2 + 8)
    while True:
        part = found[:reach]
        frequent = heavy[np.minimum(np.searchsorted(heavy, part), len(heavy) - 1)] == part
        if (~frequent).sum() >= need:
            return part[~frequent][:need]
        if reach == len(found):
            return np.concatenate([part[~frequent], part[frequent]])[:need]
        reach = min(len(found), reach * 2)


def _bitmap(found: np.ndarray) -> bytes:
    """At least four bits a shingle, a power of two of them."""
    bits = min(1 << 20, max(256, 1 << int(4 * max(1, len(found)) - 1).bit_length()))
    held = np.zeros(bits, bool)
    held[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _frequent(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """The shingles that most prefixes share, counted over all documents."""

    def prefixes(batches):
        for batch in batches:
            for found in shingle_sets(batch.column(0)):
                if len(found):
                    part = found[: _prefix_length(len(found))]
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64))], ["h"])

    def gathered(batches, rows=200_000):
        held, size = [], 0
        for batch in prefixes(batches):
            held.append(batch.column(0))
            size += len(batch)
            if size >= rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(held)], ["h"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(held)], ["h"])

    counts = docs.select("text").mapInArrow(gathered, "h long").groupBy("h").count()
    top = counts.where(F.col("count") >= HEAVY_FROM).orderBy(F.desc("count"), "h").limit(HEAVY_LIST)
    found = scratch.write(top.select("h"), "frequent").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    scratch.drop("frequent")
    return np.sort(found)


SIGNATURES = "doc_id long, _ka long, _kb long, n long, s1 long, s2 long, mask binary, prefix array<long>"


def signatures(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Size, 128-bit name of the set, bitmap and prefix of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(heavy)

    def per_batch(batches):
        for batch in batches:
            n, s1, s2, masks, prefixes = [], [], [], [], []
            for found in shingle_sets(batch.column(3)):
                n.append(len(found))
                with np.errstate(over="ignore"):
                    s1.append(_mixed(found, 21).sum(dtype=np.uint64))
                    s2.append(_mixed(found, 22).sum(dtype=np.uint64))
                masks.append(_bitmap(found) if len(found) else None)
                prefixes.append(_prefix(found, shared.value) if len(found) else found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()),
                 pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                 pa.array(masks, pa.binary()), _lists(prefixes)],
                names=[c.split()[0] for c in SIGNATURES.split(", ")],
            )

    return docs.select("doc_id", *row_key(), "text").mapInArrow(per_batch, SIGNATURES)


# ---- signature trees ------------------------------------------------------------------------------


def _folded(mask: bytes, size: int) -> np.ndarray:
    """A bitmap cut down to ``size`` bytes by OR-ing its parts, which only loosens the bound."""
    return np.bitwise_or.reduce(np.frombuffer(mask, np.uint8).reshape(-1, size), axis=0)


class SignatureTree:
    """Documents in leaves, nodes of ``FANOUT`` above them: OR of the bitmaps, range of sizes, the most
    shingles that share a bit in one document, and the components below."""

    def __init__(self, masks: np.ndarray, sizes: np.ndarray, roots: np.ndarray, leaves_only: bool = False):
        crowded = sizes - np.bitwise_count(masks).sum(axis=1, dtype=np.int64)
        self.levels = [(masks, sizes, sizes, crowded, roots, roots)]
        while not leaves_only and len(self.levels[-1][1]) > 1:
            m, low, high, most, r0, r1 = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                np.maximum.reduceat(most, cut), np.minimum.reduceat(r0, cut), np.maximum.reduceat(r1, cut),
            ))

    @classmethod
    def leaves(cls, masks: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> SignatureTree:
        """Without nodes above, for groups that fit a leaf."""
        return cls(masks, sizes, roots, leaves_only=True)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents that may link and are not in one component; a walk of the tree against itself."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            keep = self._may_link(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = len(self.levels[level - 1][1])
            step = np.arange(FANOUT)
            left = np.broadcast_to((a[:, None] * FANOUT + step)[:, :, None], (len(a), FANOUT, FANOUT)).ravel()
            right = np.broadcast_to((b[:, None] * FANOUT + step)[:, None, :], (len(a), FANOUT, FANOUT)).ravel()
            ok = (left < below) & (right < below) & ((left < right) | ((left == right) & (level > 1)))
            left, right = left[ok], right[ok]
            for at in range(0, len(left), 4096):
                stack.append((level - 1, left[at : at + 4096], right[at : at + 4096]))

    def _may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        masks, low, high, most, r0, r1 = self.levels[level]
        keep = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        keep &= ~((r0[a] == r1[a]) & (r0[b] == r1[b]) & (r0[a] == r0[b]))
        at = np.flatnonzero(keep)
        if len(at):
            x, y = a[at], b[at]
            shared = np.bitwise_count(masks[x] & masks[y]).sum(axis=1, dtype=np.int64)
            most_common = shared + np.minimum(most[x], most[y])
            # |x and y| >= 0.8 |x or y|  <=>  180 |x and y| >= 80 (|x| + |y|)
            keep[at] = (100 + PERCENT) * most_common >= PERCENT * (low[x] + low[y])
        return keep


class _Group:
    """Rows of one group, or of many groups in a row, as arrays."""

    def __init__(self, table: pa.Table):
        self.h, self.part, self.row, self.n, self.root, self.band = (
            table.column(c).to_numpy() for c in ("h", "part", "row", "n", "root", "band")
        )
        self.own = self.band == self.part
        self.masks = table.column("mask").to_pylist()

    def tree_pairs(self, a: int, b: int) -> np.ndarray:
        """Candidates among the rows from a to b, by a signature tree. Rows come ordered by component and size."""
        size = min(map(len, self.masks[a:b]))
        masks = np.stack([_folded(m, size) for m in self.masks[a:b]]).view(np.uint64)
        tree = SignatureTree(masks, self.n[a:b], self.root[a:b])
        found = [np.stack([x, y], axis=1) for x, y in tree.pairs()]
        return a + np.concatenate(found) if found else np.empty((0, 2), np.int64)

    def leaf_pairs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Candidates within many groups that fit a leaf each, tested side by side."""
        left, right = [], []
        for i in range(FANOUT):
            for j in range(i + 1, FANOUT):
                fits = begin + j < end
                left.append(begin[fits] + i)
                right.append(begin[fits] + j)
        x, y = np.concatenate(left), np.concatenate(right)
        keep = (self.root[x] != self.root[y]) & (100 * self.n[x] >= PERCENT * self.n[y]) & (100 * self.n[y] >= PERCENT * self.n[x])
        x, y = x[keep], y[keep]
        width = np.array([len(m) for m in self.masks], np.int64)
        out = []
        for size in np.unique(np.minimum(width[x], width[y])):
            at = np.flatnonzero(np.minimum(width[x], width[y]) == size)
            for cut in range(0, len(at), max(1, (1 << 22) // size)):
                part = at[cut : cut + max(1, (1 << 22) // size)]
                used, place = np.unique(np.concatenate([x[part], y[part]]), return_inverse=True)
                masks = np.stack([_folded(self.masks[k], size) for k in used]).view(np.uint64)
                tree = SignatureTree.leaves(masks, self.n[used], self.root[used])
                ok = tree._may_link(0, place[: len(part)], place[len(part) :])
                out.append(np.stack([x[part][ok], y[part][ok]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    def candidates(self) -> np.ndarray:
        """Pairs of row numbers. Of the two size bands in a group, the upper one is compared within itself in its own
        group."""
        new = np.flatnonzero((np.diff(self.h) != 0) | (np.diff(self.part) != 0)) + 1
        begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(self.h)]])
        small = end - begin <= FANOUT
        pairs = [self.leaf_pairs(begin[small], end[small])] if small.any() else []
        pairs += [self.tree_pairs(a, b) for a, b in zip(begin[~small], end[~small], strict=True)]
        found = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        found = found[self.own[found[:, 0]] | self.own[found[:, 1]]]
        ends = self.row[found]
        return np.unique(np.sort(ends, axis=1), axis=0)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the groups that follow each other in a partition. A group that goes on in the next batch
    waits for its end."""

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _Group(table).candidates()
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        h, part = batch.column("h").to_numpy(), batch.column("part").to_numpy()
        last = np.flatnonzero((h != h[-1]) | (part != part[-1]))
        start = last[-1] + 1 if len(last) else 0
        if held and (start or (held[-1].column("h")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (h[0], part[0])):
            yield from pairs_of(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        elif start:
            yield from pairs_of(pa.Table.from_batches([batch.slice(0, start)]))
        held.append(batch.slice(start))
    if held:
        yield from pairs_of(pa.Table.from_batches(held))


# ---- the join -------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, compared in full. What is shuffled are texts, which pack
    far better than sets of hashes."""
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = rows.select("row", "_ka", "_kb").join(ends, "row")
    # Equal rows of the documents are one here.
    again = F.row_number().over(W.partitionBy("_ka", "_kb").orderBy("_ka"))
    found = docs.select(*row_key(), "text").join(wanted, ["_ka", "_kb"]).withColumn("again", again)
    texts = scratch.write(found.where("again = 1").select("row", "text"), f"{name}-texts")

    def per_batch(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + PERCENT) * common >= PERCENT * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    out = scratch.write(both.mapInArrow(per_batch, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, _ka, _kb`` (the row's key),
    ``n_shingles`` and ``component_id``, the least doc_id reachable by links, its own included.

    Defined cases: null, empty and blank texts have no shingles and no links. Rows with one doc_id are
    separate rows; equal rows link like any equal texts. A null doc_id names no component: a component
    of nothing else is null. No rows give no rows. Other columns are not looked at.

    Equal sets are found by a 128-bit name and enter the join once, whatever their number.
    """
    return _grouped(docs).drop("root")


def _grouped(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = signatures(docs, _frequent(docs, scratch)).withColumn("row", F.monotonically_increasing_id())
    # Written once: the row numbers are fixed from here on.
    rows = scratch.write(made, "signatures")
    name = ["n", "s1", "s2"]
    classes = rows.where("n > 0").groupBy(*name).agg(F.min("row").alias("of"))
    of = scratch.write(
        rows.select("row", "doc_id", "_ka", "_kb", *name).join(classes, name, "left")
        .select("row", "doc_id", "_ka", "_kb", "n", F.coalesce("of", "row").alias("of")), "rows"
    )
    heads = rows.join(of.where("row = of AND n > 0").select("row"), "row", "left_semi")

    shared = heads.select("row", "n", F.explode("prefix").alias("h")).repartition("h")
    seen = shared.groupBy("h").agg(
        F.count("*").alias("c"), F.min("row").alias("hub"), F.max("row").alias("last"),
        F.bit_xor(F.xxhash64("row")).alias("x"),
    ).where("hub < last")
    # Groups of the same documents are one group.
    groups = seen.groupBy("c", "hub", "last", "x").agg(F.min("h").alias("h"), F.count("*").alias("w"))
    members = scratch.write(shared.join(groups.select("h", "hub", "w", "c"), "h"), "members")

    # First the groups' least rows: each row is compared with the one it meets in most groups. That
    # joins nearly all of a large cluster without comparing its members with each other.
    met = members.where("row <> hub").groupBy("row", "hub").agg(F.sum("w").alias("w"))
    best = met.groupBy("row").agg(F.max_by("hub", F.struct("w", -F.col("hub"))).alias("a"))
    first = scratch.write(best.select("a", F.col("row").alias("b")), "first")
    links = _verified(first, docs, of, scratch, "links1")
    found = scratch.write(components(links, scratch, "one"), "found1")

    # Then, completely: all groups that still hold documents of several components.
    rooted = members.join(found.withColumnRenamed("node", "row"), "row", "left").select(
        "h", "c", "row", F.coalesce("component", "row").alias("root")
    )
    mixed = rooted.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    # Sizes of linked sets differ by at most a quarter: a band meets itself and the next one.
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")
    open_rows = (
        _blocks(rooted.join(mixed.select("h"), "h", "left_semi"))
        .join(heads.select("row", "n", "mask"), "row")
        .withColumn("band", band)
        .withColumn("part", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    )
    grouped = open_rows.select("h", "part", "band", "root", "n", "row", "mask").repartition("h", "part")
    walked = grouped.sortWithinPartitions("h", "part", "root", "n", "row").mapInArrow(_walk, "a long, b long").distinct()
    second = scratch.write(
        walked.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"),
        "second",
    )
    more = _verified(second, docs, of, scratch, "links2")
    all_links = links.unionByName(more)
    final = scratch.write(components(all_links, scratch, "two"), "found2")

    placed = of.join(final.select(F.col("node").alias("of"), "component"), "of", "left").select(
        "doc_id", "_ka", "_kb", "n", F.coalesce("component", "of").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    scratch.drop("signatures", "members", "first", "links1", "found1", "second", "links2")
    return placed.join(least, "root").select(
        "doc_id", "_ka", "_kb", F.col("n").alias("n_shingles"), "component_id", "root"
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows(h, c, row, ...)`` with groups of more than BLOCK rows (``c``) split: any two rows of a group still meet in one,
    which is named by another ``h`` for every two blocks and holds about two blocks of rows."""
    k = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), F.col("_k")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: j != F.col("_own"))
    names = F.transform(others, lambda j: F.xxhash64("h", F.least(j, "_own"), F.greatest(j, "_own")))
    split = rows.withColumn("_k", k).withColumn("_own", own)
    split = split.withColumn("h", F.explode(F.when(F.col("_k") > 1, names).otherwise(F.array("h"))))
    return split.drop("_k", "_own", "c")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the least doc_id (null
    last; ties by the row's key). Documents without links stay, those without words included."""
    # Without words a row is a group of its own, also among equal rows.
    found = _grouped(docs).withColumn("_blank", F.col("n_shingles") == 0)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_ka", "_kb", "_blank")
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select("k._ka", "k._kb", "k._blank").distinct()
    staying = docs.select(F.struct("*").alias("row"), *row_key()).join(kept, ["_ka", "_kb"])
    again = F.row_number().over(W.partitionBy("_ka", "_kb").orderBy("_ka"))
    return staying.withColumn("_again", again).where("_blank OR _again = 1").select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
