"""Fuzzy line dedup: MinHash of character shingles, banding, exact verification, union-find."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.components import components
from citeflow.llm.quality import BLANK, let
from citeflow.llm.tables import Scratch, row_key

SHINGLE = 9  # characters
PERCENT = 80
# Ten bands of three values: two lines at 0.8 meet in a band with probability 0.9992.
BANDS, ROWS = 10, 3
# A byte of each value is a line's sketch. Lines that share a band agree in half of all values but for 3 in a million pairs
# at 0.8; lines that only met by chance do not, so their texts are not compared.
AGREE = BANDS * ROWS // 2
# Buckets of up to so many lines are compared pair by pair by sketches; larger ones are cut first, by pairs of further
# values, and what is still larger by another such pair. Two lines at 0.8 share two pairs but for 4 in 100,000.
MANY, CUTS, TURNS = 32, (BANDS - 1) * ROWS // 2, 2
# Lines with more candidates than that, and those in buckets that stay larger, are crowded: they are compared by prefixes.
FEW = 16
_SKETCH = [f"s{i}" for i in range((BANDS * ROWS + 7) // 8)]
# The list of frequent shingles of crowded lines is broadcast: at most so many, seen in so many lines at least.
HEAVY_FROM, HEAVY_LIST = 4, 500_000
GROWTH = 1.05  # from one class of sizes to the next
# Rounds that join crowded lines by hubs, until one joins less than a twentieth of the components: hubs a line is
# compared with in a round, and rounds at most. What they leave apart is compared completely.
NEAREST, ROUNDS = 3, 4
_STEP, _WIDTH = 4, 4 * SHINGLE  # bytes of UTF-32


def _masks() -> list[int]:
    draw = random.Random(20_240_229)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(BANDS * ROWS // 2)]


def _norm(line: Column) -> Column:
    """What two lines are compared by: lower case, without blanks at the ends."""
    return F.lower(F.btrim(line, F.lit(BLANK)))


def _last(code: Column) -> Column:
    """Byte (from 1) of the last shingle of a line in UTF-32; a short line is one shingle."""
    return F.greatest(F.lit(1), F.length(code) - (_WIDTH - 1))


def shingles(line: Column) -> Column:
    """Distinct 64-bit character shingles of a line."""
    return let(
        F.encode(line, "UTF-32"),
        lambda code: F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), _last(code), F.lit(_STEP)),
                lambda i: F.xxhash64(F.substring(code, i, F.lit(_WIDTH))),
            )
        ),
    )


def _signatures(lines: DataFrame) -> DataFrame:
    """``(id, m0, m1, ...)``: the least value of each permutation over a line's shingles.

    One row a quarter of the shingles is made and folded away at once by map-side aggregation; all
    shingles of a line lie in one partition, so what is shuffled is one row a line. Each constant mixes the 64-bit
    hash anew, and the two halves of the mixed value are two permutations.
    """
    code = lines.select("id", F.encode("norm", "UTF-32").alias("code")).withColumn("last", _last(F.col("code")))
    at = code.select("id", "code", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * _STEP))).alias("i"))
    four = [F.least(F.col("i") + _STEP * j, F.col("last")) for j in range(4)]
    hashed = at.select("id", *[F.xxhash64(F.substring(F.col("code"), p, F.lit(_WIDTH))).alias(f"h{j}") for j, p in enumerate(four)])
    mixed = [[F.xxhash64(F.col(f"h{j}").bitwiseXOR(F.lit(c))) for j in range(4)] for c in _masks()]
    halves = [f for m in mixed for f in (m, [F.shiftleft(x, 32) for x in m])]
    return hashed.groupBy("id").agg(*[F.min(F.least(*f)).alias(f"m{i}") for i, f in enumerate(halves)])


def _bands() -> Column:
    """The keys of a signature's bands; the last four bits of each are the number of the band, the four before them empty."""
    hashed = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return F.array(*[h.bitwiseAND(F.lit(-256)).bitwiseOR(F.lit(b)) for b, h in enumerate(hashed)])


def _sketch() -> list[Column]:
    """A byte of each value of a signature, eight to a number. Of every second value only the upper half is filled."""
    held = [F.shiftrightunsigned(f"m{i}", 32 * (i % 2)).bitwiseAND(F.lit(255)) for i in range(BANDS * ROWS)]
    eights = [[F.shiftleft(v, 8 * j) for j, v in enumerate(held[8 * i : 8 * i + 8])] for i in range(len(_SKETCH))]
    return [reduce(Column.bitwiseOR, e).alias(c) for c, e in zip(_SKETCH, eights, strict=True)]


def _agreeing(x: str, y: str) -> Column:
    """The number of values in which the sketches of ``x`` and ``y`` agree."""

    def unlike(name: str) -> Column:
        # The lowest bit of a byte becomes the union of its bits.
        bits = F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}"))
        for n in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101_0101_0101_0101)))

    return F.lit(BANDS * ROWS) - reduce(Column.__add__, map(unlike, _SKETCH))


def _cut(crowded: DataFrame) -> DataFrame:
    """``(key, c, id, root)`` of the lines of large buckets ``(key, id, root, sketch)`` by buckets that also share two
    further values, as far as these hold several components. Of a band's buckets of the same lines the one counts that
    leaves the most pairs to be cut by."""
    values = [F.shiftrightunsigned(f"s{i // 8}", 8 * (i % 8)).bitwiseAND(F.lit(255)) for i in range(BANDS * ROWS)]
    after = (F.col("key").bitwiseAND(F.lit(15)).cast("int") + 1) * ROWS  # the first value behind the band
    two = [[F.get("_v", F.pmod(after + (2 * j + k), F.lit(BANDS * ROWS))) for k in (0, 1)] for j in range(CUTS)]
    # In front of the band's number stands that of the first pair which has not been used.
    mark = [F.col("key").bitwiseAND(F.lit(15)).bitwiseOR(F.lit(16 * (j + 1))) for j in range(CUTS)]
    finer = F.array(*[F.xxhash64("key", *t).bitwiseAND(F.lit(-256)).bitwiseOR(m) for t, m in zip(two, mark, strict=True)])
    unused = F.slice(finer, F.shiftright("key", 4).bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(CUTS))
    cut = crowded.withColumn("_v", F.array(*values)).select("id", "root", F.explode(unused).alias("key"))
    cut = cut.where("key IS NOT NULL").repartition("key")
    held = cut.groupBy("key").agg(
        F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1"),
        F.min("id").alias("least"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("x"),
    ).where("r0 < r1")
    band, used = F.col("key").bitwiseAND(F.lit(15)), F.col("key").bitwiseAND(F.lit(240))
    mixed = held.groupBy("c", "least", "last", "x", band.alias("band")).agg(F.min_by("key", used).alias("key")).select("key", "c")
    return cut.join(mixed, "key").select("key", "c", "id", "root")


def _candidates(buckets: DataFrame) -> DataFrame:
    """``(a, b, ra, rb)``: pairs of a bucket ``(key, id, root, sketch)`` in two components whose sketches are alike."""
    dealt = buckets.select("key", "id", "root", *_SKETCH).repartition("key")
    met = dealt.alias("x").join(dealt.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
                                & (F.col("x.root") != F.col("y.root")) & (_agreeing("x", "y") >= AGREE))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def _similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingles are similar enough, compared in full."""
    left = lines.select(F.col("id").alias("a"), F.col("norm").alias("ta"))
    right = lines.select(F.col("id").alias("b"), F.col("norm").alias("tb"))
    # The sizes in characters bound the similarity from above only loosely for repetitive lines, so
    # nothing is left out by length.
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shingles(F.col("ta")).alias("sa"), shingles(F.col("tb")).alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + PERCENT) * common >= PERCENT * (F.size("sa") + F.size("sb"))).select("a", "b")


def _ranked(crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root, s, n, rare, central, cls)`` of ``crowd(id, norm, root)``: the shingles, frequent ones last, their
    number, how many come before the frequent ones, how frequent they are on the whole, and the class of sizes."""
    sets = scratch.write(crowd.select("id", "root", shingles(F.col("norm")).alias("s")), "crowd")
    # Any order is exact, so a list that is cut costs time only.
    heavy = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= HEAVY_FROM)
    heavy = heavy.orderBy(F.desc("c"), "h").limit(HEAVY_LIST)
    each = sets.repartition("id").select("id", "root", F.explode("s").alias("h")).join(F.broadcast(heavy), "h", "left")
    ranked = each.groupBy("id", "root").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)), "h"))).alias("s"),
        F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).cast("int").alias("rare"),
        F.avg(F.log(F.coalesce("c", F.lit(1)))).alias("central"),
    )
    ranked = ranked.select("id", "root", F.col("s.h").alias("s"), F.size("s").alias("n"), "rare", "central")
    ranked = ranked.withColumn("cls", F.floor(F.log("n") / math.log(GROWTH) + 1e-9).cast("int"))
    ranked = scratch.write(ranked, "ranked")
    scratch.drop("crowd")
    return ranked


def _hub_pairs(spots: DataFrame, moved: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of each line and the hubs it shares most shingles with, one hub a shingle.

    First, hubs are the lines whose shingles are the most frequent on the whole: they are in the middle of a cluster, so
    most of it is like them. Later hubs are drawn.
    """
    first = F.col("central") if turn == 0 else F.xxhash64("id", F.lit(turn)).cast("double")
    named = spots.join(moved, "root").select("h", "id", "n", "now", first.alias("first"))
    held = named.groupBy("h").agg(
        F.max(F.struct("first", "id", "n", "now")).alias("hub"), F.min("now").alias("r0"), F.max("now").alias("r1")
    )
    met = named.join(held.where("r0 < r1").select("h", "hub"), "h").where("now <> hub.now")
    met = met.where(100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n"))
    met = met.groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("w"))
    best = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "hub")), asc=False).alias("best"))
    return best.select(F.explode(F.slice("best", 1, NEAREST)).alias("e"), F.col("id").alias("b")).select(
        F.least("e.hub", "b").alias("a"), F.greatest("e.hub", "b").alias("b")
    ).distinct()


def _by_hubs(ranked: DataFrame, lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Components of ``ranked`` joined by rounds of comparisons with hubs: ``(root, now)``, and the links that did it.

    A round compares a line with ``NEAREST`` others at most, so it grows with the lines. It need not find every link.
    """
    front = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("int") + 1 - F.col("rare")
    shared = F.slice("s", F.col("rare") + 1, F.greatest(F.lit(0), front))
    spots = scratch.write(ranked.select("id", "root", "n", "central", F.explode(shared).alias("h")), "spots")
    roots = scratch.write(ranked.select("id", "root"), "roots")
    moved = scratch.write(roots.select("root").distinct().withColumn("now", F.col("root")), "moved")
    found, apart = [], moved.count()
    for turn in range(ROUNDS):
        asked = scratch.write(_hub_pairs(spots, moved, turn), f"hubs{turn}")
        links = scratch.write(_similar(asked, lines), f"near{turn}")
        found.append(links)
        at = roots.join(moved, "root").select("id", "now")
        ends = links.join(at.select(F.col("id").alias("a"), F.col("now").alias("ra")), "a")
        ends = ends.join(at.select(F.col("id").alias("b"), F.col("now").alias("rb")), "b")
        hung = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch, f"hung{turn}")
        after = moved.join(hung.withColumnRenamed("node", "now"), "now", "left")
        moved = scratch.write(after.select("root", F.coalesce("component", "now").alias("now")), f"moved{turn}")
        before, apart = apart, moved.select("now").distinct().count()
        if before - apart <= before // 20:
            break
    scratch.drop("spots", "roots")
    return moved, found


def _prefix_pairs(crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of ``crowd(id, norm, root)``, ranked or not, that may be similar and lie in two components; none
    that is similar is missing.

    Sets of n and m shingles with a similarity of 0.8 share at least o = 4/9 (n + m) of them, so under one order of all
    shingles the first n - o + 1 of one and the first m - o + 1 of the other hold a common one. The order puts
    frequent shingles last. Lines are dealt out by classes of sizes, which keeps o close to its exact value: what
    unlike lines of one template share then lies behind their prefixes.
    """
    ranked = crowd if "s" in crowd.columns else _ranked(crowd, scratch)
    apart = range(int(math.log(100 / PERCENT) / math.log(GROWTH)) + 2)

    def shared(m: Column) -> Column:
        """What a line has in common with a similar one of m shingles or more. Rounding never adds to it."""
        return F.ceil((F.col("n") + m) * (PERCENT / (100 + PERCENT)) * (1 - 1e-6)).cast("int")

    def entries(gap: Column, m: Column) -> Column:
        # An empty prefix means that no line of that class is near enough in size.
        return F.struct(gap.alias("gap"), F.slice("s", 1, F.greatest(F.lit(0), F.col("n") - shared(m) + 1)).alias("s"))

    def least(cls: Column) -> Column:
        return F.pow(F.lit(GROWTH), cls)

    def spread(name: str, parts: list[Column], cls: Column) -> DataFrame:
        out = ranked.select("id", "root", "n", "cls", F.explode(F.array(*parts)).alias("e"))
        out = out.select("id", "root", "n", "cls", "e.gap", F.posexplode("e.s").alias("at", "h"))
        return out.select("h", "gap", cls.alias("cls"), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "root", "n", "at")])

    lesser = [entries(F.lit(d), F.greatest(F.col("n"), least(F.col("cls") + d))) for d in apart]
    greater = [entries(F.lit(d), F.greatest(F.col("n") * (PERCENT / 100), least(F.col("cls") - d))) for d in apart]
    x, y = spread("x", lesser, F.col("cls")), spread("y", greater, F.col("cls") - F.col("gap"))
    met = x.join(y, ["h", "gap", "cls"]).where("x_root <> y_root AND (x_n < y_n OR x_n = y_n AND x_id < y_id)")
    # What is left from the common shingle on must do.
    rest = 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
    in_front = (100 + PERCENT) * (rest + F.least("x_at", "y_at")) >= PERCENT * (F.col("x_n") + F.col("y_n"))
    return met.where(in_front).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def line_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(l1, l2, component)`` for the lines that are like another one; l1 and l2 name the normalised line."""
    texts = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(_norm(F.col("line")).alias("norm"))
    distinct = texts.where("norm <> ''").distinct()
    # Written once: the numbers are fixed from here on.
    lines = scratch.write(distinct.withColumn("id", F.monotonically_increasing_id()), "lines", "zstd")
    signed = scratch.write(_signatures(lines).select("id", _bands().alias("keys"), *_sketch()), "signed")
    # Dealt out once, for the buckets and for their members; without the condition the join would add it to its own side only.
    banded = signed.select("id", F.explode("keys").alias("key")).where("key IS NOT NULL").repartition("key")

    held = banded.groupBy("key").agg(
        F.count("*").alias("c"), F.min("id").alias("hub"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("x")
    ).where("hub < last")
    buckets = held.groupBy("c", "hub", "last", "x").agg(F.min("key").alias("key"), F.count("*").alias("w"))
    members = scratch.write(banded.join(buckets.select("key", "hub", "w", "c"), "key"), "members")
    # Sketches and texts of the lines that meet another one: the only ones to be compared.
    ids = scratch.write(members.select("id").distinct(), "ids")
    sketches = scratch.write(signed.select("id", *_SKETCH).join(ids, "id", "left_semi"), "sketches")
    scratch.drop("signed")
    lines = scratch.write(lines.join(ids, "id", "left_semi").select("id", "norm"), "met", "zstd")
    scratch.drop("lines", "ids")

    # First the line each one shares most bands with among the buckets' least; that joins most of a
    # large cluster at one comparison a line.
    met = members.where("id <> hub").groupBy("id", "hub").agg(F.sum("w").alias("w"))
    best = met.groupBy("id").agg(F.max_by("hub", F.struct("w", -F.col("hub"))).alias("a"))
    first = best.select("a", F.col("id").alias("b")).join(sketches.alias("x"), F.col("a") == F.col("x.id"))
    first = first.join(sketches.alias("y"), F.col("b") == F.col("y.id")).where(_agreeing("x", "y") >= AGREE).select("a", "b")
    first = scratch.write(first, "first")
    links = scratch.write(_similar(first, lines), "links1")
    found = scratch.write(components(links, scratch, "one"), "found1")

    # Then, completely: every bucket that still holds lines of several components.
    rooted = members.select("key", "c", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "c", "id", F.coalesce("component", "id").alias("root")
    )
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    rooted = scratch.write(rooted.join(mixed.select("key"), "key", "left_semi"), "open")
    levels = [rooted]
    for turn in range(TURNS):
        levels.append(scratch.write(_cut(levels[-1].where(F.col("c") > MANY).join(sketches, "id")), f"cut{turn}"))
    small = reduce(DataFrame.unionByName, levels).where(F.col("c") <= MANY).join(sketches, "id")
    pairs = scratch.write(_candidates(small).distinct(), "pairs")
    # Crowded lines first join by hubs: otherwise all pairs of a large cluster that is still in pieces would be compared.
    ends = F.explode(F.array(*[F.struct(F.col(e).alias("id"), F.col(f"r{e}").alias("root")) for e in ("a", "b")]))
    often = pairs.select(ends.alias("e")).groupBy("e.id", "e.root").count().where(F.col("count") > FEW).select("id", "root")
    crowded = scratch.write(levels[-1].where(F.col("c") > MANY).select("id", "root").unionByName(often).distinct(), "crowded")
    ranked = _ranked(lines.join(crowded, "id"), scratch)
    moved, near = _by_hubs(ranked, lines, scratch)
    now, busy = moved.withColumnRenamed("now", "to"), crowded.select("id", F.lit(True).alias("busy"))
    for end in ("a", "b"):
        pairs = pairs.join(now.select(F.col("root").alias(f"r{end}"), F.col("to").alias(f"to_{end}")), f"r{end}", "left")
        pairs = pairs.join(busy.select(F.col("id").alias(end), F.col("busy").alias(f"busy_{end}")), end, "left")
    # Pairs of two crowded lines are among those by prefixes.
    pairs = pairs.where("(busy_a IS NULL OR busy_b IS NULL) AND coalesce(to_a, ra) <> coalesce(to_b, rb)").select("a", "b")
    merged = ranked.join(moved, "root").withColumn("root", F.col("now"))
    asked = pairs.unionByName(_prefix_pairs(merged, scratch)).distinct()
    apart = scratch.write(
        asked.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "apart"
    )
    more = scratch.write(_similar(apart, lines), "links2")
    all_found = components(reduce(DataFrame.unionByName, near, links.unionByName(more)), scratch, "two")
    named = lines.join(all_found.withColumnRenamed("node", "id"), "id").select(
        F.xxhash64("norm").alias("l1"), F.xxhash64(F.lit("b"), "norm").alias("l2"), "component"
    )
    named = scratch.write(named, "classes")
    scratch.drop("met", "members", "sketches", "first", "links1", "found1", "open", "pairs", "crowded")
    scratch.drop("ranked", "moved", "apart", "links2", *[f"cut{turn}" for turn in range(TURNS)])
    scratch.drop(*[f"{k}{turn}" for turn in range(len(near)) for k in ("hubs", "near", "moved")])
    return named


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, which keeps any names apart), ``text`` with only one
    line of every class of similar lines in the whole corpus, ``n_lines`` and ``n_dropped``. Of a class stays the line of the least doc_id (null last), ties by the row's key,
    then the earliest in the text. All rows stay, in their columns and order of lines; a text may become
    empty.

    Defined cases: a null text stays null with 0 lines; lines without anything but blanks stay. Rows equal
    in doc_id and text are one document and keep the same lines. Rows that share only a doc_id are
    different documents. No rows give no rows. Extra columns are carried along.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    classes = line_classes(docs.select("text"), scratch)
    keyed = docs.select("doc_id", "text", *row_key())
    spots = keyed.select(
        F.col("doc_id").isNull().alias("none"), "doc_id", "_ka", "_kb", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).withColumn("norm", _norm(F.col("line")))
    spots = spots.select(
        F.struct("none", "doc_id", "_ka", "_kb", "pos").alias("at"), (F.col("norm") == "").alias("blank"),
        F.xxhash64("norm").alias("l1"), F.xxhash64(F.lit("b"), "norm").alias("l2"),
    )
    placed = spots.where("NOT blank").join(classes, ["l1", "l2"], "left").select(
        "at", F.coalesce("component", "l1").alias("c1"), F.when(F.col("component").isNull(), F.col("l2")).otherwise(0).alias("c2")
    )
    placed = scratch.write(placed, "placed")
    leader = placed.groupBy("c1", "c2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    lost = placed.join(leader, ["c1", "c2"]).where(F.col("at") != F.col("first"))
    # The dropped lines of a document as one row: no more entries than the document has lines.
    lost = lost.groupBy("at._ka", "at._kb").agg(F.sort_array(F.collect_set("at.pos")).alias("_lost"))
    lost = scratch.write(lost, "lost")
    scratch.drop("placed", "classes")
    rows = docs.select(F.struct("*").alias("row"), *row_key()).join(lost, ["_ka", "_kb"], "left")
    text = F.col("row")["text"]
    split = F.split(text, "\n", -1)

    def without(kept_lines: Column, gone: Column) -> Column:
        # Positions that stay, as runs between the dropped ones: linear in the lines.
        def runs_to(ends: Column) -> Column:
            def run(end: Column, i: Column) -> Column:
                begin = F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
                return F.slice(kept_lines, begin + 1, end - begin)

            return F.transform(ends, run)

        runs = let(F.concat(gone, F.array(F.size(kept_lines))), runs_to)
        return F.array_join(F.flatten(runs), "\n")

    left = F.when(F.col("_lost").isNull(), text).otherwise(
        let(split, lambda s: let(F.col("_lost"), lambda g: without(s, g)))
    )
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    n_dropped = F.coalesce(F.size("_lost"), F.lit(0)).cast("long")
    return rows.select("row", left.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened texts."""
    found = dedup_lines(docs)
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", "text")
