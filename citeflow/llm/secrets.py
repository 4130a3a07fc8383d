"""Secrets in texts, told apart by how many owners hold them in the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.tables import Scratch, row_key, text_or_empty

# The kinds, in the order in which they are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")

LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# A value that at least so many owners hold is an example people copy.
COPIED_OWNERS = 3
# Bits a character, and kinds of characters, that a value nobody made up by hand has at least.
MIN_ENTROPY, MIN_CLASSES = 3.2, 2


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, value)`` of the patterns' matches, kinds by their place in `KINDS`."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return found


def looks_live(value: str) -> bool:
    """Random-looking: several kinds of characters and much entropy."""
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[+/_.=-]"))
    if classes < MIN_CLASSES or not re.search("[0-9]", value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that no base span covers."""
    taken = sorted((s, e) for _, s, e, _ in base)
    found, at = [], 0
    for m in LOOSE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not (at < len(taken) and taken[at][0] < m.end()) and looks_live(m[0]):
            found.append((3, *m.span(), m[0]))
    return found


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row a candidate: the row's key, owner, repository, kind, span, hash of the value, whether it looks live.
    Only hashes leave the task, never a value."""
    keys = docs.select(
        "doc_id", *row_key(), F.col(owner).cast("string").alias("owner"),
        F.xxhash64(*[c for name in repository for c in (F.col(name).isNull(), F.col(name))]).alias("repository"),
        text_or_empty().alias("text"),
    )
    schema = keys.drop("text").schema
    for name, kind in (("kind", "integer"), ("start", "integer"), ("end", "integer"), ("value", "binary"), ("live", "boolean")):
        schema = schema.add(name, kind)

    def per_batch(batches):
        for batch in batches:
            rows, spans = [], []
            for i, text in enumerate(batch.column(5).to_pylist()):
                base = base_spans(text)
                for kind, start, end, value in base + loose_spans(text, base):
                    rows.append(i)
                    spans.append((kind, start, end, hashlib.sha256(value.encode()).digest()[:16], looks_live(value)))
            of = batch.select(range(5)).take(pa.array(rows, pa.int64()))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            more = [pa.array([s[k] for s in spans], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*of.columns, *more], names=schema.names)

    return keys.mapInArrow(per_batch, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``value, n_owners, n_repositories`` over all candidates of the corpus.

    Distinct repositories and owners are taken before counting, with map-side aggregation, so a value copied into
    a third of all documents costs each task one row a repository."""
    pairs = found.select("value", "repository", "owner").distinct()
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("r"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id`` and ``found``, an array of ``(start, kind, end,
    verdict, n_owners, n_repositories)`` by start, then kind.

    Base spans always stay. A random-looking run without a keyword is added (kind ``owned``) if fewer than
    `COPIED_OWNERS` owners of the whole corpus hold it: shared runs are examples, hashes of known files and the like.
    The verdict of a span is ``copied`` if that many owners hold its value, else ``live`` if it looks random, else ``weak``.

    Defined cases: a null text counts as empty. A null owner is one owner, a null in the repository's columns
    part of its name. Rows equal in doc_id and text share their spans and are returned one by one. No rows give no
    rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.write(candidates(docs, owner, repository), "candidates")
    counts = ownership(found)
    copied = F.col("n_owners") >= COPIED_OWNERS
    judged = found.join(counts, "value").where((F.col("kind") < 3) | ~copied)
    verdict = F.when(copied, "copied").when(F.col("live"), "live").otherwise("weak")
    # A document's spans as one row: no more entries than its text has matches.
    span = F.struct("start", "kind", "end", verdict.alias("verdict"), "n_owners", "n_repositories")
    listed = judged.groupBy("_ka", "_kb").agg(F.sort_array(F.collect_set(span)).alias("found"))
    rows = docs.select("doc_id", *row_key())
    empty = F.array().cast(listed.schema["found"].dataType)
    return rows.join(listed, ["_ka", "_kb"], "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def _listed(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(test):
        return F.size(F.filter("found", test)).cast("long")

    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", *[count(_is(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        count(_is(3)).alias("n_owned"), count(lambda s: s["verdict"] == "copied").alias("n_copied"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
    )


def _is(kind: int):
    return lambda s: s["kind"] == kind
