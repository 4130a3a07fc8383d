"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both token sequences of a text are runs over the same bytes. Merging them walks two pointers; here NumPy
walks those of all texts of a slice at once: one step emits a link for every running text, and a cut where both tokens
end at the same byte, moves the pointers and takes finished texts out. A long text runs in several stretches side by
side, so no slice waits for its longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.pretokens import _PLAIN, _class, byte_letters
from citeflow.llm.tables import Scratch, text_or_empty

SLICE_BYTES = 2 << 20  # text that is walked at once; a longer text is a slice of its own
CHUNK_BYTES = 12 << 20  # text whose pairs are looked up together
STRETCH = 256  # tokens of B in a stretch


def offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def encoded(texts: list[list[str]], encode, spelled: list[bytes], lead: str = "") -> tuple[np.ndarray, ...]:
    """Tokens of texts given as fragments: all ids, where each text's begin, and which texts the tokens spell, ``lead``
    in front of each fragment. Each distinct fragment is encoded once."""
    index = dict.fromkeys(chain.from_iterable(texts))
    new = list(index)
    index.update(zip(new, range(len(new)), strict=True))
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
    lists = list(encode(new)) if new else []
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    spelled_ends = offsets(np.array([len(x) for x in spelled], np.int64)[flat])[offsets(sizes)[1:]]
    if lead + lead.join(new) == b"".join([spelled[i] for i in flat.tolist()]).decode(errors="replace") and (
        spelled_ends == np.cumsum([len(f.encode()) + len(lead) for f in new] if new else [])
    ).all():
        right = np.ones(len(new), bool)
    else:
        right = np.array([
            b"".join([spelled[i] for i in ids]) == (lead + f).encode() for f, ids in zip(new, lists, strict=True)
        ], bool)
    each = sizes[codes]
    ends = offsets(each)
    places = np.repeat(offsets(sizes)[codes] - ends[:-1], each) + np.arange(ends[-1])
    fragments = offsets(counts)
    return flat[places], ends[fragments], np.diff(offsets(~right[codes])[fragments]) == 0


class ByteTokens:
    """Vocabulary A: byte-level BPE from a tokenizers file. Words are encoded one by one, as the file's own cut makes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        values = {letter: b for b, letter in enumerate(byte_letters())}
        size = self.library.get_vocab_size()
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.spelled = [bytes(values[c] for c in t) if all(c in values for c in t) else t.encode() for t in names]
        # The cut of the file's pattern, with its classes listed for the plain characters.
        space, letters, digits = "\t-\r \x85\xa0", _class("L"), _class("N")
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.merged = self._merged(path)

    def _merged(self, path: str):
        """How to encode words that are cut already. Where the ids follow the order of the merges, as in this kind of file,
        they are themselves the ranks that a byte-pair encoder takes."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in made]
        ranks = {self.spelled[i]: i for i in model["vocab"].values()}
        if ids == sorted(set(ids)) and all(bytes([b]) in ranks for b in range(256)) and max(
            ranks[bytes([b])] for b in range(256)
        ) < ids[0]:
            ranks = {s: i for s, i in ranks.items() if len(s) == 1 or i >= ids[0]}
            words = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
            return lambda new: map(words.encode_ordinary, new)
        return lambda new: [e.ids for e in self.library.encode_batch(new, add_special_tokens=False)]

    def words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return encoded([self.words(t) for t in texts], self.merged, self.spelled)


class PieceTokens:
    """Vocabulary B: a sentencepiece model, which puts a space in front by itself. Where no piece has a space after another
    character, no merge reaches over such a place, and the parts between are encoded one by one."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.spelled = [
            bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        self.space = self.library.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragments come without the space that each of them begins with, as the model adds it. A part that spells
        something else stays wrong in the whole text, because no other part can make up for it."""
        parts = [self.parts(t) if self.apart and t else [t] * bool(t) for t in texts]
        return encoded(parts, self.pieces, self.spelled, " ")

    @staticmethod
    def parts(text: str) -> list[str]:
        whole = " " + text
        return text.split(" ") if "  " not in whole else [p[1:] for p in re.findall(" +[^ ]*", whole)]

    def pieces(self, new: list[str]) -> list[list[int]]:
        # The model gives nothing for an empty text, where a text ends in one space.
        found = self.library.encode(new, num_threads=1)
        return [ids if part else [self.space] for part, ids in zip(new, found, strict=True)]


def _only(right: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    return ids[np.repeat(right, counts)], offsets(counts * right)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.length_a = np.array([len(s) for s in self.a.spelled], np.int64)
        self.length_b = np.array([len(s) for s in self.b.spelled], np.int64)
        # An id and the sign after it in eight bytes, zero bytes on the right.
        most = max(len(self.length_a), len(self.length_b))
        self.shown = {
            sign: np.array([f"{i}{sign}".encode() for i in range(most)], "S8").view(np.uint64) for sign in ",|;"
        }
        self.width = np.array([len(str(i)) + 1 for i in range(most)], np.int64)

    def walk(self, texts: list[str]) -> Slice:
        """Tokens, links and cuts of a slice of texts."""
        whole = [" " + t if t else "" for t in texts]
        ids_a, first_a, spelled_a = self.a.encode(whole)
        ids_b, first_b, spelled_b = self.b.encode(texts)
        right = spelled_a & spelled_b
        if not right.all():  # texts that the tokens do not spell have none
            ids_a, first_a = _only(right, ids_a, first_a)
            ids_b, first_b = _only(right, ids_b, first_b)
        # Valid texts one after the other are one run of bytes for both vocabularies.
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        starts = [np.arange(p, q, STRETCH) for p, q in zip(first_b, first_b[1:], strict=False)]
        j = np.concatenate(starts) if starts else np.empty(0, np.int64)
        stop = np.concatenate([np.append(s[1:], q) for s, q in zip(starts, first_b[1:], strict=True) if len(s)] or [j])
        i = np.searchsorted(end_a, np.where(j > 0, end_b[j - 1], 0) if len(j) else j, side="right")
        links_a, links_b, cuts_a, cuts_b = [], [], [], []
        while len(i):
            links_a.append(i)
            links_b.append(j)
            at_a, at_b = end_a[i], end_b[j]
            cut = at_a == at_b
            cuts_a.append(i[cut])
            cuts_b.append(j[cut])
            i = i + (at_a <= at_b)
            j = j + (at_b <= at_a)
            running = j < stop
            if not running.all():
                i, j, stop = i[running], j[running], stop[running]
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return Slice(self, ids_a, ids_b, first_a, first_b, end_a, joined(links_a), joined(links_b),
                     np.sort(joined(cuts_a)), np.sort(joined(cuts_b)))


class Slice:
    """What a walk found. Links and cuts are positions in the tokens of all texts of the slice; text k has the tokens from
    ``first_a[k]`` to ``first_a[k + 1]``."""

    def __init__(self, by, ids_a, ids_b, first_a, first_b, end_a, links_a, links_b, cuts_a, cuts_b):
        self.by, self.ids_a, self.ids_b, self.first_a, self.first_b, self.end_a = by, ids_a, ids_b, first_a, first_b, end_a
        self.links_a, self.links_b, self.cuts_a, self.cuts_b = links_a, links_b, cuts_a, cuts_b
        self.n_a, self.n_b = np.diff(first_a), np.diff(first_b)
        self.n_groups = np.diff(np.searchsorted(cuts_a, first_a))
        self.text_of_b = np.repeat(np.arange(len(self.n_b)), self.n_b)
        self.n_links = np.bincount(self.text_of_b[links_b], minlength=len(self.n_b))

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        signs, width = self.by.shown, self.by.width
        ends_a, ends_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        ends_a[self.cuts_a], ends_b[self.cuts_b] = 1, 1
        before = np.concatenate([[0], self.cuts_b + 1])  # tokens of B in the groups before
        at_a = np.arange(len(ends_a)) + before[np.cumsum(ends_a) - ends_a]
        at_b = np.arange(len(ends_b)) + (self.cuts_a + 1)[np.cumsum(ends_b) - ends_b]
        out = np.empty(len(ends_a) + len(ends_b), np.uint64)
        long = np.empty(len(out), np.int64)
        out[at_a], out[at_b] = signs[","][self.ids_a], signs[","][self.ids_b]
        long[at_a], long[at_b] = width[self.ids_a], width[self.ids_b]
        out[at_a[self.cuts_a]] = signs["|"][self.ids_a[self.cuts_a]]
        out[at_b[self.cuts_b]] = signs[";"][self.ids_b[self.cuts_b]]
        letters = out.view(np.uint8)
        flat = letters[letters != 0].tobytes()
        ends = offsets(long)[self.first_a + self.first_b]
        return [flat[p : max(p, q - 1)] for p, q in zip(ends, ends[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs of each text in order, as ``a * size of B + b``: number of pairs a text, the
        pairs, and how many links of the text hold each."""
        size = len(self.by.length_b)
        code = self.ids_a[self.links_a].astype(np.int64) * size + self.ids_b[self.links_b]
        keys = np.sort((self.text_of_b[self.links_b] << 40) | code)
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(np.append(begin, len(keys)))
        keys = keys[begin]
        return np.bincount(keys >> 40, minlength=len(self.n_a)), keys & ((1 << 40) - 1), times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows and texts, about SLICE_BYTES of text at a time."""
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        bounds = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            done = bounds[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(bounds, done + SLICE_BYTES, side="right")))
            yield rows.slice(at, end - at), texts.slice(at, end - at).to_pylist()
            at = end


def _frame(docs: DataFrame, keep: list[str] | None, text: str) -> DataFrame:
    return docs.select(F.struct(*(keep or docs.columns)).alias("row"), text_or_empty(text).alias("text"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, keep: list[str] | None = None,
            text: str = "text") -> DataFrame:
    """A row for each document: ``row`` (its columns, or those in ``keep``), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``
    (``a1,a2|b1;a3|b2,b3``: ids between cuts) and ``cuts`` (offsets in bytes of the text with a space in front).

    Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text (such as one with
    U+2581 in it), have no tokens, zeros and empty results. Special tokens in texts are plain text. Repeated rows, nulls and extra
    columns are carried along. No rows give no rows.
    """
    paths = paths or default_paths()
    frame = _frame(docs, keep, text)
    schema = frame.select("row").schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups", "string").add("cuts", T.ArrayType(T.LongType()))

    def per_task(batches):
        for rows, texts in _slices(batches):
            found = aligner(*paths).walk(texts)
            ends = found.end_a[found.cuts_a]
            at = offsets(found.n_groups)
            base = np.concatenate([[0], found.end_a])[found.first_a[:-1]]
            cuts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends - np.repeat(base, found.n_groups)))
            yield pa.RecordBatch.from_arrays(
                [rows, *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                 pa.array([g.decode() for g in found.groups()], pa.string()), cuts], names=schema.names)

    return frame.mapInArrow(per_task, schema)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^31 as compressed bytes, equal places next to each other."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: memoryview, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, count).T.copy().view("<i4").ravel().astype(np.int64)


class Chunk:
    """Pairs of some texts: each distinct pair once, and for each text the places of its pairs among them."""

    def __init__(self, key: str):
        self.key, self.texts, self.bytes, self.parts = key, 0, 0, []

    def add(self, found: Slice, size: int) -> None:
        self.parts.append(found.pairs())
        self.texts += len(found.n_a)
        self.bytes += size

    def row(self) -> dict:
        lengths, codes, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        known, places = np.unique(codes, return_inverse=True)
        totals = np.bincount(places, weights=times, minlength=len(known)).astype(np.int64)
        steps = np.diff(places, prepend=0)  # falls where a text ends
        steps = np.where(steps < 0, 2 * -steps - 1, 2 * steps)
        body = pa.compress(_packed(lengths) + _packed(steps) + _packed(times), codec="zstd", asbytes=True)
        return {"chunk": self.key, "codes": known, "totals": totals, "texts": self.texts, "pairs": len(codes), "body": body}

    @staticmethod
    def sums(texts: int, pairs: int, body: bytes, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: links whose count is the highest of their B id, and the sum of the links' counts."""
        data = memoryview(pa.decompress(body, decompressed_size=4 * (texts + 2 * pairs), codec="zstd", asbytes=True))
        lengths = _unpacked(data[: 4 * texts], texts)
        steps = _unpacked(data[4 * texts : 4 * (texts + pairs)], pairs)
        times = _unpacked(data[4 * (texts + pairs) :], pairs)
        places = np.cumsum(np.where(steps & 1, -(steps + 1) // 2, steps // 2))
        at = offsets(lengths)
        total = lambda x: np.diff(offsets(x)[at])
        return total(times * best[places]), total(times * counts[places])


CHUNK_COLUMNS = "chunk string, no int, codes array<long>, totals array<long>, texts int, pairs long, body binary"


def link_counts(docs: DataFrame, paths: tuple[str, str] | None = None, keep: list[str] | None = None,
                text: str = "text") -> DataFrame:
    """A row for each document as ``aligned`` has it, with ``groups_sha256`` in place of groups and cuts, and
    ``n_best`` (links whose id pair has the highest count of its B id in the corpus, ties included) and ``count_sum`` (of
    all links: how many links of the corpus hold their pair).

    Texts are tokenised and walked once. Tasks put the pairs of about ``CHUNK_BYTES`` of text in a chunk, which asks for
    each distinct pair once; counts and answers are joins and aggregations over pairs, so no task holds the
    corpus-wide table. The highest counts, one for each id of B, are broadcast: their number is the vocabulary's.

    Defined cases: as ``aligned``; ``groups_sha256`` is empty for texts without tokens.
    """
    paths = paths or default_paths()
    spark = docs.sparkSession
    frame = _frame(docs, keep, text)
    schema = T.StructType().add("row", frame.schema["row"].dataType)  # null in the rows of chunks
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    for field in T._parse_datatype_string(CHUNK_COLUMNS).fields:
        schema = schema.add(field)

    def per_task(batches):
        by = aligner(*paths)
        task, number = TaskContext.get().partitionId(), 0
        chunk = Chunk(f"{task}-0")

        def closing(like: pa.Array) -> pa.RecordBatch:
            row = chunk.row()
            own = [pa.nulls(1, like.type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([
                *own, pa.array([row["chunk"]]), pa.nulls(1, pa.int32()), pa.array([row["codes"]], pa.list_(pa.int64())),
                pa.array([row["totals"]], pa.list_(pa.int64())), pa.array([row["texts"]], pa.int32()),
                pa.array([row["pairs"]], pa.int64()), pa.array([row["body"]], pa.binary())], names=schema.names)

        rows = None
        for rows, texts in _slices(batches):
            found = by.walk(texts)
            n = len(texts)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
            yield pa.RecordBatch.from_arrays([
                rows, *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                pa.array(digests, pa.string()), pa.array([chunk.key] * n),
                pa.array(np.arange(chunk.texts, chunk.texts + n), pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names)
            chunk.add(found, sum(map(len, texts)))
            if chunk.bytes >= CHUNK_BYTES:
                yield closing(rows)
                number += 1
                chunk = Chunk(f"{task}-{number}")
        if chunk.texts:
            yield closing(rows)

    scratch = Scratch(spark, "alignment")
    table = scratch.write(frame.mapInArrow(per_task, schema), "walked")
    chunks = table.where("body is not null")
    size_b = aligner(*paths).length_b.size
    counts = scratch.write(
        chunks.select(F.inline(F.arrays_zip("codes", "totals"))).groupBy(F.col("codes").alias("code"))
        .agg(F.sum("totals").alias("n")), "counts",
    )
    highest = counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(highest), F.col("code") % size_b == F.col("b")).select(
        "code", "n", (F.col("n") == F.col("most")).alias("best")
    )
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("codes").alias("place", "code"))
    answers = asked.join(known, "code").select("of", "place", "n", "best")

    def per_chunk(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        row = chunk.slice(0, 1).to_pylist()[0]
        place = answer["place"].to_numpy()
        n, best = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        n[place], best[place] = answer["n"].to_numpy(), answer["best"].to_numpy()
        n_best, count_sum = Chunk.sums(row["texts"], row["pairs"], row["body"], n, best)
        return pa.table({
            "chunk": pa.array([row["chunk"]] * row["texts"]), "no": pa.array(np.arange(row["texts"]), pa.int32()),
            "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
        })

    sums = (
        chunks.select("chunk", "texts", "pairs", "body").groupBy("chunk")
        .cogroup(answers.groupBy("of"))
        .applyInArrow(per_chunk, "chunk string, no int, n_best long, count_sum long")
    )
    rows = table.where("body is null").drop("codes", "totals", "texts", "pairs", "body")
    return rows.join(sums, ["chunk", "no"]).drop("chunk", "no")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_counts(docs, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
