"""BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.pretokens import END, Vocabulary, default_path, vocabulary

# Bytes of words and of fragments a worker remembers; the memos only save time.
WORD_MEMO, FRAGMENT_MEMO = 96 << 20, 32 << 20
SLICE_BYTES = 1 << 20  # text whose ids and decoded texts are held at once; a longer text is a slice of its own


class Splitter:
    """Cuts words where no token can reach across, and encodes the fragments for themselves.

    A token that a merge makes is in the vocabulary. Two neighbouring byte letters that no token holds side by side
    are therefore never joined, whatever stands around them, and what lies on either side is encoded as if
    alone. The last letter of a word carries the word's end, so pairs are listed apart for the inside and the end.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.inner, self.final = set(), set()
        for token in vocab.ids:
            closed = token.endswith(END) and len(token) > len(END)
            body = token[: -len(END)] if closed else token
            pairs = list(zip(body, body[1:], strict=False))
            if closed and pairs:
                self.final.add(pairs.pop())
            self.inner.update(pairs)
        self.words: dict[str, tuple[bytes, str]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.word_bytes = self.fragment_bytes = 0

    def pieces(self, letters: str) -> list[str]:
        """Fragments of a word between forced boundaries."""
        last = len(letters) - 1
        cuts = [
            i for i in range(1, last + 1)
            if (letters[i - 1], letters[i]) not in (self.final if i == last else self.inner)
        ]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def fragment(self, letters: str, ends_word: bool) -> tuple[int, ...]:
        key = (letters, ends_word)
        found = self.fragments.get(key)
        if found is None:
            atoms = (*letters[:-1], letters[-1] + END) if ends_word else tuple(letters)
            found = tuple(self.vocab.ids[t] for t in self.vocab.merged(atoms))
            self.fragment_bytes += 300 + len(letters) + 40 * len(found)
            if self.fragment_bytes > FRAGMENT_MEMO:
                self.fragments, self.fragment_bytes = {}, 0
            self.fragments[key] = found
        return found

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids of a word, 32 bits each, and its tokens one after the other."""
        found = self.words.get(word)
        if found is None:
            parts = self.pieces(self.vocab.letters(word))
            ids = tuple(chain.from_iterable(self.fragment(p, i == len(parts) - 1) for i, p in enumerate(parts)))
            found = (np.array(ids, np.int32).tobytes(), " ".join([self.vocab.names[i] for i in ids]))
            self.word_bytes += 300 + 4 * len(word) + len(found[0]) + len(found[1])
            if self.word_bytes > WORD_MEMO:
                self.words, self.word_bytes = {}, 0
            self.words[word] = found
        return found

    def text(self, text: str) -> tuple[list[int], str]:
        ids, shown = self.coded(text)
        return ids.tolist(), shown

    def coded(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the text they decode to: the file names no decoder, so the tokens come with a space
        between them."""
        word = self.word
        ids: list[bytes] = []
        shown: list[str] = []
        for i, segment in enumerate(self.vocab.segments(text)):
            if i % 2:
                ids.append(np.int32(self.vocab.special[segment]).tobytes())
                shown.append(segment)
                continue
            known = self.words.get
            found = [known(w) or word(w) for w in self.vocab.cut(self.vocab.normal(segment))]
            ids.extend([f[0] for f in found])
            shown.extend([f[1] for f in found])
        return np.frombuffer(b"".join(ids), np.int32), " ".join(shown)


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(vocabulary(path))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string) in place of any columns of these names.

    Defined cases: a null text counts as empty and has no ids. Special tokens named in a text get
    their own ids. Nulls, repeated rows and extra columns are carried along. No rows give no rows.
    """
    path = path or default_path()
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    at = [c.lower() for c in kept].index("text")
    # The columns travel as one struct, whatever they are called, and the text only inside it.
    frame = docs.select(F.struct(*kept).alias("row"))
    schema = docs.select(F.struct(*kept).alias("row")).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def per_task(batches):
        encode = splitter(path).coded
        for batch in batches:
            column = batch.column(0)
            texts = column.field(at)
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < len(texts):
                done = ends[begin - 1] if begin else 0
                size = max(1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")) - begin)
                found = [encode(t or "") for t in texts.slice(begin, size).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([f[0] for f in found])))
                yield pa.RecordBatch.from_arrays(
                    [column.slice(begin, size), ids, pa.array([f[1] for f in found], pa.string())], names=schema.names
                )
                begin += size

    return frame.mapInArrow(per_task, schema).select("row.*", "ids", "decoded")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(docs)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
