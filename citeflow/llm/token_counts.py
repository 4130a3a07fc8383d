"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.llm.pretokens import END, Vocabulary, default_path, vocabulary
from citeflow.llm.tables import text_or_empty

MEMO = 200_000  # entries each of the memos of a worker keeps; they only save time
LIMIT = 2048


class PrefixCounter:
    """The tokens of all prefixes of a word at once.

    The encoding of a run of letters ends in one token t, and what stands before t is the encoding of
    the shorter prefix, where t may follow its last token: where the two side by side encode to just these
    two. So each prefix needs the last token of its shorter ones only, and a word is never encoded as a whole.
    ``open`` prefixes go on; a ``closed`` one ends the word there, as the text cut at that place would.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.tokens = vocab.ids
        self.longest = max(len(t.removesuffix(END)) for t in vocab.ids)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._sizes: dict[str, int] = {}

    def _atoms(self, token: str) -> tuple[str, ...]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return (*body[:-1], body[-1] + END)
        return tuple(token)

    def _may_follow(self, before: str, token: str) -> bool:
        key = (before, token)
        found = self._pairs.get(key)
        if found is None:
            merged = self.vocab.merged(((*self._atoms(before), *self._atoms(token))) if before else self._atoms(token))
            found = merged == ([before, token] if before else [token])
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def _last(self, letters: str, i: int, end: str, last: list[str], guess: int) -> tuple[int, str]:
        """Begin of the last token of ``letters[:i] + end``, and the token. There is exactly one; the begin of the
        shorter prefix's last token is tried first."""
        tokens, pairs = self.tokens, self._pairs
        for j in (guess, *range(i - 1, max(0, i - self.longest) - 1, -1)):
            token = letters[j:i] + end
            if token in tokens:
                fits = pairs.get((last[j], token))
                if fits or (fits is None and self._may_follow(last[j], token)):
                    return j, token
        raise ValueError(f"no encoding of {letters[:i]!r}")

    def _opened(self, letters: str) -> tuple[list[int], list[str], list[int]]:
        """Counts, last tokens and their begins for all proper prefixes."""
        counts, last, begins = [0], [""], [0]
        for i in range(1, len(letters)):
            j, token = self._last(letters, i, "", last, begins[-1])
            counts.append(counts[j] + 1)
            last.append(token)
            begins.append(j)
        return counts, last, begins

    def size(self, word: str) -> int:
        """Tokens of a whole word: the last entry of its table."""
        letters = self.vocab.letters(word)
        counts, last, begins = self._opened(letters)
        found = counts[self._last(letters, len(letters), END, last, begins[-1])[0]] + 1
        if len(self._sizes) >= MEMO:
            self._sizes.clear()
        self._sizes[word] = found
        return found

    def sizes(self, words: list[str]) -> list[int]:
        known = self._sizes.get
        return [known(w) or self.size(w) for w in words]

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of the text cut after each character of a word, the whole word last."""
        found = self._words.get(word)
        if found is None:
            found = self._by_prefix(word)
            if len(self._words) >= MEMO:
                self._words.clear()
            self._words[word] = found
        return found

    def _by_prefix(self, word: str) -> tuple[int, ...]:
        if len(word) > 1 and word[0] == "'" and word[1].isalpha():
            # Cut inside a contraction, the apostrophe is a word and the letters are another.
            head = self.word("'")[0]
            tail = self.word(word[1:])
            return (head, *[head + n for n in tail[:-1]], self._counts(word)[-1])
        return self._counts(word)

    def _counts(self, word: str) -> tuple[int, ...]:
        letters = self.vocab.letters(word)
        counts, last, begins = self._opened(letters)
        closed, at = [], 0
        for c in word:
            at += len(c.encode())
            closed.append(counts[self._last(letters, at, END, last, begins[at - 1])[0]] + 1)
        return tuple(closed)

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)

    def total(self, text: str) -> int:
        return self.table(text).total


class PrefixTable:
    """Token counts at all prefixes of a normalised text: running totals at the begin of every word, and the entries inside a
    word worked out when a prefix that ends there is asked for."""

    def __init__(self, counter: PrefixCounter, text: str):
        vocab = counter.vocab
        self.counter = counter
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.before: list[int] = []
        self.words: list[str | tuple[int, ...]] = []  # a special token has its entries at once
        self.normal, tokens, after_special = "", 0, False
        for i, segment in enumerate(vocab.segments(text)):
            base = len(self.normal)
            if i % 2:
                # Cut inside, the text of a special token is ordinary, joined to the word it follows.
                joined = self.ends and self.ends[-1] == base and not after_special
                tail = self.normal[self.starts[-1] : base] if joined else ""
                lead = self.before[-1] if tail else tokens
                partial = [lead + sum(counter.word(w)[-1] for w in vocab.cut(tail + segment[:k])) for k in range(1, len(segment))]
                self.starts.append(base)
                self.ends.append(base + len(segment))
                self.before.append(tokens)
                self.words.append(tuple(n - tokens for n in partial) + (1,))
                self.normal += segment
                tokens += 1
                after_special = True
                continue
            normal = vocab.normal(segment)
            after_special = after_special and not normal
            spans = vocab.spans(normal)
            words = [normal[a:b] for a, b in spans]
            totals = list(accumulate(counter.sizes(words), initial=tokens))
            tokens = totals.pop()
            self.starts += [base + a for a, _ in spans]
            self.ends += [base + b for _, b in spans]
            self.before += totals
            self.words += words
            self.normal = self.normal + normal if base else normal
        self.total = tokens

    def _inside(self, i: int) -> tuple[int, ...]:
        word = self.words[i]
        return self.counter.word(word) if isinstance(word, str) else word

    def at(self, length: int) -> int:
        """Tokens of the first ``length`` characters of the normalised text."""
        i = bisect_right(self.starts, length - 1) - 1
        if i < 0:
            return 0
        if length >= self.ends[i]:
            return self.before[i + 1] if i + 1 < len(self.before) else self.total
        return self.before[i] + self._inside(i)[length - 1 - self.starts[i]]

    def cut(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens. Counts may fall again inside a word, so the
        word in which the budget is passed is looked through."""
        if self.total <= budget:
            return len(self.normal)
        # Totals at word begins never fall: no later word begins within the budget.
        i = bisect_right(self.before, budget) - 1
        fits = [k for k, n in enumerate(self._inside(i), 1) if self.before[i] + n <= budget]
        return self.starts[i] + fits[-1] if fits else self.starts[i]


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None, budget: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fits, prefix_chars, prefix_tokens`` of every row of ``docs(doc_id, text, ...)``, all read off
    the text's prefix table: ``n_tokens`` is its last entry, ``prefix_chars`` the length of the longest prefix of the normalised
    text within ``budget`` tokens, ``prefix_tokens`` that prefix's entry, and ``fits`` says whether it is the whole text.

    Defined cases: a null text counts as empty and has no tokens. A special token named in a text is one token.
    doc_id may be null or repeated; rows are counted one by one. No rows give no rows.
    """
    path = path or default_path()
    text = text_or_empty()
    frame = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes")).schema
    schema = schema.add("n_tokens", "long").add("fits", "boolean").add("prefix_chars", "long").add("prefix_tokens", "long")

    def per_batch(batches):
        counter = prefix_counter(path)
        for batch in batches:
            found = []
            for value in batch.column(2):  # one text and its table at a time
                table = counter.table(value.as_py())
                length = table.cut(budget)
                found.append((table.total, length == len(table.normal), length, table.at(length)))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return frame.mapInArrow(per_batch, schema)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, word_ends, counts``: the length of the normalised text at the end of each word and the
    tokens up to there; what a packing step needs to cut anywhere between words without the text."""
    path = path or default_path()
    frame = docs.select("doc_id", text_or_empty().alias("_text"))
    numbers = T.ArrayType(T.IntegerType())
    schema = frame.drop("_text").schema.add("word_ends", numbers).add("counts", numbers)

    def per_batch(batches):
        counter = prefix_counter(path)
        for batch in batches:
            tables = [counter.table(t) for t in batch.column(1).to_pylist()]
            ends = pa.array([t.ends for t in tables], pa.list_(pa.int32()))
            counts = pa.array([[*t.before[1:], t.total] if t.before else [] for t in tables], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ends, counts], names=schema.names)

    return frame.mapInArrow(per_batch, schema)


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """``doc_id, kept, n_tokens``: the longest prefix of each normalised text within ``budget`` tokens."""
    path = path or default_path()
    frame = docs.select("doc_id", text_or_empty().alias("_text"))
    schema = frame.drop("_text").schema.add("kept", "string").add("n_tokens", "long")

    def per_batch(batches):
        counter = prefix_counter(path)
        for batch in batches:
            kept, counts = [], []
            for text in batch.column(1).to_pylist():
                table = counter.table(text)
                length = table.cut(budget)
                kept.append(table.normal[:length])
                counts.append(table.at(length))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=schema.names)

    return frame.mapInArrow(per_batch, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    over = (~F.col("fits")).alias("over_limit")
    return found.select("doc_id", "n_bytes", "n_tokens", over, "prefix_chars", "prefix_tokens")
