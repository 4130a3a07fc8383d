"""Cutting, merging and prefix counting against the library, on hostile texts."""

import random

import pytest
from tokenizers import Tokenizer

from citeflow.llm.bpe import splitter
from citeflow.llm.pretokens import default_path
from citeflow.llm.token_counts import prefix_counter, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def hostile(n, seed):
    draw = random.Random(seed)
    letters = [chr(c) for c in range(0x250)] + [chr(draw.randrange(0x250, 0x3000)) for _ in range(200)]
    letters += ["é", "ΑΣ ", "İ", "\U0001f600", "中", "́", "‍", "ﬁ", "<|endoftext|>", "<|startoftext|>", "'re", "'S", "'LL", "<|end"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 30))) for _ in range(n)]


def test_encoding_equals_the_library(library):
    coder = splitter(default_path())
    for text in [*hostile(3000, 1), "", " ", "a" * 4000, "<|endoftext|>" * 3]:
        ids, shown = coder.text(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert shown == library.decode(ids, skip_special_tokens=False)


def test_no_token_reaches_across_a_cut():
    coder = splitter(default_path())
    for word in ("thewxqzzj", "internationalization", "qxjzkvw", "a"):
        pieces = coder.pieces(word)
        assert "".join(pieces) == word
    assert len(coder.pieces("thewxqzzj")) > 1


def test_count_at_every_prefix(library):
    counter = prefix_counter(default_path())
    draw = random.Random(5)
    letters = [*"abcdefghijklmnopqrstuvwxyz   ''<|>!?.,0123éüß", "'re", "'s", "<|endoftext|>", "!!"]
    for _ in range(300):
        table = counter.table("".join(draw.choice(letters) for _ in range(draw.randrange(0, 40))))
        counts = [len(library.encode(table.normal[:k], add_special_tokens=False).ids) for k in range(len(table.normal) + 1)]
        assert [table.at(k) for k in range(len(counts))] == counts
        budget = draw.randrange(0, 15)
        assert table.cut(budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_totals_equal_the_library(library):
    counter = prefix_counter(default_path())
    for text in hostile(3000, 9):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.total(text) == n == counter.table(text).total


def test_budgets_are_read_off_the_prefix_table(spark, sf):
    library = Tokenizer.from_file(default_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts(docs, budget=50).collect():
        normal = library.normalizer.normalize_str(texts[r["doc_id"]])
        size = lambda n: len(library.encode(normal[:n], add_special_tokens=False).ids)  # noqa: B023, E731
        assert r["prefix_tokens"] == size(r["prefix_chars"]) <= 50
        assert r["fits"] == (r["n_tokens"] <= 50) == (r["prefix_chars"] == len(normal))
        # Counts may fall inside a word, so the next ones are looked at too.
        assert all(size(n) > 50 for n in range(r["prefix_chars"] + 1, min(len(normal), r["prefix_chars"] + 40) + 1))
