"""Whitening, licence scan and alignment against brute force, and their defined cases."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from citeflow.llm import alignment, licences, whitening
from citeflow.llm.pretokens import byte_letters


# Whitening


def plain_whitening(vectors, wanted=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    deviation = ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    return deviation, (x - total / n) @ axes[:, :wanted] / np.sqrt(values[:wanted]), values / values.sum()


def test_whitening_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    deviation, w, shares = plain_whitening(np.stack(table["embedding"]))
    got = whitening.op11(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(table) and set(got["component"]) == set(range(1, 9))
    found = got["whitened"].to_numpy().reshape(-1, 8)
    signs = np.sign((found * w).sum(axis=0))
    assert np.abs(found * signs - w).max() < 1e-9
    assert got[got["component"] == 1]["deviation"].tolist() == list(deviation)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8)[0], shares[:8], rtol=1e-9)
    assert set(got["n"]) == {len(table)} and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize(
    "values",
    [
        np.array([9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 4.0, 1.0]),  # equal eigenvalues inside
        np.array([9.0, 5.0, 5.0, 5.0, 5.0, 1.0, 1.0, 1.0]),  # and at the edge of those wanted
        np.array([3.0, 2.0, 1e-3, 1e-6, 0.0, 0.0, 0.0, 0.0]),  # low rank
        np.array([1.0, 1.0 - 1e-7, 1.0 - 2e-7, 0.5, 0.4, 0.3, 0.2, 0.1]),  # close ones
        np.ones(8),
    ],
)
def test_components_and_counts(spark, values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((8, 8)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    assert whitening.above(matrix, 0.75) == (values > 0.75).sum()
    found, axes = whitening.components(spark, matrix, 4)
    assert np.allclose(found, values[:4], atol=1e-12)
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12


def test_whitening_defined_cases(spark):
    schema = "vec_id long, embedding array<float>, x string, w int, row string"
    rng = np.random.default_rng(2)
    good = [[float(v) for v in row] for row in rng.standard_normal((40, 3))]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    vectors = good + odd + [good[0], good[0]]
    rows = [(None if k == 3 else k, v, None, k, "r") for k, v in enumerate(vectors)]
    got = whitening.whitened(spark.createDataFrame(rows, schema).repartition(3)).collect()
    kept = good + [good[0], good[0]]
    assert len(got) == len(kept) and {r["n"] for r in got} == {len(kept)} and {len(r["w"]) for r in got} == {3}
    deviation, _, _ = plain_whitening(np.array(kept, np.float32), 3)
    assert Counter(int(r["deviation"]) for r in got) == Counter(deviation)
    assert max(r["identity_error"] for r in got) < 1e-9
    # Nothing to whiten: one vector, equal vectors, no vectors.
    for few in ([(1, [1.0, 2.0])], [(k, [5.0, 5.0]) for k in range(9)]):
        found = whitening.whitened(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()
        assert [(r["w"], int(r["deviation"]), r["identity_error"]) for r in found] == [([], 0, None)] * len(few)
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened(none).count() == 0 == whitening.whitened(none.limit(0)).count()
    far = spark.createDataFrame([(k, [1e30 * (-1) ** k, float(k)]) for k in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whitened(far).count() == 4


def test_covariance_does_not_depend_on_the_split(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    matrices = []
    for parts in (1, 7):
        vectors = table.repartition(parts).select(whitening.scaled(table["embedding"]).alias("x"))
        matrices.append(whitening.covariance(vectors, *whitening.sums(vectors)))
    assert (matrices[0] == matrices[1]).all()


# Licences


def plain_blocks(text, threshold=0.8):
    found = licences.words((text or "").encode())
    blocks = set()
    for t, (_, template, key) in enumerate(licences.TEMPLATES):
        listed = licences.words(template.encode())
        half = 4
        while half < len(listed):
            half *= 2
        for k in range(-(-len(found) // half)):
            block = set(found[k * half : (k + 2) * half])
            shared = len(block & set(listed))
            if shared >= threshold * len(set(listed)) - 1e-9 and set(licences.words(key.encode())) <= block:
                blocks.add((t, k * half, shared / len(set(listed))))
    return blocks


NOTICES = [
    "Some prose here.\nLicensed under the Apache License,\nVersion 2.0.\nMore.", "x " * 500 + "RELEASED under the mit license",
    "licensed under the terms of the BSD license", "This work is licensed under GNU General Public License version 3",
    "Licensed under CC BY-NC 4.0.", "cc by cc by", "all rights reserved", "All Rights\n\nReserved all rights",
    "the of and by under to in " * 300, "Permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the Software without restriction including "
    "rights to use copy modify merge publish distribute sublicense and or sell copies", "Ünder cc bÿ", None, "", " \n",
]


def test_licences_equal_brute_force(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect()] + NOTICES
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["row"]["doc_id"]: r for r in licences.summary(licences.scan(docs)).collect()}
    for k, text in enumerate(texts):
        want, row = plain_blocks(text), got[k]
        halves = {t: 1 << max(2, (len(licences.words(x.encode())) - 1).bit_length()) for t, (_, x, _) in enumerate(licences.TEMPLATES)}
        assert Counter((b["template"], round(b["share"], 12)) for b in row["blocks"]) == Counter(
            (t, round(s, 12)) for t, _, s in want
        )
        for b in row["blocks"]:
            assert any(t == b["template"] and at <= b["first_word"] <= b["last_word"] < at + 2 * halves[t] for t, at, _ in want)
        words = licences.words((text or "").encode())
        places = [
            (label, i) for p, label in licences.PHRASES.items() for i in range(len(words))
            if words[i : i + len(p.split())] == p.encode().split()
        ]
        assert Counter((p["label"], p["word"]) for p in row["places"]) == Counter(places)
        assert row["n_words"] == len(words) and 0 <= row["score"] <= 1


def test_licence_labels(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["base_labels"], r["labels"]) for r in licences.summary(licences.scan(docs)).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [
        ("", "apache"), ("", "mit"), ("", "bsd"), ("gpl", "gpl"), ("cc-by", "cc-by,cc-by-nc"), ("cc-by", "cc-by"),
        ("reserved", "reserved"), ("reserved", "reserved"), ("", ""), ("", "mit"), ("", ""), ("", ""), ("", ""), ("", ""),
    ]


def test_filters_lose_nothing_in_any_order_of_words():
    texts = [n for n in NOTICES if n] + [t for _, t, _ in licences.TEMPLATES]
    for seed in range(5):
        known = sorted({w for _, t, _ in licences.TEMPLATES for w in licences.words(t.encode())})
        counts = dict(zip(known, np.random.default_rng(seed).permutation(len(known)).tolist(), strict=True))
        index = licences.Index(licences.TEMPLATES, counts, 0.8)
        for text in texts:
            found = index.scan(text.encode())[2]
            assert Counter((b[1], b[4]) for b in found) == Counter((t, s) for t, _, s in plain_blocks(text))


def test_licence_odd_inputs(odd, nothing):
    got = licences.summary(licences.scan(odd)).collect()
    assert len(got) == odd.count()
    assert all(r["n_words"] == 0 == r["score"] for r in got if not (r["row"]["text"] or "").strip())
    assert licences.scan(nothing).count() == 0


# Alignment


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, links, groups), or None without tokens."""
    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        spelled_a = [bytes(byte[c] for c in a_library.id_to_token(i)) for i in a]
        spelled_b = [
            bytes([int(b_library.id_to_piece(i)[3:5], 16)]) if b_library.is_byte(i)
            else b_library.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(s) for s in spelled_a]), np.cumsum([len(s) for s in spelled_b])
        starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
        links = [
            (a[i], b[j]) for j in range(len(b))
            for i in range(np.searchsorted(ends_a, starts_b[j], "right"), np.searchsorted(starts_a, ends_b[j], "left"))
        ]
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        groups = [
            ",".join(str(x) for x, s, e in zip(a, starts_a, ends_a, strict=True) if p <= s and e <= q) + "|"
            + ",".join(str(x) for x, s, e in zip(b, starts_b, ends_b, strict=True) if p <= s and e <= q)
            for p, q in zip(cuts, cuts[1:], strict=False)
        ] if len(a) < 500 else None
        out.append((len(a), len(b), len(cuts) - 1, links, groups and ";".join(groups)))
    return out


def expected(texts):
    found = plain_alignment(texts)
    counts = Counter(link for f in found if f for link in f[3])
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (
            f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
            f[4] and hashlib.sha256(f[4].encode()).hexdigest())
        for f in found
    ]


TRICKY = [
    None, "", " ", "a ", "a  ", " a", "x  y   z ", "\n\n x", "\n\nx\t y", "don't we'll  'S", "▁a b", "中文 字符 没有", "😀😀 x",
    "a\x00b c", "\x1c\x1d x", "é ñ ²³ ½ x¼2", "<|endoftext|> <s> </s>", "tab\tsep\r\nx", "1234567 12 3", "''s'S",
    "xx" * 3000, "word " * 1000, "İİ ſ ﬁ ① Ⅷ", "<0x0A> <unk>", "word", "word", "a" * 700 + "b" * 700,
]


def test_alignment_equals_brute_force(spark, sf):
    texts = TRICKY + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, chunk int").repartition(3)
    got = {r["row"]["doc_id"]: tuple(r)[1:] for r in alignment.link_counts(docs).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(expected(texts)):
        n_a, n_b, n_groups, n_links, sha, n_best, count_sum = got[k]
        assert (n_a, n_b, n_groups, n_links, n_best, count_sum) == want[:6], texts[k]
        assert want[6] is None or sha == want[6]


def test_groups_and_cuts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in alignment.aligned(docs).collect()}
    for k, want in enumerate(plain_alignment(TRICKY)):
        if want is None:
            assert (got[k]["groups"], got[k]["cuts"]) == ("", [])
            continue
        assert want[4] is None or got[k]["groups"] == want[4]
        assert got[k]["cuts"][-1] == len((" " + TRICKY[k]).encode()) and len(got[k]["cuts"]) == want[2]


def test_stretches_and_chunks_change_nothing(spark, monkeypatch):
    by = alignment.aligner(*alignment.default_paths())
    texts = [t or "" for t in TRICKY]
    results = []
    for stretch in (1, 7, 256, 10**6):
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        found = by.walk(texts)
        order = np.lexsort((found.links_a, found.links_b))
        results.append((found.links_a[order].tolist(), found.links_b[order].tolist(), found.cuts_a.tolist(), found.groups()))
    assert results[0] == results[1] == results[2] == results[3]


def test_alignment_odd_inputs(odd, nothing):
    got = alignment.link_counts(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if not r["row"]["text"]:
            assert (r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (0, 0, 0, 0, "")
    assert alignment.link_counts(nothing).count() == 0 == alignment.aligned(nothing).count()
