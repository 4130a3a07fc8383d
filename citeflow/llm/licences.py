"""Licence scan: text blocks that contain a licence notice, by an exact set-similarity join.

A template is the set of its words. A block contains it when it holds at least ``threshold`` of them. Words are ordered
by their number in the whole corpus, rarest first. A block that reaches the threshold shares one of the template's first
words in this order (prefix filter), holds enough words (length filter), and at the first shared word enough words are
left on both sides (positional filter). What remains is compared in full. Words outside all templates
cannot be shared and are left out of blocks beforehand.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a word is, on UTF-8 bytes after lower-casing A-Z, and the phrases of the base labels.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.8

# Usual wordings of licence notices. The third entry lists the words without which a block names another
# licence, however much of the wording it shares.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     "apache"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Licensed under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     "permission sublicense"),
    ("bsd", "Released under the BSD License", "bsd license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "redistribution binary"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version", "gnu general redistribute"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation", "gnu lesser redistribute"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation", "gnu affero redistribute"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies",
     "permission fee copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0", "Released into the public domain under CC0 1.0", "cc0"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     "creative commons attribution"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     "creative commons sharealike"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     "creative commons noncommercial"),
    ("reserved", "All rights reserved", "rights reserved"),
]
BLOCK = "array<struct<label:string,template:int,first_word:long,last_word:long,share:double>>"
PLACE = "array<struct<label:string,word:long>>"


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Index:
    """Templates in the corpus-wide order of words, with the first words of each listed for look-up.

    Its size is that of the list of templates, whatever the corpus.
    """

    def __init__(self, templates, counts: dict[bytes, int], threshold: float):
        sets = [frozenset(words(text.encode())) for _, text, _ in templates]
        lengths = [len(words(text.encode())) for _, text, _ in templates]
        known = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(known)}
        self.labels = [label for label, _, _ in templates]
        self.sets = [frozenset(self.rank[w] for w in s) for s in sets]
        self.least = [max(1, ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.needed = [frozenset(self.rank[w] for w in words(key.encode())) for _, _, key in templates]
        # Blocks of a template: windows of twice a power of two that is no less than its words, half overlapping.
        self.lists: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.starts: dict[bytes, set[int]] = {}
        for t, s in enumerate(self.sets):
            half = 1 << max(2, (lengths[t] - 1).bit_length())
            for i, token in enumerate(sorted(s)[: len(s) - self.least[t] + 1]):
                self.lists.setdefault(half, {}).setdefault(token, []).append((t, i))
                self.starts.setdefault(known[token], set()).add(half)
        self.phrases = [(tuple(words(p.encode())), label) for p, label in PHRASES.items()]
        # A phrase is looked for at its rarest word.
        self.anchors: dict[bytes, list[tuple[int, tuple[bytes, ...], str]]] = {}
        for phrase, label in self.phrases:
            at = min(range(len(phrase)), key=lambda k: (counts.get(phrase[k], 0), phrase[k]))
            self.anchors.setdefault(phrase[at], []).append((at, phrase, label))
        self.watched = frozenset(self.starts) | frozenset(self.anchors)

    def joined(self, half: int, block: list[int]) -> list[tuple[int, int]]:
        """Templates that a block (its ranks in order) contains, with the number of words shared."""
        found, seen, held = [], set(), None
        size = len(block)
        for j, token in enumerate(block):
            for t, i in self.lists[half].get(token, ()):
                least, whole = self.least[t], self.sets[t]
                if t in seen or size < least or j > size - least:  # length and prefix filters
                    continue
                seen.add(t)
                if 1 + min(len(whole) - i - 1, size - j - 1) < least:  # positional filter
                    continue
                held = held or frozenset(block)
                shared = len(whole & held)
                if shared >= least and self.needed[t] <= held:
                    found.append((t, shared))
        return found

    def scan(self, text: bytes):
        """Number of words, places of phrases (label, word), blocks (as BLOCK)."""
        found = words(text)
        watched = self.watched
        at = [(i, w) for i, w in enumerate(found) if w in watched]
        places, windows = [], set()
        for i, w in at:
            for offset, phrase, label in self.anchors.get(w, ()):
                start = i - offset
                if start >= 0 and tuple(found[start : start + len(phrase)]) == phrase:
                    places.append((label, start))
            for half in self.starts.get(w, ()):
                windows.update((half, k) for k in (i // half - 1, i // half) if k >= 0)
        blocks = []
        for half, k in sorted(windows):
            begin = half * k
            ranks = [(self.rank[w], begin + p) for p, w in enumerate(found[begin : begin + 2 * half]) if w in self.rank]
            for t, shared in self.joined(half, sorted({r for r, _ in ranks})):
                own = [p for r, p in ranks if r in self.sets[t]]
                blocks.append((self.labels[t], t, own[0], own[-1], shared / len(self.sets[t])))
        return len(found), sorted(places, key=lambda p: (p[1], p[0])), blocks


def counted(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in the whole corpus."""
    known = frozenset(w for _, t, _ in templates for w in words(t.encode())) | frozenset(
        w for p in PHRASES for w in words(p.encode())
    )

    def per_task(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                total.update(filter(known.__contains__, words(value.as_py())))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())}
        )

    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    sums = raw.mapInArrow(per_task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in sums.collect()}  # one row a word of the templates


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, keep: list[str] | None = None,
         text: str = "text") -> DataFrame:
    """A row for each document: ``row`` (its columns, or those in ``keep``), ``n_words``, ``places`` (base phrases: label and first
    word), ``blocks`` (template, words from the first to the last shared one, share of the template's words).

    A run of words as long as the template plus one lies in a block as a whole, wherever it begins, across lines. One
    notice may be found in the two blocks that overlap there.

    Defined cases: null, empty and wordless texts have no words, places or blocks. Repeated rows each get their own row;
    nulls and extra columns are carried along. A text is read whole, however long. No rows give no rows.
    """
    counts = counted(docs, templates, text)
    columns = keep or docs.columns
    frame = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    shape = frame.select(
        "row", F.lit(0).cast("long").alias("n_words"), F.array().cast(PLACE).alias("places"),
        F.array().cast(BLOCK).alias("blocks"),
    ).schema
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block = pa.list_(pa.struct([
        ("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("share", pa.float64()),
    ]))

    def per_task(batches):
        index = Index(templates, counts, threshold)
        names = [f.name for f in block.value_type]
        for batch in batches:
            found = [index.scan(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                pa.array([[{"label": a, "word": b} for a, b in f[1]] for f in found], place),
                pa.array([[dict(zip(names, b, strict=True)) for b in f[2]] for f in found], block),
            ], names=shape.names)

    return frame.mapInArrow(per_task, shape)


def summary(found: DataFrame) -> DataFrame:
    """``scan``'s rows with ``base_labels``, ``labels`` (distinct, in order, joined by commas) and ``score``: the greatest share
    of a template found, 1 for a base phrase, 0 for nothing."""
    base, own = F.col("places")["label"], F.col("blocks")["label"]
    share = F.coalesce(F.array_max(F.col("blocks")["share"]), F.lit(0.0))
    return found.select(
        "*", F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = summary(scan(docs, keep=["doc_id"]))
    starts = F.col("places")["word"]
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        "base_labels", "labels", "score",
    )


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The query's rows by comparing every block with every template."""

    def listed(found) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in found) + "]::VARCHAR[]"

    rows = []
    for label, text, key in templates:
        found = words(text.encode())
        least = max(1, ceil(threshold * len(set(found)) - 1e-9))
        half = 1 << max(2, (len(found) - 1).bit_length())
        rows.append(f"('{label}', {listed(sorted(set(found)))}, {listed(words(key.encode()))}, {half}, {least})")
    phrases = ", ".join(f"('{label}', {listed(words(p.encode()))})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t(label, own, need, half, least) AS (VALUES {", ".join(rows)}
), p(label, own) AS (VALUES {phrases}
), windows AS (
  SELECT r, half, list_distinct(w[k * half + 1 : k * half + 2 * half]) AS b
  FROM (SELECT r, w, half, unnest(range(0, (len(w) + half - 1) // half)) AS k FROM d, (SELECT DISTINCT half FROM t))
), blocks AS (
  SELECT r, label, len(list_intersect(b, own)) AS shared, len(own) AS size
  FROM windows JOIN t USING (half) WHERE len(list_intersect(b, own)) >= least AND list_has_all(b, need)
), places AS (
  SELECT r, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(own) - 1] = own)) - 1 AS at FROM d, p
), base AS (
  SELECT r, count(*) AS n, min(at) AS lo, max(at) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM places UNION SELECT r, label FROM blocks) GROUP BY r
), shares AS (SELECT r, max(shared / size) AS score FROM blocks GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  base.lo AS first_word, base.hi AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(shares.score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN shares USING (r)
"""
