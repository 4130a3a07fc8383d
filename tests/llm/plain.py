"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def word_shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar_groups(sets: list[set]) -> list[int]:
    """Least index of the component of each set, linked at a Jaccard similarity of 0.8."""
    groups, seen = Groups(range(len(sets))), defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in seen[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                groups.join(i, j)
        for g in s:
            seen[g].append(i)
    return [groups.root(i) for i in range(len(sets))]


def line_key(line):
    return line.strip(" \t\n\x0b\f\r").lower()


def deduped_lines(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """Text by doc_id with one line of each class of similar lines."""
    rows = sorted(rows)
    first: dict[str, tuple[int, int]] = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line_key(line):
                first.setdefault(line_key(line), (i, k))
    names = list(first)
    of = similar_groups([{n[k : k + 9] for k in range(max(1, len(n) - 8))} for n in names])
    keeper = {n: names[of[i]] for i, n in enumerate(names)}
    out = {}
    for i, text in rows:
        kept = [
            line for k, line in enumerate((text or "").split("\n"))
            if not line_key(line) or (keeper[line_key(line)] == line_key(line) and first[line_key(line)] == (i, k))
        ]
        out[i] = None if text is None else "\n".join(kept)
    return out


def quality_counts(text):
    w, seen, repeated_lines = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated_lines, len(covered)


def mix_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        share = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else share * weight[s] / rest for s in names}
        more = {s for s in names if target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def syncmers(text, k, s):
    """Positions of the windows whose least inner substring, by the given hash, is at an edge."""
    import xxhash

    def h(x):
        v = xxhash.xxh64_intdigest(x.encode("utf-32-be"), seed=42)
        return v - (1 << 64) if v >> 63 else v

    inner = [h(text[i : i + s]) for i in range(len(text) - s + 1)]
    n = k - s + 1
    return [
        (i, h(text[i : i + k]) & 0xFFFFFFFF) for i in range(len(text) - k + 1)
        if min(inner[i : i + n]) in (inner[i], inner[i + n - 1])
    ]
