"""What a vocabulary file says, and how its library cuts a text into words before any merge."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

END = "</w>"
# Texts of these characters are normalised and cut here; others by the library's own parts, whose
# tables of letters, digits and combinations then apply.
_PLAIN = re.compile("[\x00-ɏ‐-‧]*")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


def _class(kind: str) -> str:
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    return "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)


class Vocabulary:
    """Tokens, merge ranks and the cutting of texts, from a tokenizer file with byte letters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self._letters = byte_letters()
        self._ascii = {chr(b): self._letters[b] for b in range(128)}
        letters, digits = _class("L"), _class("N")
        # What the file's pattern lists, white space as in Unicode.
        space = "\t-\r \x85\xa0"
        self._words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"
        )
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens in turn, ordinary text first."""
        return self._special.split(text) if "<|" in text else [text]

    def normal(self, segment: str) -> str:
        if _PLAIN.fullmatch(segment):
            return segment.lower()
        return self.library.normalizer.normalize_str(segment)

    def cut(self, normal: str) -> list[str]:
        """Words of a normalised segment."""
        if _PLAIN.fullmatch(normal):
            return self._words.findall(normal)
        return self._by_library(normal)

    def spans(self, normal: str) -> list[tuple[int, int]]:
        """Begin and end of the words in a normalised segment."""
        if _PLAIN.fullmatch(normal):
            return [m.span() for m in self._words.finditer(normal)]
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _by_library(self, normal: str) -> list[str]:
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def letters(self, word: str) -> str:
        """A word in byte letters."""
        if word.isascii() and word.isprintable():
            return word
        return "".join(self._letters[b] for b in word.encode())

    def merged(self, atoms: tuple[str, ...]) -> list[str]:
        """Tokens of a run of atoms: again and again the pair of the least rank, the leftmost of them."""
        none, rank = 1 << 30, self.ranks.get
        parts = list(atoms)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
