"""Pre-tokens of a lower-casing BPE vocabulary with word ends, as the library cuts them.

Texts of Latin-1 characters, for which lower-casing and composition need no tables, are cut by one regular expression;
any other text goes through the library's own normaliser and pre-tokeniser."""

from __future__ import annotations

import re

_LETTER, _DIGIT, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_LATIN = re.compile("[\x00-\xff]*")
#: What the fast path assumes of a vocabulary file.
NORMALIZERS, PATTERN = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def fits(spec: dict) -> bool:
    """Whether the parsed vocabulary file has the normaliser and the pattern that ``latin`` stands for."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return [s.get("type") for s in steps] == NORMALIZERS and any(c.get("pattern") == {"Regex": PATTERN} for c in cuts)


def latin(text: str) -> list[str] | None:
    """The pre-tokens of a text, or None where the library must cut it."""
    if not text.isascii() and not _LATIN.fullmatch(text):
        return None
    return _PIECES.findall(text.lower())


class Kept(dict):
    """A dictionary that computes what it lacks and starts anew when it has grown to ``limit`` entries."""

    def __init__(self, make, limit: int = 800_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
