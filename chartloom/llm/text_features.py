"""Features of whole texts that the trained operators share, worked out inside tasks."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from chartloom.llm.common import SPACE
from chartloom.llm.quality import STOP_WORDS

STRUCTURE = ("words", "length", "symbols", "exclaims", "capitals", "digits", "different", "echoes", "repeated_lines",
             "lines", "bars", "stops", "marks", "other_bytes")
_WORD = re.compile(f"[^{SPACE}]+")
_STOPS = frozenset(STOP_WORDS)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [ord(c) for c in ".,;:?\"'()-"]


def split_words(text: str) -> list[str]:
    return _WORD.findall(text)


def structure(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """One number for each name in ``STRUCTURE``; all zero for texts without words."""
    out = np.zeros(len(STRUCTURE), "float32")
    n = len(words)
    if not n:
        return out
    by = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"), minlength=256)
    chars = max(1, len(text))
    letters = max(1, int(by[_UPPER].sum() + by[_LOWER].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    echoes = sum(map(str.__eq__, words, words[1:]))
    stops = sum(c for w, c in counts.items() if w in _STOPS)
    out[:] = (
        np.log1p(n), chars / n, by[_SYMBOLS].sum() / n, by[33] / n, by[_UPPER].sum() / letters, by[_DIGIT].sum() / chars,
        len(counts) / n, echoes / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(lines) / n, by[124] / n,
        stops / n, by[_MARKS].sum() / n, by[128:].sum() / chars,
    )
    return out
