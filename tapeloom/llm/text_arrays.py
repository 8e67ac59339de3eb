"""Texts as numpy arrays of code points: letters, lower case, and where words begin and end."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points handled at once; bounds the memory that a batch or a very long text takes.
PIECE = 1 << 20


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower case (0 for those that are none)."""
    n = 0x110000
    letter = np.frombuffer(bytes(map(str.isalpha, map(chr, range(n)))), np.uint8).astype(bool)
    lower = np.where(letter, np.arange(n, dtype=np.uint32), 0).astype(np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return letter, lower


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE code points, cut where no letter stands if there is such a place."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and end < at + PIECE + 1000 and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Indexes of consecutive texts that have PIECE code points together, or one longer text."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > PIECE:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, owner) of texts joined by a line feed.

    codes: lower-cased letters, 0 elsewhere and at both ends; the words are codes[starts:ends];
    owner: the index of the text that a word is in.
    """
    joined = "\n".join(texts)
    letter, lower = tables()
    codes = np.zeros(len(joined) + 2, np.uint32)
    codes[1:-1] = lower[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    is_word = (codes != 0).view(np.int8)
    edges = np.diff(is_word)
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] + 1
    return codes, starts, ends, np.searchsorted(firsts, starts, side="right") - 1
