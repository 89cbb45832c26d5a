"""Plain measurements of one UTF-8 text, exact over the whole of it."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Above so many words windows are compared as numbers instead of tuples.
LONG = 200_000


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= LONG and len(set(zip(*(words[i:] for i in range(window)), strict=False))) == n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    place = ids
    for k in range(1, window):
        place = np.unique(place[: len(ids) - k] * len(seen) + ids[k:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(place)[place] > 1)
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def code_points(text: bytes) -> int:
    a = np.frombuffer(text, np.uint8)
    return int(((a & 0xC0) != 0x80).sum())


def word_chars(text: bytes) -> int:
    """Code points in words: all but the six ASCII white-space characters."""
    return code_points(text) - sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))


def symbols(text: bytes) -> int:
    return sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
