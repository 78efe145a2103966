"""Splitting texts into the pieces that byte-pair merges never cross, for many texts at once.

The splits follow published patterns. Texts whose code points all lie below ``PLAIN`` are split
here with array operations; a text with any other code point, or with a special token's string,
is left to the caller, who uses the tokenizer library's own splitter for it.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Code points below this are split here: Latin with its extensions.
PLAIN = 0x250
LETTER, NUMBER, SPACE, OTHER, END = range(5)


def classes() -> np.ndarray:
    """Class of each plain code point; \\s of the pattern is not quite ``str.isspace``."""
    out = np.full(PLAIN, OTHER, dtype=np.uint8)
    for i in range(PLAIN):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            out[i] = LETTER
        elif major == "N":
            out[i] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


CLASS = classes()
#: Fixed values of the published patterns: endings split off after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text followed by one end mark, and where each text begins."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return codes, begins


def _contractions(codes: np.ndarray, kind: np.ndarray, begins_piece: np.ndarray, after_blank: bool) -> list[tuple[np.ndarray, int]]:
    """(places of apostrophes that begin a contraction, its length)."""
    n = len(codes)
    at = np.flatnonzero(codes == 39)
    at = at[(at + 1 < n)]
    if not len(at):
        return []
    at = at[begins_piece[at]]
    if not after_blank:
        at = at[(at == 0) | (codes[np.maximum(at, 1) - 1] != 32)]
    one = codes[at + 1]
    short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
    two = np.where(at + 2 < n, codes[np.minimum(at + 2, n - 1)], 0)
    long = np.zeros(len(at), dtype=bool)
    for a, b in LONG_ENDINGS:
        long |= (one == ord(a)) & (two == ord(b))
    return [(at[short], 2), (at[long & ~short], 3)]


def split_keeping_blanks(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (start, end) of the byte-level pattern: every code point but the end marks is kept.

    A blank goes with what follows it; of a longer run of white space only the last sign can.
    """
    n = len(codes)
    kind = CLASS[codes]
    kind[begins[1:] - 1] = END
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    ends_run = np.ones(n, dtype=bool)
    ends_run[:-1] = change[1:]
    following = np.full(n, END, dtype=np.uint8)
    following[:-1] = kind[1:]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = codes[:-1] == 32
    last = (kind == SPACE) & ends_run & (following != END)  # last white space before a visible sign
    start = change & ~(blank_before & (kind != SPACE) & (kind != END))
    start |= last
    for at, size in _contractions(codes, kind, change, after_blank=False):
        start[at] = True
        for k in range(1, size):
            start[at + k] = False
        start[at + size] = True
    start |= kind == END
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    real = kind[at] != END
    return at[real], ends[real]


def split_words(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the word pattern: letter runs, single numbers, runs of other signs; no white space."""
    n = len(codes)
    kind = CLASS[codes]
    kind[begins[1:] - 1] = END
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    change = start.copy()
    start |= kind == NUMBER
    for at, size in _contractions(codes, kind, change, after_blank=True):
        start[at] = True
        for k in range(1, size):
            start[at + k] = False
        start[at + size] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    real = (kind[at] != END) & (kind[at] != SPACE)
    return at[real], ends[real]
