"""Character trigrams of many texts at once, as numbers.

A trigram of code points a, b, c is the number a << 42 | b << 21 | c. Texts are padded in front with two
`PAD` characters, so that a text of n characters has n trigrams.
"""

from __future__ import annotations

import numpy as np

BITS = 21
PAD = (1 << BITS) - 1
PAIR = (1 << 2 * BITS) - 1
#: Up to this many different trigrams of an alphabet are counted in a plain array.
DIRECT = 1 << 22


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text starts and the last one ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes.astype(np.int64), np.cumsum([0, *map(len, texts)])


def letters_only(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of other characters becomes one space; none is left at the start of a text."""
    seen = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else codes
    letter = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, bool)
    letter[[c for c in seen if chr(c).isalpha()]] = True
    keep = letter[codes] if len(codes) else np.zeros(0, bool)
    codes = np.where(keep, codes, 32)
    before = np.zeros(len(keep), bool)
    before[1:] = keep[:-1]
    starts = ends[:-1]
    before[starts[starts < len(codes)]] = False
    keep = keep | before
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def trigrams(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams, sorted, and for each character the place of its trigram among them."""
    alphabet = np.unique(np.concatenate([codes, [PAD]])) if len(codes) < 64 else None
    if alphabet is None:
        alphabet = np.append(np.flatnonzero(np.bincount(codes)), PAD)
    size = len(alphabet)
    place = np.zeros(int(alphabet[-2]) + 1 if size > 1 else 1, np.int64)
    place[alphabet[:-1]] = np.arange(size - 1)
    c = place[codes]
    starts = ends[:-1]
    starts = starts[starts < len(codes)]

    def earlier(x: np.ndarray) -> np.ndarray:
        y = np.empty_like(x)
        y[1:] = x[:-1]
        y[starts] = size - 1
        return y

    b = earlier(c)
    a = earlier(b)
    ids = (a * size + b) * size + c
    if size**3 <= DIRECT:
        here = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else ids
        where = np.zeros(size**3, np.int64)
        where[here] = np.arange(len(here))
        inverse = where[ids]
    else:
        here, inverse = np.unique(ids, return_inverse=True)
    ab, c = np.divmod(here, size)
    a, b = np.divmod(ab, size)
    return alphabet[a] << 2 * BITS | alphabet[b] << BITS | alphabet[c], inverse
