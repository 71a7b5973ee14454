"""Texts as arrays of folded code points, for work on whole batches at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLANK, GAP = 32, 0


@lru_cache(2)
def folding(digits: bool) -> np.ndarray:
    """Code point to its lower case, or to a blank where it is no letter (or digit)."""
    keep = str.isalnum if digits else str.isalpha
    return np.array([ord(chr(c).lower()[0]) if keep(chr(c)) else BLANK for c in range(0x110000)], np.uint32)


def folded(text: str, digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, their offsets in the text): lower case, with one blank for every run
    of other characters than letters (and digits) between words."""
    codes = folding(digits)[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = codes == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    codes = codes[at]
    if len(codes) and codes[-1] == BLANK:
        codes, at = codes[:-1], at[:-1]
    return codes, at


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the words of folded code points."""
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    blanks = np.flatnonzero((codes == BLANK) | (codes == GAP))
    begin = np.concatenate(([0], blanks + 1))
    end = np.concatenate((blanks, [len(codes)]))
    real = end > begin
    begin, end = begin[real], end[real]
    if not len(begin):
        return begin.astype(np.uint64), begin, end
    owner = np.concatenate((np.full(begin[0], begin[0]), np.repeat(begin, np.diff(np.append(begin, len(codes))))))
    inside = np.maximum(np.arange(len(codes)) - owner, 0)
    letter = np.where((codes == BLANK) | (codes == GAP), np.uint64(0), codes.astype(np.uint64) + np.uint64(1))
    weight = _powers(int(inside.max()) + 1)
    hashed = np.add.reduceat(letter * weight[inside], begin)
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return hashed ^ (hashed >> np.uint64(29)), begin, end


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))))
