"""Hashed n-grams of words, over many rows at once: of their bytes, or of their characters."""

from __future__ import annotations

import numpy as np
import pandas as pd  # noqa: F401  pandas must be importable where Arrow batches are exchanged

from logloom.llm.base import byte_table

_SEED = np.random.RandomState(77).randint(0, 2**32, (8, 256), dtype=np.uint64).astype(np.uint32)
#: Lower case; ASCII white space, digits and punctuation part the words.
LETTERS = byte_table(b"", lower=True, keep=bytes(range(97, 123)) + bytes(range(128, 256)))


def grams(data: np.ndarray, offsets: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``size`` bytes inside words, a word's edges counting as a byte, and the byte each begins at."""
    if len(data) < size:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    mapped = LETTERS[data]
    n = len(mapped) - size + 1
    out = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        out = (out ^ _SEED[k][mapped[k : n + k]]) * np.uint32(0x85EBCA6B | 1) if k == size - 1 else out ^ _SEED[k][mapped[k : n + k]]
    edge = mapped == 0
    whole = np.ones(n, bool)
    for k in range(1, size - 1):
        whole &= ~edge[k : n + k]
    for k in range(1, size):  # not across rows
        at = offsets[1:-1] - k
        whole[at[(at >= 0) & (at < n)]] = False
    begin = np.flatnonzero(whole)
    value = out[begin]
    return (value ^ (value >> np.uint32(15))) & np.uint32((1 << bits) - 1), begin


def row_sums(values: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count by row of values that begin at the given bytes."""
    cut = np.searchsorted(begin, offsets)
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[cut[1:]] - total[cut[:-1]], np.diff(cut)


#: White space of any script, and ASCII punctuation, which parts words unless a letter or digit stands on both sides.
_SPACE = np.array([c for c in range(0x3001) if c == 0 or chr(c).isspace()], np.uint32)
_MARK = np.zeros(128, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, 0 where words part and around each text, and the row of each; nulls are empty."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    row = np.repeat(np.arange(len(low)), np.array([len(t) + 1 for t in low], np.int64))
    small = codes < 0x3001
    blank = np.zeros(0x3001, bool)
    blank[_SPACE] = True
    space = small & blank[np.where(small, codes, 0)]
    mark = (codes < 128) & _MARK[np.where(codes < 128, codes, 0)]
    word = ~(space | mark)
    inner = np.zeros(len(codes), bool)
    inner[1:-1] = mark[1:-1] & word[:-2] & word[2:]
    codes[space | (mark & ~inner)] = 0
    return codes, row


def character_grams(codes: np.ndarray, sizes: tuple[int, ...], bits: int):
    """First character but one, and bucket, of the n-grams of each size (3 at least) inside words, a word's edges counting as a character."""
    edge = codes == 0
    each = _mixed(codes + np.uint32(0x9E3779B9))
    rolled, whole = each, np.ones(len(codes), bool)
    for k in range(2, max(sizes) + 1):
        n = len(codes) - k + 1
        if n <= 0:
            return
        rolled = rolled[:n] * np.uint32(0x21000193) + each[k - 1 :]
        whole = whole[:n] & ~edge[k - 2 : k - 2 + n] if k > 2 else whole[:n]
        if k in sizes:
            at = np.flatnonzero(whole)
            yield at + 1, ((rolled[at] ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))
