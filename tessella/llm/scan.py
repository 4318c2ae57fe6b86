"""Vectorised work on the bytes of many texts at once: pieces of Arrow batches, words, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about this many bytes; a single longer text is a piece of its own.
PIECE = 1 << 20

#: Multiplier of the polynomial word hash (odd, so that it has an inverse modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[str, np.ndarray] = {}


def _power(of: int, n: int) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64; kept and doubled as needed."""
    got = _powers.get(str(of))
    if got is None or len(got) < n:
        size = max(PIECE * 2, n)
        got = np.full(size, of & (2**64 - 1), dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 8 * PIECE:
            _powers[str(of)] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes uint8, offsets int64 of rows + 1) over a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of word bytes; a run never crosses from row to row."""
    n = len(is_word)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | fresh[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 per word: a polynomial in its bytes and its length, from prefix sums over the whole piece."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(INVERSE, len(data))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the piece with one space after each: bytes, and each word's start and end in them."""
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - 1
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    if len(starts):
        src = np.flatnonzero(is_word)
        word = np.repeat(np.arange(len(starts)), lengths)
        out[np.arange(len(src)) + word] = data[src]
    return out, to - lengths, to
