"""Vectorized words, word hashes and word n-gram hashes over Arrow string columns.

A column's UTF-8 bytes are read in place. Words are maximal runs of bytes that a 256-entry table does not
mark as separators; A-Z count as a-z. Bytes of multi-byte characters are >= 0x80, so ASCII separators never
cut one. Hashes are 64-bit and depend on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators \x20 and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Separators: all ASCII but digits and letters.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = PUNCT[128:] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        n = max(n, _PIECE)
        with np.errstate(over="ignore"):
            out = np.full(n, base, dtype=U)
            out[0] = 1
            _powers[name] = have = np.multiply.accumulate(out)
    return have


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is an empty string."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.fill_null("").cast(pa.large_string())
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the n + 1 word offsets of the rows."""
    return spans(data, offsets, separators)[:2]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, with the first byte of every word and the one after its last. A word of any length costs no memory but a block's."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
            hi = ends[to - 1]
            if hi - lo > _PIECE:  # one long word, in blocks
                out[at] = _long(data[lo:hi])
                at = to
                continue
            part = (LOWER[data[lo:hi]].astype(U) + U(1)) * _pow("up", _BASE, hi - lo)[: hi - lo]
            total = np.zeros(hi - lo + 1, U)
            np.cumsum(part, out=total[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (total[e] - total[s]) * _pow("down", _INVERSE, hi - lo)[s] + (e - s).astype(U)
            at = to
        return mix(out), rows, starts, ends


def _long(word: np.ndarray) -> np.uint64:
    """The sum that `spans` forms for a word, block by block."""
    powers, total, scale = _pow("up", _BASE, _PIECE)[:_PIECE], 0, 1
    step = pow(_BASE, _PIECE, 1 << 64)
    for k in range(0, len(word), _PIECE):
        part = word[k : k + _PIECE]
        total += scale * int(((LOWER[part].astype(U) + U(1)) * powers[: len(part)]).sum(dtype=U))
        scale = scale * step % (1 << 64)
    return U((total + len(word)) % (1 << 64))


def plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words as lower-case bytes with one blank between."""
    return b" ".join(LOWER[data[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences inside each row and their offsets; position k of a row starts at its word k."""
    count = np.maximum(np.diff(rows) - n + 1, 0)
    at = np.zeros(len(rows), np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U), at
    with np.errstate(over="ignore"):
        whole = np.full(len(hashes) - n + 1, U(n) * U(0xD6E8FEB86659FD93), U)
        for k in range(n):
            whole += hashes[k : len(hashes) - n + 1 + k] * U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        keep = np.arange(at[-1]) + np.repeat(rows[:-1] - at[:-1], count)
        return mix(whole[keep]), at


def gram_pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each range of rows: word hashes (split at white space) and word offsets, `width`-word hashes and their offsets."""
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1]
        h, rows = words(data[part[0] : part[-1]], part - part[0], SPACES)
        yield h, rows, *grams(h, rows, width)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles: `width` words (split at white space), the whole sequence if it has fewer, none without words."""
    for piece in gram_pieces(data, offsets, width):
        yield from sets_of(*piece, width)


def sets_of(h: np.ndarray, rows: np.ndarray, g: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sets of `shingle_sets` from a piece of `gram_pieces`."""
    for i in range(len(rows) - 1):
        size = rows[i + 1] - rows[i]
        if size >= width:
            yield np.unique(g[at[i] : at[i + 1]])
        elif size:
            yield grams(h[rows[i] : rows[i + 1]], np.array([0, size]), int(size))[0]
        else:
            yield h[:0]


def weighed_sets(data: np.ndarray, offsets: np.ndarray, width: int, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `shingle_sets`, and beside every shingle the sum of its words' weights (a table by the top bits of a word's hash)."""
    bits = U(64 - (len(weights).bit_length() - 1))
    for h, rows, g, at in gram_pieces(data, offsets, width):
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(weights[(h >> bits).astype(np.int64)], out=total[1:])
        for i, s in enumerate(sets_of(h, rows, g, at, width)):
            lo, hi = rows[i], rows[i + 1]
            if hi - lo >= width:
                sums = total[lo + width : hi + 1] - total[lo : hi + 1 - width]
                yield s, sums[np.unique(g[at[i] : at[i + 1]], return_index=True)[1]]
            else:
                yield s, np.full(len(s), total[hi] - total[lo])
