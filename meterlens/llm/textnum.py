"""Texts as NumPy arrays inside tasks: word and shingle hashes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

PIECE = 1 << 18  # bytes hashed at a time: temporaries take about 50 times as much
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_draw = np.random.default_rng(20240607)
BYTE_CODES = _draw.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
PLACES = _draw.integers(1, 2**64, 16, dtype=np.uint64, endpoint=False) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> list[int]:
    """Places between words or texts, about PIECE bytes apart; a longer word stays whole."""
    cuts, at, n = [0], 0, len(data)
    while at < n:
        at = min(at + PIECE, n)
        if at < n:
            text_end = int(offsets[np.searchsorted(offsets, at)])
            stop = at
            while stop < text_end and not space[data[stop]]:
                stop += 1
            at = min(stop, text_end)
        cuts.append(at)
    return cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text).

    Words are runs of bytes that are no white space or, with ``classes`` (of each byte, 0 for white space), of
    bytes of one class.
    """
    hashes, starts_at = [], []
    space = IS_SPACE if classes is None else classes == 0
    cuts = _cuts(data, offsets, space)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = data[lo:hi]
        solid = ~space[part]
        fresh = np.ones(hi - lo, dtype=bool)
        fresh[1:] = ~solid[:-1] if classes is None else classes[part[1:]] != classes[part[:-1]]
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        fresh[inside] = True
        begin = solid & fresh
        where = np.flatnonzero(begin)
        if not len(where):
            continue
        letters = np.flatnonzero(solid)
        first = np.searchsorted(letters, where)
        place = letters - np.repeat(where, np.diff(np.append(first, len(letters))))
        powers = np.cumprod(np.full(int(place.max()) + 1, BASE, dtype=np.uint64))
        hashes.append(mixed(np.add.reduceat(BYTE_CODES[part[letters]] * powers[place], first)))
        starts_at.append(where + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts_at)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, number for each text).

    A text of fewer than ``size`` words, but not none, has one shingle, the whole sequence.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    total = len(words)
    full = np.zeros(0, np.uint64)
    if total >= size:
        full = words[: total - size + 1] * PLACES[0]
        for j in range(1, size):
            full += words[j : total - size + 1 + j] * PLACES[j]
        full = mixed(full)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for k in np.flatnonzero(counts):
        if counts[k] >= size:
            own = np.sort(full[starts[k] : ends[k] - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        else:
            own = words[starts[k] : ends[k]] * PLACES[: counts[k]]
            own = mixed(np.array([own.sum(dtype=np.uint64)]) + PLACES[8 + counts[k]])
        sizes[k] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def equal_parts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the different part that each part is, a part for each of these); hashes propose, bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    powers = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64))
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    hashes = mixed(np.add.reduceat(BYTE_CODES[data] * powers[inside], starts) + sizes.astype(np.uint64))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[which]
    if (sizes[like] != sizes).any() or (data[np.repeat(starts[like], sizes) + inside] != data).any():
        first = which = np.arange(len(starts))
    return which, first


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    run = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
