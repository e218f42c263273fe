"""Words and word shingles of whole Arrow columns of texts, hashed without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Documents in one Arrow batch.
BATCH_ROWS = 1000
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def release_memory() -> None:
    """Gives memory that is free back to the system: a worker goes on to other tasks, and its executor has a limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives free memory back when a task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from made(batches)
        finally:
            release_memory()

    return run


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def text_slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    ends = _offsets(texts)[1:].astype(np.int64)
    at = 0
    while at < len(texts):
        start = ends[at - 1] if at else int(_offsets(texts)[0])
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield at, to
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and each text's end in them, after a leading 0; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = _offsets(texts).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def byte_lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``raw_bytes``, lower-cased, with 8 more bytes at the end."""
    raw, ends = raw_bytes(texts)
    return np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)]), ends


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z lower-cased, and the number of words before each text and in all.

    Words are divided at blank, tab, LF, VT, FF and CR.  Eight bytes are mixed
    in at a time, those of all words together.
    """
    data, ends = byte_lower(texts)
    size = len(data) - 8
    space = _SPACE[data[:size]]
    edge = np.ones(size, bool)
    edge[1:] = space[:-1]
    edge[ends[:-1][ends[:-1] < size]] = True
    starts = np.flatnonzero(edge & ~space)
    last = np.ones(size, bool)
    last[:-1] = space[1:] | edge[1:]
    stops = np.flatnonzero(last & ~space) + 1
    length = stops - starts
    eight = np.ndarray((size + 1,), "<u8", data, 0, (1,))
    hashed = length.astype(np.uint64) * _ODD
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = stops[live] - at
        hashed[live] = scrambled(hashed[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at = live[more], at[more] + 8
    return hashed, np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted in it, all in a row, and where each text's begin, with the end.

    A text of fewer words than ``width`` has one shingle, the whole sequence; one without words has none.
    """
    words, first = word_hashes(texts)
    count = np.diff(first)

    def of(k: int) -> np.ndarray:
        out = np.full(max(0, len(words) - k + 1), k, np.uint64)
        for j in range(k):
            out = (out ^ words[j : j + len(out)]) * _MIX
            out ^= out >> np.uint64(31)
        return scrambled(out)

    full = of(width)
    short = {k: of(k) for k in range(1, width) if (count == k).any()}
    parts = []
    for a, n in zip(first[:-1].tolist(), count.tolist()):
        if n >= width:
            own = np.sort(full[a : a + n - width + 1])
            parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            parts.append(short[n][a : a + 1] if n else words[:0])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else words[:0]), starts


def set_hashes(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; 0 for the empty one."""
    size = np.diff(starts)
    filled = np.flatnonzero(size)
    one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(filled):
        at = starts[:-1][filled]
        total, mixed = np.add.reduceat(scrambled(found + _ODD), at), np.bitwise_xor.reduceat(scrambled(found ^ _MIX), at)
        n = size[filled].astype(np.uint64)
        one[filled] = scrambled((total ^ mixed) + n * _ODD)
        two[filled] = scrambled(total * _MIX + scrambled(mixed + n))
    return one.view(np.int64), two.view(np.int64)
