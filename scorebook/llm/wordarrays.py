"""Texts of an Arrow column as numpy arrays: bytes, words, and hashes of bytes, words and windows.

All hashes are 64-bit sums of mixed values times powers of an odd base, taken from running sums, so a
window of any length costs the same. ``lane`` selects one of several independent hash functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on, so that its arrays stay small; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the lane's base and of its inverse, modulo 2**64."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        made = []
        for b in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            p = np.full(max(n, CHUNK_BYTES + 1), b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if n <= 3 * CHUNK_BYTES + 1:  # those of a longer document go again
            _powers[lane] = have
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of values[s:e] for each span; equal content gives equal hashes wherever it stands."""
    up, down = powers(len(values) + 1, lane)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Chunk:
    """Some consecutive documents: rows first .. first + n of the batch, their bytes and places of bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, space: np.ndarray = SPACE) -> Words:
        """Maximal runs of bytes that are not in ``space``; no word crosses documents."""
        data, offs = self.data, self.offsets
        inside = ~space[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            full = offs[:-1][offs[:-1] < offs[1:]]
            before[full] = False
            after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(self, starts, ends, np.searchsorted(starts, offs))


@dataclass
class Words:
    """Words of a chunk: places of their bytes, and ``doc``: the first word of each document, and the count."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    def hashes(self, lane: int = 0, data: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(_BYTE[lane][self.chunk.data if data is None else data], self.starts, self.ends, lane)

    def owner(self) -> np.ndarray:
        """For each word the index of its document in the chunk."""
        return np.repeat(np.arange(self.chunk.n), np.diff(self.doc))

    def place(self) -> np.ndarray:
        """For each word its number in its document."""
        return np.arange(len(self.starts)) - np.repeat(self.doc[:-1], np.diff(self.doc))


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, length: int | np.ndarray, lane: int = 0) -> np.ndarray:
    return span_hashes(word_hashes, starts, starts + length, lane)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string or binary column, in order, about ``limit`` bytes at a time."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Chunk(at, data[offs[at]: offs[to]], offs[at: to + 1] - offs[at])
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers s, s+1, … of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
