"""Arrow and numpy helpers shared by the operators that scan whole texts.

Every helper works on one slice of a record batch, so memory is bounded by the slice
(``SLICE_BYTES`` of text, or one text if that is longer), never by the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def filled(column: pa.Array) -> pa.Array:
    """The texts with null as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 byte offsets of a text column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give memory that is free back to the system: a worker process outlives its task, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about ``limit`` bytes of ``text``; a longer text stands alone."""
    done = 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        lo, base = 0, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            base, lo = int(ends[hi - 1]), hi
        done += int(ends[-1])
        if done >= 4 * limit:
            release()
            done = 0
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run: differences of prefix sums, brought to a common power."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of word bytes, and for each text the first word's number (n + 1 numbers)."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = is_word[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]  # a word never reaches over from one text to the next
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


#: Bytes that are read at once, and by length which of them count.
WIDE = 24
_WITHIN = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(WIDE + 1)], np.uint64)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def heads(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first WIDE bytes of each run as three words; zero where it ends before."""
    padded = np.zeros(len(raw) + WIDE, np.uint8)
    padded[: len(raw)] = raw
    rows = np.ndarray((len(raw) + 1,), f"V{WIDE}", padded, strides=(1,))[starts].view("<u8").reshape(-1, 3)
    rows &= _WITHIN.take(np.minimum(lengths, WIDE), axis=0)
    return rows


def head_hashes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = rows[:, 0] * _SPREAD[0]
    total += rows[:, 1] * _SPREAD[1]
    total += rows[:, 2] * _SPREAD[2]
    total += lengths.astype(np.uint64) * _SPREAD[3]
    return mix(total)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; memory is by runs, not by bytes."""
    lengths = ends - starts
    out = head_hashes(heads(low, starts, lengths), lengths)
    rest, at = np.flatnonzero(lengths > WIDE), WIDE
    while len(rest):
        left = lengths[rest] - at
        out[rest] = mix(out[rest] ^ head_hashes(heads(low, starts[rest] + at, left), left))
        at += WIDE
        rest = rest[left > WIDE]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A text column over the bytes, without a copy."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


class UnitCache:
    """Ids of byte strings, so that each distinct one is encoded once; found by comparing whole strings, in numpy.

    ``encode`` takes a list of distinct texts and gives their ids as one array, and the number of ids of each. At most
    ``limit`` strings are kept (some 60 bytes each), or those of one call; then the cache starts anew, which costs time
    and changes no result.
    """

    #: Strings of more bytes are kept in a dictionary; a key's last byte is one more than the length.
    SHORT = WIDE - 1

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = 0
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((1 << 12, 3), np.uint64)
        self.ids, self.starts, self.lengths = np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.table = np.full(1 << 14, -1, np.int32)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _find(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each string, or -1."""
        mask = len(self.table) - 1
        slot = (hashes & np.uint64(mask)).view(np.int64)
        said = self.table.take(slot)
        differ = self.keys.take(np.maximum(said, 0), axis=0)
        differ ^= rows
        same = (differ[:, 0] | differ[:, 1] | differ[:, 2]) == 0
        out = np.where(same & (said >= 0), said, -1).astype(np.int64)
        todo = np.flatnonzero(~same & (said >= 0))
        slot = slot[todo]
        while len(todo):  # the place is another string's: look on
            slot = (slot + 1) & mask
            said = self.table.take(slot)
            there = np.flatnonzero(said >= 0)
            todo, slot, said = todo[there], slot[there], said[there]
            same = (self.keys.take(said, axis=0) == rows.take(todo, axis=0)).all(axis=1)
            out[todo[same]] = said[same]
            todo, slot = todo[~same], slot[~same]
        return out

    def _place(self, first: int) -> None:
        """Enter the strings from number ``first`` on."""
        if 2 * self.n > len(self.table):
            self.table = np.full(1 << int(4 * self.n - 1).bit_length(), -1, np.int32)
            first = 0
        mask = len(self.table) - 1
        todo = np.flatnonzero(self.keys[first : self.n, 2]) + first  # long ones have no key
        rows = self.keys[todo]
        slot = (head_hashes(rows, np.zeros(len(rows), np.int64)) & np.uint64(mask)).view(np.int64)
        while len(todo):
            free = np.flatnonzero(self.table.take(slot) < 0)
            self.table[slot[free]] = todo[free]
            left = np.flatnonzero(self.table.take(slot) != todo)
            todo, slot = todo[left], (slot[left] + 1) & mask

    def _add(self, rows: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encode texts; their numbers. Rows of zeros are not entered."""
        flat, lengths = self.encode(texts)
        first, self.n = self.n, self.n + len(texts)
        for name, need in (("keys", self.n), ("starts", self.n), ("lengths", self.n), ("ids", self.used + len(flat))):
            self._room(name, need)
        self.keys[first : self.n] = rows
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : self.n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : self.n] = lengths
        self.used += len(flat)
        self._place(first)
        return np.arange(first, self.n)

    def lookup(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all runs of bytes in order, and the number of ids of each."""
        rows = heads(raw, starts, np.minimum(lengths, self.SHORT))
        rows[:, 2] |= np.minimum(lengths + 1, 255).astype(np.uint64) << np.uint64(56)
        hashes = head_hashes(rows, np.zeros(len(rows), np.int64))
        short = lengths <= self.SHORT
        which = np.where(short, self._find(rows, hashes), -1)
        missing = np.flatnonzero((which < 0) & short)
        if self.n and self.n + len(missing) > self.limit:
            _, first = np.unique(hashes[missing], return_index=True)
            if self.n + len(first) > self.limit:
                self._clear()
                which[:] = -1
                missing = np.flatnonzero(short)
        data = raw.tobytes() if len(missing) or not short.all() else b""
        while len(missing):  # again for strings whose hashes are equal
            _, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            new = self._add(rows[at], [data[a : a + n].decode() for a, n in zip(starts[at].tolist(), lengths[at].tolist())])
            same = (rows[missing] == rows[at][back]).all(axis=1)
            which[missing[same]] = new[back[same]]
            missing = missing[~same]
        if not short.all():
            some = np.flatnonzero(~short)
            said = [data[a : a + n] for a, n in zip(starts[some].tolist(), lengths[some].tolist())]
            fresh = [x for x in dict.fromkeys(said) if x not in self.long]
            if fresh:
                self.long.update(zip(fresh, self._add(np.zeros((len(fresh), 3), np.uint64), [x.decode() for x in fresh]).tolist()))
            which[some] = [self.long[x] for x in said]
        counts = self.lengths.take(which)
        return self.ids.take(ragged(self.starts.take(which), counts)), counts

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of an array of texts."""
        raw, offsets = buffers(pieces)
        return self.lookup(raw, offsets[:-1], np.diff(offsets))


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """What ``UnitCache`` wants of lists of ids."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths


def space_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at every space, flat, and n + 1 offsets of each text's pieces."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
