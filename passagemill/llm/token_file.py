"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment holds whole documents; its ids are cut into blocks of about ``BLOCK`` ids. Each block starts from a fresh
model. Order 2 and order 1 each predict an id from what followed the same two ids, or the same one, before, with a
chance that adapts; the more trusted of both is the guess. The chance that it holds is mixed, by a logistic mixer that
learns as it goes, from what orders 2, 1 and 0 say of it. Ids that are not guessed are coded by order 0, the adaptive
distribution of all ids of the block so far. Each of these decisions narrows the interval of a range coder.

A block is coded as many lanes side by side, each a run of neighbouring ids with its own coder; all lanes share one
model, which learns from all of them after each step. Everything that decides an interval is computed in integers, so
that any machine decodes what another one wrote.

Segment layout, little endian: magic ``PMTS``, version u8, then u32 counts of documents and blocks, u64 of ids; the
document keys (u8 valid, i64) and lengths (u32); per block u32 ids, u32 digits, u32 crc32 of its ids as u16; per block
the number of digits of each lane (u32) and the digits (20 bits each, two to five bytes, big endian); crc32 of
everything before. Segments are rows (shard, seq, data) of a Parquet table, so that Spark's committer, not the tasks,
decides what counts as written, and a lost executor leaves no half file.

Defined cases: null text is the empty text and gives only the end id; a null key sorts first; repeated keys are kept,
ordered by the text; empty tables write an empty table; extra columns are not read.
"""

from __future__ import annotations

import decimal
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import columnar as co

#: Ids of a block and of a segment, about: blocks of a segment are of one size, and a segment ends with a document.
BLOCK = SEGMENT_IDS = 1 << 20
MAX_LANES = 4096
#: Up to so many segments their starts (20 bytes each) are broadcast; those of more are joined as Spark sees fit.
MAX_BROADCAST_SEGMENTS = 1_000_000
MAGIC, VERSION = b"PMTS", 3
_HEAD = struct.Struct("<4sBIIQ")

#: Ids are below this.
IDS = 1 << 16
#: Slots of order 2. A slot holds an id and the chance, in 2**-12, that it follows.
_SLOTS = 1 << 18
_CHANCE, _FRESH, _WEAK = np.uint32(0xFFF), np.uint32(0x300), np.uint32(0x100)
#: What a seen id weighs in order 0, against 1 of one that wasn't.
_SEEN = 32
#: The coder's state has _LOW + _DIGIT bits; a lane's range stays above 2**_LOW, by digits that leave at the top.
_LOW, _DIGIT = 40, 20
_FULL, _LEAST, _KEEP = (1 << _LOW + _DIGIT) - 1, np.uint64(1 << _LOW), np.uint64((1 << _LOW) - 1)
_OUT, _UP, _HALF = np.uint64(_LOW), np.uint64(_DIGIT), np.uint64(16)
#: The weights' range, and the share of the mean error, a power of two, by which they move each step.
_WEIGHT, _RATE = 1 << 17, 10


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """By chance in 2**-12 its logit in 1/256, and by logit the chance in 2**-16; exact, thus the same everywhere."""
    with decimal.localcontext() as c:
        c.prec = 12
        one = decimal.Decimal(1)
        chance = [int(65536 / (one + (-decimal.Decimal(x) / 256).exp())) for x in range(-2048, 2048)]
    squash = np.clip(np.array(chance), 32, 65536 - 32)
    return np.clip(np.searchsorted(squash, np.arange(8, 65536, 16)) - 2048, -2047, 2047).astype(np.int32), squash


_STRETCH, _SQUASH = _logistic()


class _Common:
    """Order 0: how often each id was seen. It takes in what was seen when that is as much as it knows."""

    def __init__(self, lanes: int, decoding: bool) -> None:
        self.count = np.zeros(IDS, np.int64)
        self.known, self.lanes, self.decoding, self.waiting = 0, lanes, decoding, []
        self._build()

    def _build(self) -> None:
        if self.waiting:
            new = np.concatenate(self.waiting)
            self.count += np.bincount(new, minlength=IDS)
            self.known += len(new)
        self.waiting, self.held, self.due = [], 0, max(self.known, 2 * self.lanes)
        self.widths = 1 + _SEEN * self.count
        self.ends = np.cumsum(self.widths)
        self.starts = self.ends - self.widths
        self.total = int(self.ends[-1])
        # logits of small chances from binary logarithms in sixteenths
        (part, power), (all_part, all_power) = np.frexp(self.widths.astype(np.float64)), np.frexp(float(self.total))
        log = (power << 4) + (part * 32).astype(np.int32) - ((int(all_power) << 4) + int(all_part * 32))
        self.stretch = np.maximum(log * 11, -2047).astype(np.int32)
        if self.decoding:
            self.shift = max(self.total.bit_length() - 17, 0)
            cells = (self.ends + (1 << self.shift) - 1) >> self.shift
            self.first = np.cumsum(np.bincount(cells, minlength=(self.total >> self.shift) + 2))

    def saw(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.due:
            self._build()

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id in whose interval each value lies: by a table of first candidates, then onwards."""
        at = self.first.take(value >> self.shift)
        for _ in range(2):
            at += self.ends.take(at) <= value
        if len(late := np.flatnonzero(self.ends.take(at) <= value)):
            at[late] = np.searchsorted(self.ends, value[late], "right")
        return at


class _Model:
    """What the lanes of a block share, and the last two ids of each."""

    def __init__(self, lanes: int, decoding: bool = False) -> None:
        self.common = _Common(lanes, decoding)
        self.slots = np.zeros(_SLOTS, np.uint32), np.zeros(IDS, np.uint32)
        self.weights = [20000, 15000, 10000, 0]
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first n lanes the guessed id, and the chance of it in 2**-16."""
        one = self.one[:n]
        far = one * 0x2545
        far += self.two[:n] * 0x1D7A3
        far &= _SLOTS - 1
        self.at = far, one
        self.said = a, b = self.slots[0].take(far), self.slots[1].take(one)
        self.chance = p, q = a & _CHANCE, b & _CHANCE
        self.ids = i, j = a >> np.uint32(12), b >> np.uint32(12)
        guess = np.where(p >= q, i, j).astype(np.int64)
        x, y = _STRETCH.take(p), _STRETCH.take(q)
        x *= i == guess
        y *= j == guess
        z = self.common.stretch.take(guess)
        self.inputs = x, y, z
        w = self.weights
        dot = x * np.int32(w[0])
        dot += y * np.int32(w[1])
        dot += z * np.int32(w[2])
        dot += np.int32((w[3] << 8) + (2048 << 16))
        dot >>= np.int32(16)
        np.maximum(dot, np.int32(1), out=dot)
        np.minimum(dot, np.int32(4095), out=dot)
        self.p = _SQUASH.take(dot)
        return guess, self.p

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        n, w = len(ids), self.weights
        error = hit.astype(np.int64)
        error <<= 16
        error -= self.p
        moves = [int(np.dot(error, x)) for x in self.inputs] + [256 * int(error.sum())]
        self.weights = [max(-_WEIGHT, min(_WEIGHT, v + (m // n >> _RATE))) for v, m in zip(w, moves)]
        small = ids.astype(np.uint32)
        fresh = small << np.uint32(12)
        fresh |= _FRESH
        for table, at, slot, chance, said in zip(self.slots, self.at, self.said, self.chance, self.ids):
            new = np.where(said == small, slot + ((_CHANCE - chance) >> np.uint32(3)), slot - (chance >> np.uint32(2)))
            table[at] = np.where((new & _CHANCE) < _WEAK, fresh, new)
        self.common.saw(ids)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes and steps of a block of n ids, and the ids of its last lane."""
    steps = -(-n // min(MAX_LANES, n, 4 * math.isqrt(n)))
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of digits of each lane, and the digits."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if ids.min() < 0 or ids.max() >= IDS:
        raise ValueError("ids must be below 65,536")
    lanes, steps, last = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes)
    room = 2 * steps + 4
    out, at = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    all_low, all_range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    for t, row in enumerate(grid):
        n = lanes if t < last else lanes - 1
        now, low, range_ = row[:n], all_low[:n], all_range[:n]
        guess, p = model.predict(n)
        hit = guess == now
        width = range_ >> _HALF
        width *= p.view(np.uint64)
        miss = np.flatnonzero(~hit)
        edge, said = width.take(miss), now.take(miss)
        unit = (range_.take(miss) - edge) // np.uint64(model.common.total)
        low[miss] += edge + unit * model.common.starts.take(said).view(np.uint64)
        width[miss] = unit * model.common.widths.take(said).view(np.uint64)
        range_[:] = width
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            cell, x, y = at.take(small), low.take(small), range_.take(small) << _UP
            out[cell] = x >> _OUT  # with the carry, if there is one
            at[small] = cell + 1
            low[small] = (x & _KEEP) << _UP
            range_[small] = y
            small = small[y < _LEAST]
        model.learn(now, hit)
    for _ in range(3):
        out[at] = all_low >> _OUT
        at += 1
        all_low = (all_low & _KEEP) << _UP
    sizes = at - np.arange(lanes) * room
    digits = out[co.ragged(np.arange(lanes) * room, sizes)]
    while (carry := digits >> np.uint32(_DIGIT)).any():  # never out of a lane's first digit
        digits &= np.uint32((1 << _DIGIT) - 1)
        digits[:-1] += carry[1:]
    return sizes, digits


def decode_block(n_ids: int, sizes: np.ndarray, digits: np.ndarray) -> np.ndarray:
    if n_ids == 0:
        return np.zeros(0, np.uint16)
    lanes, steps, last = _shape(n_ids)
    if lanes != len(sizes):
        raise ValueError("not a block of this layout")
    model = _Model(lanes, decoding=True)
    digits = np.concatenate([digits, np.zeros(4, np.uint32)]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    all_code, all_range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    for _ in range(3):
        all_code = all_code << _UP | digits.take(at, mode="clip")
        at += 1
    grid = np.zeros((steps, lanes), np.uint16)
    for t, row in enumerate(grid):
        n = lanes if t < last else lanes - 1
        code, range_ = all_code[:n], all_range[:n]
        now, p = model.predict(n)
        width = range_ >> _HALF
        width *= p.view(np.uint64)
        hit = code < width
        miss = np.flatnonzero(~hit)
        edge = width.take(miss)
        unit = (range_.take(miss) - edge) // np.uint64(model.common.total)
        rest = code.take(miss) - edge
        said = model.common.find(np.minimum((rest // unit).view(np.int64), model.common.total - 1))
        code[miss] = rest - unit * model.common.starts.take(said).view(np.uint64)
        width[miss] = unit * model.common.widths.take(said).view(np.uint64)
        now[miss] = said
        range_[:] = width
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            cell, y = at.take(small), range_.take(small) << _UP
            at[small] = cell + 1
            code[small] = code.take(small) << _UP | digits.take(cell, mode="clip")
            range_[small] = y
            small = small[y < _LEAST]
        model.learn(now, hit)
        row[:n] = now
    return grid.T.reshape(-1)[:n_ids]


def packed(digits: np.ndarray) -> bytes:
    """Two digits to five bytes."""
    pairs = np.zeros((len(digits) + 1) // 2 * 2, np.uint64)
    pairs[: len(digits)] = digits
    return (pairs[::2] << _UP | pairs[1::2]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    pairs = wide.reshape(-1).view(">u8").astype(np.uint64)
    return np.stack([pairs >> _UP, pairs & np.uint64((1 << _DIGIT) - 1)], axis=1).reshape(-1)[:n].astype(np.uint32)


def _cuts(n_ids: int) -> list[int]:
    """Where the blocks of a segment begin, and its end."""
    blocks = max(1, round(n_ids / BLOCK)) if n_ids else 0
    return [n_ids * k // max(blocks, 1) for k in range(blocks + 1)]


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    cuts = _cuts(len(ids))
    parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    table = np.zeros(len(keys), _KEYS)
    table["valid"] = [k is not None for k in keys]
    table["key"] = [k or 0 for k in keys]
    table["n"] = lengths
    head, body = [_HEAD.pack(MAGIC, VERSION, len(keys), len(parts), len(ids)), table.tobytes()], []
    for part in parts:
        sizes, digits = encode_block(part)
        head.append(struct.pack("<III", len(part), len(digits), zlib.crc32(part.astype("<u2").tobytes())))
        body += [sizes.astype("<u4").tobytes(), packed(digits)]
    data = b"".join(head + body)
    return data + struct.pack("<I", zlib.crc32(data))


_KEYS = np.dtype([("valid", "u1"), ("key", "<i8"), ("n", "<u4")])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a segment; ValueError if a checksum doesn't hold."""
    if len(data) < _HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the segment is damaged")
    magic, version, n_docs, n_blocks, n_ids = _HEAD.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a segment of this version")
    table = np.frombuffer(data, _KEYS, n_docs, _HEAD.size)
    at = _HEAD.size + n_docs * _KEYS.itemsize
    info = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(n_blocks, 3)
    at += 12 * n_blocks
    ids = np.zeros(n_ids, np.uint16)
    filled = 0
    for k, (n, n_digits, crc) in enumerate(info.tolist()):
        lanes = _shape(n)[0] if n else 0
        sizes = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        at += 4 * lanes
        end = at + (n_digits + 1) // 2 * 5
        part = decode_block(n, sizes, unpacked(data[at:end], n_digits))
        at = end
        if zlib.crc32(part.astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        ids[filled : filled + n] = part
        filled += n
    return [int(k) if v else None for v, k in zip(table["valid"], table["key"])], table["n"].astype(np.int64), ids


#: White space, or what may be a special token, in a unit.
_SPECIAL = re.compile(r"\s|<\|")
#: White space that stands before and after a space, or a space at the end behind white space; or a special token.
_ODD = r"[\s\pZ\x{1c}-\x{1f}\x{0b}\x{85}] (?:[\s\pZ\x{1c}-\x{1f}\x{0b}\x{85}]|\z)|<\|"

# Classes of bytes: letters in ASCII; leading bytes of U+00C0 to U+027F, which but for two are letters; bytes that follow
# one; white space and other characters in ASCII; and bytes of characters whose class isn't looked up.
_LETTER, _LEAD, _NEXT, _SPACE, _OTHER, _UNKNOWN = 1, 2, 4, 8, 16, 32
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[:128], _CLASS[128:192], _CLASS[0xC3:0xCA] = _OTHER, _NEXT, _LEAD
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(9, 14), *range(28, 33)]] = _SPACE


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut such that their parts get the same tokens alone as together: at spaces, behind a letter
    where no letter follows, and before a letter that follows another character. Not between a space and what comes
    after it, nor behind an apostrophe, nor behind two white spaces, nor beside characters of unknown class.

    That follows from the byte-level pattern: runs of letters with the space before, of digits, of other characters and
    of white space, and after an apostrophe some endings.
    """
    n = len(raw)
    kind = np.zeros(n + 2, np.uint8)
    kind[2:] = _CLASS.take(raw)
    now, before = kind[2:], kind[1:-1]
    second = (now == _NEXT) & (before == _LEAD)
    signs = np.flatnonzero(second & ((raw == 0x97) | (raw == 0xB7)))  # the signs of multiplication and division
    signs = signs[raw[signs - 1] == 0xC3]
    letter = (now == _LETTER) | (now == _LEAD) | second
    letter[signs] = letter[signs - 1] = False
    plain = (now & (_SPACE | _OTHER)) != 0
    cut = raw == 32
    cut[1:] |= letter[:-1] & plain[1:]
    may = plain[:-1] & letter[1:] & ~cut[:-1]
    may &= raw[:-1] != 39
    may &= ~((now[:-1] == _SPACE) & (before[:-1] == _SPACE))
    cut[1:] |= may
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizers library over distinct units of texts; texts in which spaces may not be cut at are encoded whole.

    Units that begin with a space are encoded together and taken apart at the tokens that begin with one; other units
    likewise, with a line end between them; units with other white space in them one by one.
    """

    JOIN = 100

    def __init__(self, path: str, escape_special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = escape_special
        self.special = [] if escape_special else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced, self.line = np.zeros(max(vocabulary.values(), default=0) + 1, bool), np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("Ġ")
            self.line[i] = token.startswith("Ċ")
        self.cache = co.UnitCache(self._units)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), 20_000):
            out += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
        return out

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, and the number of each."""
        order: list[int] = []
        flat: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        with_space, without, alone = [], [], []
        for k, x in enumerate(units):
            if x[0] == " " and x[1:].isalpha():
                with_space.append(k)
            elif x.isalpha():
                without.append(k)
            elif len(x) < 2 or _SPECIAL.search(x, 1):
                alone.append(k)
            else:
                (with_space if x[0] == " " else alone if _SPECIAL.match(x) else without).append(k)
        for group, join, first in ((with_space, "", self.spaced), (without, "\n", self.line)):
            for lo in range(0, len(group), self.JOIN):
                some = group[lo : lo + self.JOIN]
                said = self.tokenizer.encode_batch_fast([join + join.join([units[k] for k in some])], add_special_tokens=False)[0]
                ids = np.array(said.ids, np.int32)
                starts = np.flatnonzero(first[ids])
                if len(starts) != len(some):
                    alone += some  # another vocabulary than its pattern promises
                    continue
                order += some
                sizes = np.diff(starts, append=len(ids))
                if join:
                    ids, sizes = np.delete(ids, starts), sizes - 1
                flat.append(ids)
                lengths.append(sizes)
        said = self._ids([units[k] for k in alone])
        ids = np.concatenate([*flat, *said, np.zeros(0, np.int32)])
        sizes = np.concatenate([*lengths, np.array([len(x) for x in said], np.int64)])
        back = np.empty(len(units), np.int64)
        back[order + alone] = np.arange(len(units))
        return ids[co.ragged((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in self.special:
            if not token.startswith("<|"):  # _ODD has those
                odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        raw, offsets = co.buffers(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        starts = unit_starts(raw, offsets)
        ids, counts = self.cache.lookup(raw, starts, np.diff(starts, append=len(raw)))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = sums[np.searchsorted(starts, offsets)]
        lengths = np.diff(ends)
        if not odd.any():
            return ids, lengths
        which = np.flatnonzero(odd)
        whole = self._ids([texts[int(k)].as_py() for k in which])
        pool, begins = np.concatenate([ids, *whole]), ends[:-1].copy()
        lengths[which] = [len(x) for x in whole]
        begins[which] = len(ids) + np.cumsum(lengths[which]) - lengths[which]
        return pool[co.ragged(begins, lengths)], lengths


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, escape_special: bool = False) -> Encoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    if (path, escape_special) not in _LOADED:
        _LOADED[path, escape_special] = Encoder(path, escape_special)
    return _LOADED[path, escape_special]


def segments(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, segment_ids: int = SEGMENT_IDS, escape_special: bool = False) -> DataFrame:
    """(shard, seq, n_ids, data): documents in ascending order of their key, tokenized and packed. A special token that
    a text spells out gets its id, as by the library's plain call; ``escape_special`` takes it for ordinary text.

    The range partitioning also uses the text's hash, so that many rows of one key still spread.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.xxhash64(f"`{text}`").alias("h"))
    source = source.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer, escape_special)
        keys: list = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack(keys, np.concatenate(lengths), ids)], pa.binary())], ["shard", "seq", "n_ids", "data"])

        for batch in co.slices(batches, "text"):
            flat, sizes = coder.encode(batch["text"])
            with_end = np.full(len(flat) + len(sizes), end_id, np.uint16)
            ends = np.cumsum(sizes + 1)
            body = np.ones(len(with_end), bool)
            body[ends - 1] = False
            if len(flat) and flat.max() >= 1 << 16:
                raise ValueError("ids must be below 65,536")
            with_end[body] = flat
            keys += batch["key"].to_pylist()
            lengths.append(sizes + 1)
            parts.append(with_end)
            held += len(with_end)
            if held >= segment_ids:
                yield flush()
                seq, held = seq + 1, 0
                keys, lengths, parts = [], [], []
        if keys:
            yield flush()

    return source.mapInArrow(run, "shard int, seq int, n_ids long, data binary")


def write(docs: DataFrame, tokenizer: str, path: str, **options) -> None:
    """Tokenize documents into a token-file table at ``path``, which all executors must share."""
    segments(docs, tokenizer, **options).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: the key, start (ids of all documents before it), n_tokens, ids_crc32, and
    the ids if asked for. Starts come from the segments' counts: first over shards, then within each."""
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row per shard
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")
    places = table.select("shard", "seq", within.alias("seq_start"), "n_ids").join(before, "shard")
    places = places.select(F.col("shard"), F.col("seq"), (F.col("seq_start") + F.col("shard_start")).alias("start"))
    if table.count() <= MAX_BROADCAST_SEGMENTS:
        places = F.broadcast(places)
    rows = table.join(places, ["shard", "seq"]).select("start", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch["start"].to_pylist(), batch["data"]):
                keys, lengths, ids = unpack(data.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                for lo in range(0, len(keys), 4096):
                    hi = min(lo + 4096, len(keys))
                    bounds = [(int(e - n), int(e)) for e, n in zip(ends[lo:hi], lengths[lo:hi])]
                    columns = [pa.array(keys[lo:hi], pa.int64()), pa.array([begin + a for a, _ in bounds], pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in bounds], pa.int64())]
                    names = ["k", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        first = bounds[0][0]
                        columns.append(pa.ListArray.from_arrays(pa.array([a - first for a, _ in bounds] + [bounds[-1][1] - first], pa.int32()), pa.array(ids[first : bounds[-1][1]], pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("k", key)
