"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary file's pieces and scores are taken as they are; the segmentation of the largest summed score wins, ties
go to the longer last piece. A space becomes the word mark U+2581, and one mark is put before the text. Characters
without a piece, and literal word marks, become byte pieces, so decode(encode(text)) is the text, whatever it holds.

No piece has a word mark behind another character, so the best segmentation splits wherever a run of spaces begins:
each distinct run of spaces and characters up to the next space is segmented once and its ids reused.

Defined cases: null gives null ids and null text; an empty text has no ids; other columns that are named like a result
are returned with ``_input`` behind their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as co
from .components import renamed

MARK = "▁"
#: What a character without a piece costs beyond the least piece score.
UNKNOWN_PENALTY = 10.0

#: The first characters, or a space, further spaces, and the characters after them; the space before a piece isn't in it.
_RUNS = re.compile(r"(?:\A| )( *[^ ]*)")


class Codec:
    """Pieces, their automaton, and their bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: frozenset[int]) -> None:
        self.byte_ids = byte_ids
        fixed = special | set(byte_ids)
        usable = [i for i in range(len(pieces)) if i not in fixed and pieces[i]]
        self.unknown = min((scores[i] for i in usable if scores[i] > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.single = {pieces[i] for i in usable if len(pieces[i]) == 1}
        if MARK not in self.single:
            raise ValueError("the vocabulary has no word mark")
        if any(MARK in pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece has a word mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(pieces[i], (len(pieces[i]), scores[i], i))
        if usable:
            self.automaton.make_automaton()
        self.usable = bool(usable)
        byte_of = {k: bytes([b]) for b, k in enumerate(byte_ids)}
        texts = [byte_of.get(i, b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cache = co.UnitCache(lambda distinct: co.listed([self._piece(x) for x in distinct]), 200_000)

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], byte_ids, special)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text in which every word mark stands for a space."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        matches = self.automaton.iter(text) if self.usable else iter(())
        match = next(matches, None)
        for end in range(1, n + 1):
            here, how, longest = -np.inf, None, 0
            while match is not None and match[0] == end - 1:  # the piece that ends here, then its output links
                length, score, piece = match[1]
                total = best[end - length] + score
                if total > here or total == here and length > longest:
                    here, how, longest = total, (length, piece), length
                match = next(matches, None)
            if text[end - 1] not in self.single and best[end - 1] + self.unknown > here:
                here, how = best[end - 1] + self.unknown, None
            best[end], back[end] = here, how
        ids, end = [], n
        while end:
            if back[end] is None:
                ids.extend(self.byte_ids[b] for b in reversed(text[end - 1].encode()))
                end -= 1
            else:
                length, piece = back[end]
                ids.append(piece)
                end -= length
        return ids[::-1]

    def _piece(self, piece: str) -> list[int]:
        """Ids of a mark, more marks for the spaces that the piece begins with, and its other characters."""
        first, *rest = piece.split(MARK)
        ids = self.viterbi(MARK + first.replace(" ", MARK))
        for part in rest:  # a literal mark: its bytes
            ids += [self.byte_ids[b] for b in MARK.encode()] + self.viterbi(part)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets of texts without nulls."""
        odd = pc.match_substring_regex(texts, "^ |  ").to_numpy(zero_copy_only=False)
        if odd.any():  # runs of spaces stay together
            lists = [_RUNS.findall(x) if o else x.split(" ") for x, o in zip(texts.to_pylist(), odd)]
            pieces, offsets = pa.array([p for x in lists for p in x], pa.string()), np.cumsum([0, *map(len, lists)])
        else:
            pieces, offsets = co.space_pieces(texts)
        ids, counts = self.cache.of(pieces)
        sums = np.concatenate([[0], np.cumsum(counts)])
        lengths = sums[offsets[1:]] - sums[offsets[:-1]]
        if (empty := np.diff(co.buffers(texts)[1]) == 0).any():
            keep = np.repeat(~empty, lengths)
            ids, lengths = ids[keep], np.where(empty, 0, lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and n + 1 offsets; the space that stands for the first mark goes."""
        lengths = self.lengths[ids]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        raw = self.raw[co.ragged(self.starts[ids], lengths)]
        at = sums[offsets]
        drop = at[:-1][np.diff(at) > 0]
        keep = np.ones(len(raw), bool)
        keep[drop] = raw[drop] != 32
        return raw[keep], at - np.concatenate([[0], np.cumsum(~keep)])[at]


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return _LOADED[path]


def _carried(frame: DataFrame, names: list[str], used: str) -> tuple[DataFrame, list[str], str]:
    """The columns under names of our own, the one that is used last; these names, and their schema."""
    inner = [f"c{i}" for i in range(len(names))]
    source = frame.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([*names, used], [*inner, "used"])])
    return source, inner, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, ids: str = "piece_ids", round_trip: str | None = None) -> DataFrame:
    """``keep`` (all columns but the text, if None), an array of piece ids and, in the column that ``round_trip`` names,
    whether they decode to the text."""
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    source, inner, schema = _carried(docs, kept, text)
    results = [ids] if round_trip is None else [ids, round_trip]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in co.slices(batches, "used"):
            texts = co.filled(batch["used"])
            flat, offsets = known.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            more = [pc.if_else(pc.is_null(batch["used"]), pa.scalar(None, lists.type), lists)]
            if round_trip is not None:
                same = pa.array(_same(texts, *known.decode(flat, offsets)), pa.bool_())
                more.append(pc.if_else(pc.is_null(batch["used"]), pa.scalar(None, pa.bool_()), same))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*inner, "ids", "same"][: len(inner) + len(more)])

    out = source.mapInArrow(run, f"{schema}ids array<int>" + ", same boolean" * (round_trip is not None))
    return out.toDF(*renamed(kept, results), *results)


def _same(texts: pa.Array, raw: np.ndarray, ends: np.ndarray) -> list[bool]:
    """Which of the decoded texts are the texts."""
    (given, begun), back = co.buffers(texts), raw.tobytes()
    asked = given.tobytes()
    return [back[a:b] == asked[c:d] for a, b, c, d in zip(ends, ends[1:], begun, begun[1:])]


def decode(frame: DataFrame, path: str, *, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """The other columns and the text of an array of piece ids."""
    kept = [c for c in frame.columns if c != ids]
    source, inner, schema = _carried(frame, kept, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                lists = pc.fill_null(batch["used"], [])
                raw, offsets = known.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]))
                texts = co.string_array(raw, offsets).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.if_else(pc.is_null(batch["used"]), pa.scalar(None, pa.string()), texts)], [*inner, "said"])

    return source.mapInArrow(run, f"{schema}said string").toDF(*renamed(kept, [text]), text)


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, of its ids and of the text decoded from them: counts, checksums and whether the text came back.

    Encodes and decodes whole texts as ``encode`` and ``decode`` do, without ids crossing between Python and the JVM.
    """
    source, inner, schema = _carried(docs, [key], text)
    results = ["n_pieces", "ids_crc32", "decoded_chars", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in co.slices(batches, "used"):
            texts = co.filled(batch["used"])
            flat, offsets = known.encode(texts)
            raw, ends = known.decode(flat, offsets)
            little, back = flat.astype("<u4").tobytes(), raw.tobytes()
            crcs = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            points = [len(back[a:b].decode()) for a, b in zip(ends, ends[1:])]
            more = [pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64()), pa.array(points, pa.int64()), pa.array(_same(texts, raw, ends), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*inner, *results])

    return source.mapInArrow(run, f"{schema}n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean").toDF(key, *results)
