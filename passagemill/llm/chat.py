"""Chat formatting by columnar byte assembly: segment lengths, cumulative offsets and scatter indices in numpy; headers,
contents and footers are copied into one preallocated Arrow buffer.

A turn is ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a backslash is doubled, and each control string
gets a backslash behind its first character, so none is left; dropping single backslashes gives the text back. A new
line in a role also gets a backslash before it.

Turns are dealt out by ranges of conversation and turn, so that a conversation with a large share of all rows goes to
several tasks. Each formats its turns in order as a stream: what it holds of a conversation is a part, and one that
outgrows a slice continues in a further part, so that no conversation is held whole. Parts have numbers that grow with
the turns; nearly all conversations have one part.

Defined cases: null texts and roles are empty; null turns sort first; equal turns are ordered by role, then text;
repeated rows are repeated turns; null conversation ids form one conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as co

BEGIN, END = "<|turn|>", "<|end|>\n"
#: Strings that no text may smuggle into a prompt.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)

TURN_SCHEMA = "conv_id long, part long, whole boolean, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"


def escape(column: pa.Array) -> pa.Array:
    """The texts without control strings."""
    column = pc.replace_substring(column, "\\", "\\\\")
    for x in CONTROL:
        column = pc.replace_substring(column, x, f"{x[0]}\\{x[1:]}")
    return column


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; ValueError if there is anything else."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def assemble(roles: pa.Array, texts: pa.Array, loss_roles: tuple[str, ...], group_ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted strings, one for each group of turns, and their loss spans in code points."""
    n = len(texts)
    coded = roles.dictionary_encode()
    names = coded.dictionary.to_pylist()
    heads = [f"{BEGIN}{x}\n".encode() for x in pc.replace_substring(escape(coded.dictionary), "\n", "\\\n").to_pylist()]
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw, offsets = co.buffers(escape(texts))
    head_sizes = np.array([len(h) for h in heads], np.int64)
    head_starts = np.cumsum(head_sizes) - head_sizes
    lengths = np.empty((n, 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = head_sizes[which], np.diff(offsets), len(END)
    bounds = np.concatenate([[0], np.cumsum(lengths.reshape(-1))])
    places = bounds[:-1].reshape(n, 3)
    buffer = pa.allocate_buffer(int(bounds[-1]))
    out = np.frombuffer(buffer, np.uint8)
    out[co.ragged(places[:, 0], lengths[:, 0])] = np.frombuffer(b"".join(heads), np.uint8)[co.ragged(head_starts[which], lengths[:, 0])]
    out[co.ragged(places[:, 1], lengths[:, 1])] = raw
    out[places[:, 2, None] + np.arange(len(END))] = np.frombuffer(END.encode(), np.uint8)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    group_starts = np.concatenate([[0], group_ends[:-1]])
    formatted = pa.LargeStringArray.from_buffers(len(group_ends), pa.py_buffer(bounds[3 * np.concatenate([[0], group_ends])]), buffer).cast(pa.string())
    group = np.repeat(np.arange(len(group_ends)), group_ends - group_starts)
    base = points[bounds[3 * group_starts]][group]
    rows = np.flatnonzero(np.isin(which, [i for i, x in enumerate(names) if x in loss_roles]))
    spans = pa.StructArray.from_arrays([pa.array(points[bounds[3 * rows + 1]] - base[rows], pa.int64()), pa.array(points[bounds[3 * rows + 2]] - base[rows], pa.int64())], ["start", "end"])
    return formatted, pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.concatenate([[0], group_ends])), pa.int32()), spans)


def format_chat(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations in parts, each with its turns, its text and its loss spans, and whether it is known to be the
    whole conversation. The texts of a conversation's parts, joined by their numbers, are the conversation.
    """
    source = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # Equal turns are split too, at a prefix of their texts: between ranges the order is that of whole texts.
    ranges = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    source = source.repartitionByRange(*ranges).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: pa.RecordBatch | None = None  # the rows of the newest conversation, which may go on
        part = TaskContext.get().partitionId() << 40
        # The first conversation of a task may have begun, and its last one may go on, in another.
        opened = part > 0

        def made(rows: pa.RecordBatch, ends: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            nonlocal part
            formatted, spans = assemble(rows["role"], rows["text"], loss_roles, ends)
            begins = np.concatenate([[0], ends[:-1]])
            parts = part + np.arange(len(ends))
            part += len(ends)
            return pa.RecordBatch.from_arrays([rows["conv_id"].take(pa.array(begins)), pa.array(parts, pa.int64()), pa.array(whole), pa.array(ends - begins, pa.int64()), formatted, spans], ["conv_id", "part", "whole", "n_turns", "formatted", "loss_spans"])

        for batch in co.slices(batches, "text"):
            rows = batch if held is None else pa.concat_batches([held, batch])
            ends = _changes(rows["conv_id"])
            if len(ends):
                whole = np.ones(len(ends), bool)
                whole[0], opened = not opened, False
                yield made(rows.slice(0, int(ends[-1])), ends, whole)
                held = rows.slice(int(ends[-1]))
            else:
                held = rows
            if held.nbytes > 4 * co.SLICE_BYTES and held.num_rows > 1:  # all but the last row, so that a last part has rows
                yield made(held.slice(0, held.num_rows - 1), np.array([held.num_rows - 1]), np.zeros(1, bool))
                held, opened = held.slice(held.num_rows - 1), True
        if held is not None:
            yield made(held, np.array([held.num_rows]), np.zeros(1, bool))

    return source.mapInArrow(run, TURN_SCHEMA)


def _changes(ids: pa.Array) -> np.ndarray:
    """The rows at which another id begins; nulls are one id."""
    if len(ids) < 2:
        return np.zeros(0, np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says when it is read back. ``formatted`` should be written, as it is read
    twice: conversations in one part, and those in several, whose parts meet in order of their numbers.

    Its hashes are over all turns of a conversation, so the parts of one pass through one task, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for conv, whole, text, spans in zip(batch["conv_id"].to_pylist(), batch["whole"].to_pylist(), batch["formatted"], batch["loss_spans"].to_pylist()):
                if now is None or whole or now.conv != conv:
                    if now is not None:
                        out.append(now.said())
                    now = _Digest(conv)
                now.add(text.as_py(), spans)
            yield _digest_rows(out)
        if now is not None:
            yield _digest_rows([now.said()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "part", "whole", "formatted", "loss_spans"]
    one = formatted.where("whole").select(columns).mapInArrow(run, schema)
    several = formatted.where("not whole").select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)
    return one.unionByName(several)


class _Digest:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in parse(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def said(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
