"""Overlapping chunks of documents: greedy packing of words, in Arrow batches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import normal_id, resolved_source


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Windows over the pieces of at most ``size`` characters; the next one takes up to ``overlap`` of the last."""
    out, lo, total = [], 0, 0
    for hi, piece in enumerate(pieces):
        n = len(piece)
        if total + n > size and hi > lo:
            if said := "".join(pieces[lo:hi]).strip():
                out.append(said)
            while total > overlap or total > 0 and total + n > size:
                total -= len(pieces[lo])
                lo += 1
        total += n
    if said := "".join(pieces[lo:]).strip():
        out.append(said)
    return out


def _windows(text: str, starts: list[int], size: int, overlap: int) -> list[str]:
    """As ``_packed``, over words of less than ``size`` characters that begin at ``starts``, of which the last is the end."""
    out, lo, last = [], 0, len(starts) - 1
    while (hi := bisect_right(starts, starts[lo] + size) - 1) < last:
        if said := text[starts[lo] : starts[hi]].strip():
            out.append(said)
        lo = bisect_left(starts, starts[hi] - min(overlap, size - (starts[hi + 1] - starts[hi])), lo, hi)
    if said := text[starts[lo] :].strip():
        out.append(said)
    return out


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of a text whose only white space is single spaces. A word of ``size`` characters or more is packed by
    character, and shares nothing with its neighbours."""
    points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    spaces = np.flatnonzero(points == 32)
    starts = np.concatenate([[0], spaces[spaces > 0], [len(text)]])
    if np.diff(starts).max() < size and len(text):
        return _windows(text, starts.tolist(), size, overlap)
    first, *rest = text.split(" ")
    words = [first, *(" " + w for w in rest)]
    out: list[str] = []
    run: list[str] = []
    for word in words:
        if len(word) < size:
            run.append(word)
            continue
        out += _packed(run, size, overlap) if run else []
        out += _packed(list(word), size, overlap)
        run = []
    return out + (_packed(run, size, overlap) if run else [])


def chunk_texts(text: str, technical: bool, config: ChunkConfig) -> tuple[list[tuple[int, str]], int]:
    """(position from 1, chunk) of the chunks that are long enough, and the number of all."""
    if len(text) < config.min_text_len:
        return [], 0
    size, overlap = (config.technical_size, config.technical_overlap) if technical else (config.size, config.overlap)
    parts = split_text(text, size, overlap)
    if config.merge_short_tail and len(parts) >= 2 and len(parts[-1]) < max(config.min_text_len, int(0.25 * config.size)):
        parts[-2:] = [f"{parts[-2]} {parts[-1]}"]
    return [(i, p) for i, p in enumerate(parts, 1) if len(p) >= config.min_text_len], len(parts)


def chunk(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """A row for each chunk of each document: the document's columns with the chunk's text, ``chunk_index``,
    ``chunk_total``, ``chunk_kind`` and ``hash_id``. Needs text and doc_type; file_name, source and page_number if there.
    """
    config = config or ChunkConfig()
    kept = [c for c in docs.columns if c not in ("text", "chunk_index", "chunk_total", "hash_id")]
    # White space is evened out in Python, whose notion of it is ``normalize_text``'s, so that chunks need no second look.
    source = docs.select(*kept, "text", F.lower(F.coalesce("doc_type", F.lit(""))).isin(*config.technical_types).alias("technical_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                rows, texts, index, total = [], [], [], []
                for k, (text, technical) in enumerate(zip(some["text"].to_pylist(), some["technical_"].to_pylist())):
                    found, n = chunk_texts(" ".join((text or "").split()), technical, config)
                    for i, said in found:
                        rows.append(k)
                        texts.append(said)
                        index.append(i)
                        total.append(n)
                which = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(some[c].take(which) for c in kept), pa.array(texts, pa.string()), pa.array(index, pa.int32()), pa.array(total, pa.int32())], [*kept, "text", "chunk_index", "chunk_total"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    out = source.mapInArrow(run, f"{schema}, text string, chunk_index int, chunk_total int")
    has = lambda c, kind: F.col(c) if c in kept else F.lit(None).cast(kind)
    return out.withColumns({
        "chunk_kind": F.coalesce(has("chunk_kind", "string"), F.lit("text")),
        "hash_id": normal_id(F.col("text"), resolved_source(has("source", "string"), has("file_name", "string")), has("page_number", "int")),
    })
