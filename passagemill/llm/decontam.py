"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every training text.

The benchmark is taken in groups of at most ``max_windows`` windows, each of which takes some 40 bytes in a set. Nearly
every benchmark is one group, and one pass over the texts. Those of more groups take a pass each: what a pass has found
is written beside the rows, so that one set at a time is held, on the driver, in the broadcast and in the workers.

Defined cases: a null or empty text has no words and is never contaminated; benchmark items without words match nothing;
items without an id count as one, and have no place in the list of ids; an item of fewer than ``window`` words is one window; repeated items and repeated documents each
count for themselves; a column to keep that is named like a result is returned with ``_input`` behind its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as co
from .components import TEXT_ROWS, Workspace, batch_rows, renamed, saved

WINDOW = 13
MAX_WINDOWS = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
WORD_PATTERN = "[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+"


class Grams:
    """Windows of the items: for each window length the sorted hashes of the distinct ones, where the words of each
    stand, to verify a hit, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.names = [item for item, _ in items]
        texts = [(text or "").encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
        self.low = co.lowered(np.frombuffer(b"".join(texts), np.uint8))
        self.starts, self.ends, first = co.words(self.low, offsets, _WORD)
        values = co.word_hashes(self.low, self.starts, self.ends)
        counts = np.diff(first)
        self.by_size = []
        for size in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            some = np.flatnonzero(counts == size) if size < window else np.flatnonzero(counts >= window)
            per = counts[some] - size + 1
            at, owner = co.ragged(first[some], per), np.repeat(some, per)
            hashes = co.run_hashes(values, at, at + size)
            order = np.argsort(hashes, kind="stable")
            hashes, at, owner = hashes[order], at[order], owner[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            for k in np.flatnonzero(~new):
                new[k] = self.said(at[k], size) != self.said(at[k - 1], size)
            number = np.cumsum(new) - 1
            pairs = np.unique(np.stack([number, owner], axis=1), axis=0)
            few = np.zeros(1 << 20, bool)  # a first look-up that stays in the processor's cache
            few[hashes >> np.uint64(44)] = True
            self.by_size.append((size, hashes[new], at[new], np.searchsorted(pairs[:, 0], np.arange(new.sum() + 1)), pairs[:, 1], few))

    def said(self, word: int, size: int) -> bytes:
        return _said(self.low, self.starts, self.ends, word, size)

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """For each text: the number of words, hit word flags over all texts, word starts and ends, items by text."""
        low = co.lowered(raw)
        starts, ends, first = co.words(low, offsets, _WORD)
        n = len(starts)
        counts = np.diff(first)
        cover = np.zeros(n + 1, np.int32)
        items: dict[int, set[str]] = {}
        if n and self.by_size:
            values = co.word_hashes(low, starts, ends)
            stop = np.repeat(first[1:], counts)  # of each word, the end of its text
            for size, hashes, places, bounds, owners, few in self.by_size:
                at = np.flatnonzero(np.arange(n) + size <= stop)
                grams = co.run_hashes(values, at, at + size)
                maybe = few[grams >> np.uint64(44)]
                at, grams = at[maybe], grams[maybe]
                lo, hi = np.searchsorted(hashes, grams), np.searchsorted(hashes, grams, "right")
                for word, a, b in zip(at[lo < hi], lo[lo < hi], hi[lo < hi]):
                    said = _said(low, starts, ends, word, size)
                    for k in range(a, b):
                        if self.said(places[k], size) == said:
                            cover[word] += 1
                            cover[word + size] -= 1
                            found = items.setdefault(int(np.searchsorted(first, word, "right")) - 1, set())
                            found.update(self.names[i] for i in owners[bounds[k] : bounds[k + 1]])
        return counts, np.cumsum(cover[:-1]) > 0, starts, ends, first, items


def _said(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: int, size: int) -> bytes:
    """So many words from this one on, with a space between them."""
    return b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(word, word + size))


def _groups(benchmark: DataFrame, item: str, text: str, max_windows: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in groups of at most ``max_windows`` windows (a single longer item is a group of its own)."""
    group, size = [], 0
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        n = max(1, len(row.text) // 2)  # two characters a window at least
        if size and size + n > max_windows:
            yield group
            group, size = [], 0
        group.append((row.item, row.text))
        size += n
    yield group


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def mark(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: its id and text, counts, items, hit spans (code points, end exclusive) and the decision.

    ``keep`` names further input columns to carry along.
    """
    spark = docs.sparkSession
    carried = list(dict.fromkeys([doc_id, text, *(keep or [])]))
    names = [f"c{i}" for i in range(len(carried))]
    body = names[carried.index(text)]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    groups = _groups(benchmark, item, item_text, max_windows)
    group, last = next(groups), False
    work = Workspace(spark)
    try:
        at = source
        while not last:
            following = next(groups, None)
            last = following is None
            known = spark.sparkContext.broadcast(Grams(group, window))
            at = _pass(at, known, names, kept, body, one_in, last)
            if not last:
                with batch_rows(spark, TEXT_ROWS):
                    at = work.saved(at, "marked")
                known.destroy()
                work.keep_last()
            group = following
        if work.paths:
            at = saved(at, "marked")  # what it reads goes
    finally:
        work.clear()
    return at.toDF(*renamed(carried, RESULTS), *RESULTS)


def _pass(rows: DataFrame, known, names: list[str], kept: str, body: str, one_in: int, last: bool) -> DataFrame:
    """The rows with what earlier passes and this one found: flags of hit words as bits, and items; after the last one
    the results."""
    earlier = "hit_" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = known.value
        for batch in co.slices(batches, body):
            raw, offsets = co.buffers(co.filled(batch[body]))
            counts, hit, starts, ends, first, items = grams.scan(raw, offsets)
            if earlier:
                before = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(batch["hit_"], counts)]
                hit |= np.concatenate([*before, np.zeros(0, np.uint8)]).astype(bool)
                for k, more in enumerate(batch["items_"].to_pylist()):
                    if more:
                        items.setdefault(k, set()).update(more)
            said = [sorted(items.get(k, ()), key=lambda x: (x is None, x)) for k in range(batch.num_rows)]
            columns = [batch[n] for n in names]
            if not last:
                bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary()), pa.array(said, pa.list_(pa.string()))], [*names, "hit_", "items_"])
                continue
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[first[1:]] - sums[first[:-1]]
            spans = [[]] * batch.num_rows
            for k in np.flatnonzero(n_hit):
                spans[k] = _spans(raw, offsets[k], hit[first[k] : first[k + 1]], starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])
            columns += [
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in said], pa.int64()),
                pa.array([hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in said]),
                pa.array((n_hit > 0) & (one_in * n_hit >= counts), pa.bool_()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, *RESULTS])

    more = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start: long, end: long>>" if last else "hit_ binary, items_ array<string>"
    return rows.mapInArrow(run, f"{kept}, {more}")


def _spans(raw: np.ndarray, base: int, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the text."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]
    points = np.concatenate([[0], np.cumsum((raw[base : b[-1]] & 0xC0) != 0x80)])
    return [{"start": int(points[x - base]), "end": int(points[y - base])} for x, y in zip(a, b)]


def remove(docs: DataFrame, benchmark: DataFrame, *, how: str = "documents", text: str = "text", **options) -> DataFrame:
    """``how="documents"``: the uncontaminated documents, columns as they came. ``how="spans"``: every document, with
    the hit spans of the contaminated ones cut from the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    if len(set(docs.columns)) != len(docs.columns):
        raise ValueError("remove() needs distinct column names")
    if how not in ("documents", "spans"):
        raise ValueError(f"how must be documents or spans, not {how!r}")
    inner = dict(zip(docs.columns, names))
    body = inner[text]
    marked = mark(docs.toDF(*names), benchmark, doc_id=inner[options.pop("doc_id", "doc_id")], text=body, keep=names, **options)
    if how == "documents":
        marked = marked.where("not contaminated")
    else:
        # What stands between the spans, from the end of one to the start of the next.
        begins = F.concat(F.array(F.lit(0).cast("long")), F.col("hit_spans.end"))
        ends = F.concat(F.col("hit_spans.start"), F.array(F.length(body).cast("long")))
        between = F.zip_with(begins, ends, lambda a, b: F.substring(F.col(body), a + 1, b - a))
        marked = marked.withColumn(body, F.when(F.col("contaminated"), F.array_join(between, "")).otherwise(F.col(body)))
    return marked.select(*[F.col(inner[c]).alias(c) for c in docs.columns])
