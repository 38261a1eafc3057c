"""Answers put together from server-sent lines that arrive in any order, over many micro-batches.

What lines say is read in columns; the state of an answer is its pieces by line number. Answers are dealt to buckets, each
of which is one group with one state, as a group costs some milliseconds in Python whatever it holds; so the state that a
task holds at once is one bucket's answers. Lines of one answer meet in one task; different buckets spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.prompt import line_data, line_delta

ANSWERS = "stream_id string, answer string, pieces long, complete boolean"
#: A bucket's answers, and their pieces one answer after the other.
_STATE = "streams array<string>, attempts array<long>, dues array<long>, ends array<long>, saids array<boolean>, sizes array<long>, ords array<long>, deltas array<string>"


def answers(lines: DataFrame, *, delay: str = "10 minutes", patience: int = 600, buckets: int = 1024) -> DataFrame:
    """(stream_id, answer, pieces, complete): one row for each answer of a stream of lines (stream_id string, attempt
    long, ord long from 0, line string, at timestamp), as soon as its end mark and every line before it are there.

    An answer whose newest line lies ``patience`` seconds behind the watermark, which follows ``at`` by ``delay``, is given
    as it stands: incomplete, its pieces up to the end mark, if that came, joined in order. Lines of a higher attempt replace
    what came before, as a request that is sent again gives its answer from the start; older attempts' lines say nothing.
    A line that comes twice counts once, the first time (of different ones in one batch the least); empty or broken data
    has no piece but counts as a line. Nothing is given twice: a finished answer is remembered until its patience is over.
    Lines without stream_id, ord or at, or later than the watermark, are left out; a null attempt is 0. For append mode.

    ``buckets``: more of them keep states smaller where very many answers are open at once; a checkpoint keeps its number.
    """
    data = line_data(F.col("line"))
    said = lines.withWatermark("at", delay).where("stream_id IS NOT NULL AND ord IS NOT NULL AND at IS NOT NULL")
    said = said.select(F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).alias("bucket"), "stream_id", F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"), F.col("ord").cast("long").alias("ord"), F.coalesce(line_delta(data), F.lit("")).alias("delta"), F.coalesce(data == "[DONE]", F.lit(False)).alias("end"), "at", F.unix_millis("at").alias("ms"))
    return said.groupBy("bucket").applyInPandasWithState(_step(patience * 1000), ANSWERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Answer:
    """What is known of an answer; it times out where the watermark reaches ``due``."""

    __slots__ = ("attempt", "due", "ended", "said", "known")

    def __init__(self, attempt: int = -1, due: int = 0, ended: int | None = None, said: bool = False, known: dict[int, str] | None = None) -> None:
        self.attempt, self.due, self.ended, self.said, self.known = attempt, due, ended, said, known or {}

    def row(self, stream: str, complete: bool) -> tuple[str, str, int, bool]:
        some = [self.known[i] for i in sorted(self.known) if self.known[i] and (self.ended is None or i < self.ended)]
        return stream, "".join(some), len(some), complete


def _unpacked(state: tuple) -> dict[str, _Answer]:
    streams, attempts, dues, ends, saids, sizes, ords, deltas = state
    out, lo = {}, 0
    for stream, attempt, due, ended, said, n in zip(streams, attempts, dues, ends, saids, sizes):
        out[stream] = _Answer(attempt, due, ended, said, dict(zip(ords[lo : lo + n], deltas[lo : lo + n])))
        lo += n
    return out


def _packed(held: dict[str, _Answer]) -> tuple:
    some = list(held.values())
    columns = ([getattr(a, c) for a in some] for c in ("attempt", "due", "ended", "said"))
    return list(held), *columns, [len(a.known) for a in some], [i for a in some for i in a.known], [x for a in some for x in a.known.values()]


def _step(patience: int):
    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        touched: dict[str, dict[int, str]] = {}  # this batch's new pieces
        for rows in () if state.hasTimedOut else batches:
            for stream, attempt, ord_, delta, end, ms in zip(*(rows[c].tolist() for c in ("stream_id", "attempt", "ord", "delta", "end", "ms"))):
                a = held.get(stream)
                if a is None:
                    a = held[stream] = _Answer()
                fresh = touched.setdefault(stream, {})
                a.due = max(a.due, ms + patience, watermark + 1)
                if a.said or attempt < a.attempt:
                    continue
                if attempt > a.attempt:
                    a.attempt, a.known, a.ended = attempt, {}, None
                    fresh.clear()
                if end:
                    a.ended = ord_ if a.ended is None else min(a.ended, ord_)
                if ord_ not in a.known:
                    fresh[ord_] = min(fresh.get(ord_, delta), delta)
        given = []
        for stream, fresh in touched.items():
            a = held[stream]
            a.known.update(fresh)
            if not a.said and a.ended is not None and all(i in a.known for i in range(a.ended)):
                given.append(a.row(stream, True))
                a.known, a.said = {}, True
        for stream in [s for s, a in held.items() if a.due <= watermark and s not in touched]:
            a = held.pop(stream)
            if not a.said:
                given.append(a.row(stream, False))
        if held:
            state.update(_packed(held))
            state.setTimeoutTimestamp(min(a.due for a in held.values()))
        else:
            state.remove()
        if given:
            yield pd.DataFrame(given, columns=["stream_id", "answer", "pieces", "complete"])

    return step


def append(lines: DataFrame, out: str, checkpoint: str, *, delay: str = "10 minutes", patience: int = 600, buckets: int = 1024) -> None:
    """Take what is new of a stream of lines and add the answers that it finishes to Parquet files; waits for the end."""
    answers(lines, delay=delay, patience=patience, buckets=buckets).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
