"""Phrase collocations by passes over the corpus, one for each phrase length, in the manner of PCY and DHP.

While a pass counts the phrases of one length, it counts the next length's into hash buckets (``hashed_counts``). The
next pass gets two bitmaps of fixed size: buckets that reach the least count, and phrases that were frequent (Apriori: a
phrase is no more frequent than its parts). Only occurrences that pass both are counted one by one, and only those whose
two parts pass are hashed for the length after. Bitmaps only spare work: what passes them is counted exactly, as text,
within each slice of texts, each task and the whole corpus. However full they are, results are the same.

Everything is per language. A phrase's cuts look their parts up among the exact counts; parts that many phrases ask for
are broadcast (at most ``HEAVY`` of them), others joined. Arithmetic is in decimals of 38 digits: exact while counts are
below 10**16.

Defined cases: null and empty texts have no words; a null language is ``und``, and counts with a language of that name;
repeated rows count each; phrases never reach over a delimiter or from one text to the next; ties go to the phrase that
comes first in byte order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import columnar as co
from . import hashed_counts as hc
from .components import TEXT_ROWS, Workspace, batch_rows, saved

UNKNOWN = "und"
#: Buckets of the table of the next length's counts: a byte each in a task, a bit each in the bitmaps.
BUCKETS = 1 << 26
#: Rows of partial counts that a task holds before it sums them.
HELD_ROWS = 400_000
#: Parts that more than one in so many look-ups ask for are broadcast, so at most this many.
HEAVY = 1000
#: Each language's best are first taken in so many shares.
SHARES = 64
SCALE = 1_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _longer(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return co.mix(left * _STEP + word)


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and these."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)


def _behind(values: np.ndarray, by: int) -> np.ndarray:
    """The values that stand so many places further on; zeros at the end."""
    out = np.zeros_like(values)
    out[: max(len(values) - by, 0)] = values[by:]
    return out


class _Words:
    """A slice's words in order: the number of each among the distinct ones of its language, and a hash; and whether the
    next word goes on in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        raw, offsets = co.buffers(co.filled(texts))
        low = co.lowered(raw)
        starts, ends, first = co.words(low, offsets, _WORD)
        counts = np.diff(first)
        piece = np.cumsum(_BREAK[low], dtype=np.int64)[starts] + np.repeat(np.arange(len(counts)), counts)
        self.goes_on = np.append(piece[1:] == piece[:-1], False)[: len(starts)]
        lengths = ends - starts
        coded = co.string_array(low[co.ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
        said = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        lang = np.repeat(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        self.number, distinct = _coded(lang * max(len(coded.dictionary), 1) + said)
        self.lang, self.word = np.divmod(distinct, max(len(coded.dictionary), 1))
        self.langs, self.words = known.dictionary, coded.dictionary
        self.hash = hashes(self.words, self.langs, self.word, self.lang)[self.number]

    def __len__(self) -> int:
        return len(self.number)

    def counted(self, at: np.ndarray, size: int) -> pa.Table:
        """(lang, phrase, n) of the phrases of ``size`` words that begin there, each distinct one once."""
        code = self.number[at]
        for k in range(1, size):
            code, _ = _coded(code * len(self.lang) + self.number[at + k])
        if size == 1:
            code, _ = _coded(code)
        n = np.bincount(code)
        one = np.empty(len(n), np.int64)
        one[code] = at
        words = [self.words.take(pa.array(self.word[self.number[one + k]])) for k in range(size)]
        phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", self.words.type))
        lang = self.langs.take(pa.array(self.lang[self.number[one]]))
        return pa.table([lang.cast(pa.string()), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def hashes(words: pa.Array, langs: pa.Array, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A hash of each pair of a word and a language, given as numbers of them."""

    def each(texts: pa.Array) -> np.ndarray:
        raw, offsets = co.buffers(texts)
        return co.word_hashes(raw, offsets[:-1], offsets[1:])

    return co.mix(each(words)[word] ^ co.mix(each(langs)[lang] + _STEP))


def _pass(docs: DataFrame, size: int, frequent, buckets, last: bool, min_count: int, room: int) -> DataFrame:
    """(lang, phrase, n): partial counts of the phrases of ``size`` words; and in rows of their own (block, at, counts) the
    bucket counts of those of one word more. ``frequent`` and ``buckets`` are broadcast bitmaps, or None; ``room`` is the number of buckets."""
    slice_bytes, held_rows = co.SLICE_BYTES, HELD_ROWS

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(table)
        nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
        columns = [table["lang"], table["phrase"].cast(pa.large_string()), table["n"], *nothing]
        yield from pa.table(columns, ["lang", "phrase", "n", "block", "at", "counts"]).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = None if last else hc.Tally(min_count, room)
        held, rows = [], 0
        for batch in co.slices(batches, "text", slice_bytes):
            words = _Words(batch["text"], batch["lang"])
            if not len(words):
                continue
            # ok: of each place whether the phrase that begins there stands in one piece and may be frequent; h: its hash
            ok, h = np.ones(len(words), bool), words.hash
            for k in range(2, size + 1):
                if k == size:
                    ok &= hc.marked(frequent.value, h, room)
                ok &= _behind(ok, 1) & words.goes_on
                h = _longer(h, _behind(words.hash, k - 1))
            if size > 1:
                ok &= hc.marked(buckets.value, h, room)
            at = np.flatnonzero(ok)
            if len(at):
                held.append(words.counted(at, size))
                rows += len(held[-1])
            if tally is not None:
                tally.add(_longer(h, _behind(words.hash, size))[ok & _behind(ok, 1) & words.goes_on])
            if rows > held_rows:
                held = [summed(held)]
                if (rows := len(held[0])) > held_rows // 2:
                    yield from sent(held[0])
                    held, rows = [], 0
        if held:
            yield from sent(summed(held))
        if tally is not None:
            blocks = tally.rows()
            n = blocks.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.large_string()), pa.nulls(n, pa.int64()), *blocks.columns], ["lang", "phrase", "n", "block", "at", "counts"])

    return docs.mapInArrow(run, f"lang string, phrase string, n long, {hc.ROWS}")


def _marks(frequent: DataFrame, size: int, room: int) -> DataFrame:
    """Bucket rows of the phrases, for a bitmap of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hc.Tally(1, room)
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch["phrase"], " ").flatten()
                known = batch["lang"].dictionary_encode()
                each = np.repeat(known.indices.to_numpy(zero_copy_only=False), size)
                h = hashes(words, known.dictionary, np.arange(len(words)), each).reshape(-1, size)
                tally.add(reduce(_longer, h.T))
        yield tally.rows()

    return frequent.mapInArrow(run, hc.ROWS)


def frequent_phrases(docs: DataFrame, work: Workspace, *, max_words: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(size, lang, phrase, n) of all phrases of up to ``max_words`` words that occur ``min_count`` times; and (lang, n) of
    all words."""
    if not 1 <= min_count < 1 << 16:
        raise ValueError("min_count must be from 1 to 65,535")
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    found, totals, frequent, full = [], None, None, None
    for size in range(1, max_words + 1):
        last = size == max_words
        part = work.saved(_pass(source, size, frequent, full, last, min_count, buckets), f"phrases-{size}")
        counts = part.where("n is not null")
        if totals is None:
            totals = work.saved(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        known = work.saved(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), f"frequent-{size}")
        found.append(known.select(F.lit(size).alias("size"), "lang", "phrase", "n"))
        for old in (frequent, full):
            if old is not None:
                old.destroy()
        if not last:
            full = spark.sparkContext.broadcast(hc.bitmap(part.where("block is not null").select("block", "at", "counts"), min_count, buckets))
            frequent = spark.sparkContext.broadcast(hc.bitmap(_marks(known.select("lang", "phrase"), size, buckets), 1, buckets))
    return reduce(DataFrame.unionByName, found), totals


def _looked_up(asked: DataFrame, part: str, counts: DataFrame, name: str, work: Workspace) -> DataFrame:
    """``asked`` with the count of the phrase in column ``part``. Parts that many rows ask for meet them by broadcast."""
    each = asked.groupBy("lang", part).agg(F.count(F.lit(1)).alias("times"))
    known = counts.select(F.col("lang"), F.col("phrase").alias(part), F.col("n").alias(name))
    heavy = each.where(F.col("times") * HEAVY > max(asked.count(), 1)).select("lang", part)
    heavy = work.saved(known.join(F.broadcast(heavy), ["lang", part]), "heavy")
    met = asked.join(F.broadcast(heavy), ["lang", part], "left")
    rest = met.where(F.col(name).isNull()).drop(name).join(known, ["lang", part])
    return met.where(F.col(name).isNotNull()).unionByName(rest)


def score(a, left, right):
    """floor(SCALE * a * a / (left * right)) of long columns, exactly."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, cover: tuple[int, int] = (50, 100), top: int = 2000, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to ``max_words`` words, without those that a
    longer one covers; the best ``top`` of them.

    ``a`` occurrences of the phrase; ``l`` and ``r`` of its parts at the cut that scores least, the first of such;
    ``n`` words of the language. A phrase is covered by a longer one that holds it and has at least ``cover`` of its
    occurrences.
    """
    with Workspace(docs.sparkSession) as work, batch_rows(docs.sparkSession, TEXT_ROWS):
        counts, totals = frequent_phrases(docs, work, max_words=max_words, min_count=min_count, text=text, lang=lang, buckets=buckets)
        phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
        cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
        cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), "w", cut)
        some = lambda start, length: F.array_join(F.slice("w", start, length), " ")
        cuts = work.saved(cuts.select("lang", "phrase", "a", "cut", some(F.lit(1), F.col("cut")).alias("first"), some(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest")), "cuts")
        with_l = work.saved(_looked_up(cuts, "first", counts, "l", work), "with-first")
        scored = _looked_up(with_l, "rest", counts, "r", work).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
        least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s"))
        # Of each phrase the largest count of a longer one that holds it.
        inner = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")
        holders = phrases.where("size > 2").select("lang", F.col("n").alias("longer"), F.explode(inner).alias("phrase"))
        holders = holders.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = least.join(holders, ["lang", "phrase"], "left").where(F.coalesce(cover[1] * F.col("longer") < cover[0] * F.col("s.a"), F.lit(True)))
        kept = work.saved(kept.select("lang", "phrase", "s.*"), "kept")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))  # each sorted in a task of its own
        place = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        best = kept.withColumn("share", share).withColumn("place", place).where(F.col("place") <= top)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        ranked = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang")
        return saved(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
