"""Language ID by word-first backoff: known words by per-language log frequency, unseen words by shorter n-grams.

The model knows every word of a sample of labelled rows, whose size is the one bound. A letter is what Unicode calls one
(categories L), in training and in prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label or text teach
nothing; with no labelled row at all every text is ``und``; equal scores go to the language that sorts first; a column to
keep that is named like a result is returned with ``_input`` behind its name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as co
from .components import renamed

#: Labelled rows in the training sample (expected number): the bound of the model.
SAMPLE_ROWS = 4_000
LONGEST_GRAM = 4
#: Words whose n-grams the driver holds at once: what it needs besides the model does not grow with the sample's words.
FIT_WORDS = 16_384
UNDETERMINED = "und"

_RUN = re.compile(r"[^\W\d_]+")  # runs of letters, and of numbers that are no digits, which go out one by one


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters of a lower-case text."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [x for run in runs for x in "".join(c if c.isalpha() else " " for c in run).split()]


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of the words, one word after another, and n + 1 offsets."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return co.mix(np.frombuffer("".join(words).encode("utf-32-le"), "<u4")), np.concatenate([[0], ends]).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray, column: np.ndarray | None = None, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of their rows of counts; or of single counts, each in a column of ``width``."""
    distinct, row = np.unique(keys, return_inverse=True)
    if column is not None:
        return distinct, np.bincount(row * width + column, counts, len(distinct) * width).reshape(len(distinct), width)
    sums = [np.bincount(row, some, len(distinct)) for some in counts.T]
    return distinct, np.stack(sums, axis=1) if sums else np.empty((len(distinct), 0))


@dataclass
class Table:
    """Log probabilities by language (columns) of strings (rows), found by 64-bit hashes of the strings."""

    keys: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> Table:
        """Of ``summed`` parts of the counts, with add-a-half smoothing."""
        keys, matrix = summed(*(np.concatenate(x) for x in zip((np.empty(0, np.uint64), np.empty((0, width))), *parts)))
        matrix += 0.5
        return cls(keys, (np.log(matrix) - np.log(matrix.sum(axis=0))).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of these hashes, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """Known words, and n-grams for each n."""

    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words by language: of the word if it is known, else of its n-grams of the greatest n of which any is
        known, divided by n, as neighbouring n-grams share letters; 0 if no letter is."""
        points, offsets = _points(words)
        row = self.words.find(co.run_hashes(points, offsets[:-1], offsets[1:]))
        out = np.where(row[:, None] >= 0, self.words.scores[row] if len(self.words.keys) else 0.0, 0.0).astype(np.float64)
        rest = np.flatnonzero(row < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(rest):
                break
            points, offsets = _points([words[k] if n == 1 else f" {words[k]} " for k in rest.tolist()])
            per = np.maximum(np.diff(offsets) - n + 1, 0)
            at = co.ragged(offsets[:-1], per)
            row = self.grams[n].find(co.run_hashes(points, at, at + n))
            hit = row >= 0
            owner = np.repeat(np.arange(len(rest)), per)[hit]
            known = np.bincount(owner, minlength=len(rest)) > 0
            for k in range(len(self.languages)):
                out[rest, k] += np.bincount(owner, self.grams[n].scores[row[hit], k], len(rest)) / n
            rest = rest[~known]
        return out


def fit(counts: Iterable[tuple[str, str, int]], languages: list[str]) -> Model:
    """A model of (language, word, count) rows, of which FIT_WORDS are held with their n-grams at once."""
    width, known, grams, rows = len(languages), [], {n: [] for n in range(1, LONGEST_GRAM + 1)}, iter(counts)
    while some := list(itertools.islice(rows, FIT_WORDS)):
        words = [w for _, w, _ in some]
        column = np.array([languages.index(x) for x, _, _ in some], np.int64)
        times = np.array([n for _, _, n in some], float)
        points, offsets = _points(words)
        known.append(summed(co.run_hashes(points, offsets[:-1], offsets[1:]), times, column, width))
        padded = _points([f" {w} " for w in words])
        for n in grams:
            points, offsets = padded if n > 1 else (points, offsets)
            per = np.maximum(np.diff(offsets) - n + 1, 0)
            at = co.ragged(offsets[:-1], per)
            grams[n].append(summed(co.run_hashes(points, at, at + n), np.repeat(1 + np.log(times), per), np.repeat(column, per), width))
    return Model(languages, Table.of(known, width), {n: Table.of(parts, width) for n, parts in grams.items()})


def _rows(tally: pa.Table) -> Iterator[tuple]:
    """The table's rows, of which few are Python objects at once."""
    for batch in tally.to_batches(FIT_WORDS):
        yield from zip(*(column.to_pylist() for column in batch.columns))


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word counts of a sample of about ``sample_rows`` labelled rows, chosen by a hash of ``key`` and the text's length.

    Spark counts the words, in each partition first; the driver gets a row for each word and language of the sample.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.length(f"`{text}`")).alias("h")).where("text is not null and lang is not null")
    n = labelled.where(F.col(f"`{lang}`").isNotNull()).count()
    if n > sample_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    tally = rows.select("lang", word.alias("word")).groupBy("lang", "word").count().toArrow()
    tally = tally.select(["lang", "word", "count"]).sort_by([("lang", "ascending"), ("word", "ascending")])
    model = fit(_rows(tally), sorted(tally["lang"].unique().to_pylist()))
    del tally
    co.release()
    return model


class _Scorer:
    """Scores of texts, each distinct piece between spaces scored once."""

    def __init__(self, model: Model, limit: int = 200_000) -> None:
        self.model, self.width = model, len(model.languages)
        self.cache = co.UnitCache(self._score, limit)
        self._begin()

    def _begin(self) -> None:
        #: Of each piece the sum by language, and the number of words.
        self.table, self.used = np.zeros((1 << 12, self.width + 1), np.float32), 0

    def _score(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of the table for each piece; its number is the piece's one id."""
        if self.cache.n == 0:
            self._begin()
        need = self.used + len(pieces)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.width + 1), np.float32)])
        runs = [letter_runs(piece.lower()) for piece in pieces]
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        first, self.used = self.used, need
        self.table[first:need, self.width] = counts
        owner = np.repeat(np.arange(len(runs)), counts)
        if self.width and len(owner):
            for k, said in enumerate(self.model.score([x for some in runs for x in some]).T):
                self.table[first:need, k] = np.bincount(owner, said, len(runs))
        return np.arange(first, need, dtype=np.int32), np.ones(len(pieces), np.int64)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The summed scores by text and language, and whether a text has a letter."""
        pieces, offsets = co.space_pieces(co.filled(texts))
        ids, _ = self.cache.of(pieces)
        total = np.add.reduceat(self.table[ids], offsets[:-1], axis=0, dtype=np.float64)  # every text has a piece, the empty one too
        return total[:, : self.width], total[:, self.width] > 0.5


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, labels: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all, if None) with the predicted language and its share of the probability, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.columns if keep is None else list(dict.fromkeys(keep))
    names = [f"c{i}" for i in range(len(carried))]
    pairs = list(zip(carried, names))
    body = dict(pairs).get(text, "body")  # a carried text goes to Python once
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in pairs + [(text, "body")] * (body == "body")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer, width = _Scorer(known), len(known.languages)
        for batch in co.slices(batches, body):
            scores, lettered = scorer.scores(batch[body])
            if width:
                best = scores.argmax(axis=1)
                share = 1 / np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -700)).sum(axis=1)
            said = [known.languages[b] if ok and width else UNDETERMINED for b, ok in zip(best if width else lettered, lettered)]
            score = np.where(lettered, share, 0.0) if width else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(said, pa.string()), pa.array(score, pa.float64())], [*names, "p", "s"])

    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "p string, s double"])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, renamed(carried, labels))], F.col("p").alias(labels[0]), F.col("s").alias(labels[1]))


def held_out(key) -> F.Column:
    """Whether a row is of the quarter that no model learns from; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
