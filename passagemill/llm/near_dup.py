"""Near duplicates by SetSketch registers.

A document's set holds its distinct five-word shingles. Every shingle emits a Poisson stream of points over the
registers; a register keeps the least point and stores it on an exponential scale, cut off to 16 bits. Sketches of
unions are register-wise maxima. Four registers make a band; documents that share a band value are candidates, a joint
maximum-likelihood estimate of the Jaccard similarity screens them, and the full sets decide.

Groups of copies: documents with equal sets form one class, which a 128-bit fingerprint of the set stands for, so copies
never meet in pairs, and rows need no ids of their own. (That equal fingerprints mean equal sets is the one thing that
isn't confirmed on the sets: two of 10**12 sets share one with a chance of one in 10**14.) In each bucket every class is
first compared with the bucket's least one only. What is then connected needs no more comparisons; buckets that still
hold several components are compared in blocks, across components, until each pair is either joined through others or
decided; each pair of blocks is a row of its own, dealt out by bucket and block. No partner is capped or sampled away.

Defined cases: null and empty texts, and texts of white space, have no shingles and link with nothing; fewer than five
words make one shingle; repeated rows of a document are one class; different texts of one id are decided each by itself;
a component has its least id, and that id's class is kept; a component without any id has none, and one class of it is
kept; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import columnar as co
from .components import TEXT_ROWS, Workspace, batch_rows, labelled, saved

SHINGLE, SIMILARITY = 5, (75, 100)
REGISTERS, BAND = 128, 4
BASE, RATE = 1.001, 20.0
#: Estimates below the threshold by this much (4.5 standard deviations) are not looked at.
MARGIN = 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20
#: Of the two halves of a set's fingerprint.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, flat, and n + 1 offsets."""
    low = co.lowered(raw)
    starts, ends, first = co.words(low, offsets, _WORD)
    values = co.word_hashes(low, starts, ends)
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = co.ragged(first[:-1], per)
    grams = co.run_hashes(values, at, at + np.repeat(np.minimum(counts, size), per))
    bounds = np.concatenate([[0], np.cumsum(per)])
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else grams), np.concatenate([[0], np.cumsum(sizes)])


def sketches(grams: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each set: floor(1 - log_b(least point)), within 0 to 65,535; rows of empty sets are 0."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    least = np.full((n, registers), np.inf)
    todo = np.flatnonzero(sizes)
    # of a set of s, all registers have their least point below (ln m + 3) / s nearly always; else look further
    reach = (np.log(registers) + 3) / np.maximum(sizes, 1)
    while len(todo):
        flat = least.reshape(-1)
        element = co.ragged(offsets[todo], sizes[todo])
        owner = np.repeat(todo, sizes[todo])
        state = grams[element]
        x = np.zeros(len(state))
        least[todo] = np.inf
        limit = reach[owner]
        while len(state):
            state = co.mix(state + _STEP)
            x = x - np.log(((state >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / registers
            near = x <= limit
            state, x, owner, limit = state[near], x[near], owner[near], limit[near]
            np.minimum.at(flat, owner * registers + (state & np.uint64(registers - 1)).astype(np.int64), x)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        reach[todo] *= 2
    with np.errstate(divide="ignore"):
        scale = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(sizes[:, None] > 0, scale, 0), 0, 65535).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch; it holds the band's number."""
    bands = sketch.shape[1] // BAND
    cells = np.ascontiguousarray(sketch.reshape(len(sketch) * bands, BAND)).view(np.uint64).reshape(len(sketch), bands)
    return co.mix(cells ^ co.mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates from paired rows of registers and the sets' sizes."""
    up = (a > b).sum(axis=1).astype(float)
    down = (a < b).sum(axis=1).astype(float)
    return _likely(up, down, a.shape[1], na, nb)


def _likely(up: np.ndarray, down: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    equal = m - up - down
    log_b, q = np.log(BASE), (BASE - 1) / BASE

    def value(j: np.ndarray) -> np.ndarray:
        more = np.maximum(-np.log1p(-np.maximum(u - v * j, 0) * q) / log_b, 1e-300)
        less = np.maximum(-np.log1p(-np.maximum(v - u * j, 0) * q) / log_b, 1e-300)
        return up * np.log(more) + down * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-300))

    ratio = (5**0.5 - 1) / 2
    for _ in range(24):  # golden section: the likelihood is concave
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, id, sketch): the set's size, a 128-bit fingerprint of it, and its registers."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in co.slices(batches, "text"):
            grams, offsets = shingle_sets(*co.buffers(co.filled(batch["text"])))
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), _fingerprints(grams, offsets), _rows(sketches(grams, offsets))], ["doc_id", "n", "id", "sketch"])

    return source.mapInArrow(run, "doc_id long, n long, id binary, sketch binary")


def _rows(table: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    width = table.shape[1] * table.itemsize
    data = pa.py_buffer(np.ascontiguousarray(table))
    return pa.BinaryArray.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(np.arange(len(table) + 1, dtype=np.int32) * np.int32(width)), data])


def _fingerprints(grams: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A 128-bit hash of each set."""
    halves = []
    for seed in SEEDS:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(co.mix(grams ^ np.uint64(seed)), dtype=np.uint64)])
        halves.append(co.mix(sums[offsets[1:]] - sums[offsets[:-1]]))
    return _rows(np.stack(halves, axis=1))


def _sets(docs: DataFrame, doc_id: str, text: str, needed: DataFrame) -> DataFrame:
    """(id, grams): packed full sets of the classes ``needed`` (id, rep: its least document).

    Texts stay where they are read: a Bloom filter of the documents picks those worth a set, and only sets are shuffled.
    """
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(needed, "rep"))
    key = F.col(f"`{doc_id}`").cast("long")
    source = docs.select(key.alias("id"), *bloom.hashes(key), F.col(f"`{text}`").alias("text"))

    # Rows without an id are looked at only where a class has no other.
    lone = not needed.where("rep is null").isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            blank = whole["id"].is_null().to_numpy(zero_copy_only=False)
            picked = whole.filter(pa.array(np.where(blank, lone, bloom.maybe(words.value, whole))))
            for batch in co.slices(iter([picked]), "text"):
                grams, offsets = shingle_sets(*co.buffers(co.filled(batch["text"])))
                raw = grams.tobytes()
                ids = _fingerprints(grams, offsets)
                _, first = np.unique(ids.dictionary_encode().indices.to_numpy(), return_index=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array([raw[8 * offsets[k] : 8 * offsets[k + 1]] for k in first], pa.binary())], ["id", "grams"])

    return source.mapInArrow(run, "id binary, grams binary").join(needed.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _banded(classes: DataFrame) -> DataFrame:
    """(key, id): each class in its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch["id"].take(pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1])))], ["key", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "key long, id binary")


def _screened(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of those pairs (a, b, na, nb, sa, sb) whose estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                batch = big.slice(lo, 4096)
                rows = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
                sizes = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
                good = likely_jaccard(*rows, *sizes) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))
        co.release()

    return pairs.mapInArrow(run, "a binary, b binary")


def enough(shared, total, similarity: tuple[int, int] = SIMILARITY):
    """Whether an intersection of sets with ``total`` elements in sum reaches the similarity."""
    return similarity[1] * shared >= similarity[0] * (total - shared)


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, ga, gb) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch["ga"], batch["gb"])):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good[k] = enough(_shared(p, q), len(p) + len(q))
            yield batch.select(["a", "b"]).filter(pa.array(good))
        co.release()

    return pairs.mapInArrow(run, "a binary, b binary")


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _across(blocks: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) between different components of the blocks' members.

    A row holds two lists of members, or the same one twice. Pairs are taken by falling estimate; those that links
    found before have joined are passed over, so a row gives fewer links than it has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch[c][row].values for c in ("x", "y"))
                part = [tuple(s.field(c) for c in ("id", "component", "n", "sketch", "grams")) for s in (x, y)]
                coded = pa.chunked_array([part[0][1], part[1][1]]).combine_chunks().dictionary_encode()
                comps = np.split(coded.indices.to_numpy(zero_copy_only=False), [len(x)])
                ids, sizes = [p[0] for p in part], [p[2].to_numpy(zero_copy_only=False) for p in part]
                regs = [np.frombuffer(b"".join(p[3].to_pylist()), np.uint16).reshape(len(p[3]), -1) for p in part]
                found = []
                for i in range(len(ids[0])):
                    other = np.flatnonzero(comps[1] != comps[0][i])
                    if not len(other):
                        continue
                    small, large = np.minimum(sizes[1][other], sizes[0][i]), np.maximum(sizes[1][other], sizes[0][i])
                    other = other[small >= least * large]
                    up, down = (regs[0][i] > regs[1][other]).sum(axis=1).astype(float), (regs[0][i] < regs[1][other]).sum(axis=1).astype(float)
                    some = (REGISTERS - up - down) >= 0.8 * least * REGISTERS
                    other, up, down = other[some], up[some], down[some]
                    if len(other):
                        guess = _likely(up, down, REGISTERS, np.full(len(other), float(sizes[0][i])), sizes[1][other].astype(float))
                        found += [(g, i, int(j)) for g, j in zip(guess, other) if g >= least]
                root = list(range(len(coded.dictionary)))

                def top(c: int) -> int:
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    return c

                links = []
                for _, i, j in sorted(found, reverse=True):
                    a, b = top(int(comps[0][i])), top(int(comps[1][j]))
                    if a != b:
                        p, q = (np.frombuffer(part[side][4][k].as_buffer(), np.uint64) for side, k in ((0, i), (1, j)))
                        if enough(_shared(p, q), len(p) + len(q)):
                            root[a] = b
                            links.append((ids[0][i].as_py(), ids[1][j].as_py()))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])
        co.release()

    return blocks.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    with Workspace(docs.sparkSession) as work, batch_rows(docs.sparkSession, TEXT_ROWS):
        return saved(_decided(docs, doc_id, text, work).drop("class"), "near-duplicates")


def _decided(docs: DataFrame, doc_id: str, text: str, work: Workspace) -> DataFrame:
    least = SIMILARITY[0] / SIMILARITY[1] - MARGIN
    sig = work.saved(signatures(docs, doc_id, text), "signatures")
    classes = work.saved(sig.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    named = classes.select("id", "n", "sketch")
    banded = _banded(classes)
    # Written, so that the join that follows deals out both sides anew, and a full bucket may be split.
    buckets = work.saved(banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").select("key", "hub"), "buckets")
    members = work.saved(banded.join(buckets, "key"), "members")  # key, id, hub: only of buckets with several classes

    pairs = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    left, right = (named.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    close = work.saved(_screened(pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb"), least), "close")
    # Full sets of all members, from one pass over the texts: for these links and for the blocks below.
    sets = work.saved(_sets(docs, doc_id, text, work.saved(classes.select("id", "rep").join(members.select("id").distinct(), "id"), "needed")), "sets")
    left, right = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    links = work.saved(_verified(close.join(right, "b").join(left, "a").select("a", "b", "ga", "gb")), "links")
    found = work.saved(labelled(links, work), "components")

    # Buckets whose members, without the hub that all were compared with, are in several components.
    rest = members.where("id != hub").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = work.saved(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"), "split")
    open_ = work.saved(rest.join(split, "key").select("key", "id", "component"), "open")
    if open_.isEmpty():
        return _result(sig, classes, found)
    needed = open_.select("id").distinct()
    known = work.saved(named.join(needed, "id", "left_semi").join(sets, "id"), "known")
    # Blocks of about so many members and bytes; a bucket has as many blocks as it needs.
    cells = open_.join(known.select("id", "n"), "id").groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("cells"))
    cells = work.saved(cells, "cells")
    rows = open_.join(cells, "key").join(known, "id")
    cell = F.pmod(F.xxhash64("id", "key"), F.col("cells")).cast("int")
    blocks = rows.withColumn("cell", cell).groupBy("key", "cells", "cell").agg(F.collect_list(F.struct("id", "component", "n", "sketch", "grams")).alias("list"))
    blocks = work.saved(blocks, "blocks")
    # One side is shuffled once, by its own number; the other goes to all that it meets.
    still = blocks.select("key", F.col("cell").alias("j"), F.col("list").alias("y"))
    sent = blocks.select("key", F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("j"), F.col("list").alias("x"))
    cross = sent.join(still, ["key", "j"]).select("x", "y")
    with batch_rows(docs.sparkSession, 4):
        more = work.saved(_across(cross, least), "more_links")
    if not more.isEmpty():
        found = work.saved(labelled(links.unionByName(more), work), "components")
    return _result(sig, classes, found)


def _result(sig: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class), a row for each signature."""
    parts = classes.select("id", "rep").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    # Of each component its least document, and the class that is kept: of that document, or without any a class of none.
    heads = parts.groupBy("component").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "id"))["id"].alias("head"))
    named = parts.join(heads, "component").select("id", "component_id", "head")
    rows = sig.select("doc_id", "n", "id").join(named, "id", "left")
    empty = F.col("n") == 0
    kept = empty | ((F.col("id") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"), F.col("id").alias("class"))


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns they came with: of each kept class one row of each id, or without
    ids one row; rows with neither id nor shingles all stay.

    A Bloom filter of the ids that are dropped or repeated lets all others pass without a shuffle. Repeated ids, and
    rows without an id, are told apart by their classes.
    """
    spark = docs.sparkSession
    with Workspace(spark) as work, batch_rows(spark, TEXT_ROWS):
        said = work.saved(_decided(docs, doc_id, text, work), "decided")
        ids = said.where("doc_id is not null").groupBy(F.col("doc_id").alias("id_")).agg(F.max("kept").alias("kept_"), F.count(F.lit(1)).alias("rows_"))
        odd = saved(ids.where("not kept_ or rows_ > 1").select("id_", "kept_"), "odd")
        several = said.where("kept").join(odd.where("kept_"), F.col("doc_id") == F.col("id_"), "left_semi")
        several = saved(several.select(F.col("doc_id").alias("head_id"), F.col("class").alias("head_class")).distinct(), "several")
        nameless = saved(said.where("kept and doc_id is null and n_shingles > 0").select(F.col("class").alias("head_class")).distinct(), "nameless")
    words = spark.sparkContext.broadcast(bloom.build(odd, "id_"))
    key = F.col(f"`{doc_id}`").cast("long")
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], key.alias("id"), F.col(f"`{text}`").alias("text"), *bloom.hashes(key))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~bloom.maybe(words.value, batch))).select(names)

    def classed(picked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in co.slices(iter([whole.filter(pa.array(picked(whole)))]), "text"):
                    grams, offsets = shingle_sets(*co.buffers(co.filled(batch["text"])))
                    more = [pa.array(np.diff(offsets), pa.int64()), _fingerprints(grams, offsets)]
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in [*names, "id"]), *more], [*names, "id", "n", "class"])

        return run

    with_class = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in [*names, "id"]), "n long, class binary"])
    have, lack = source.where("id is not null"), source.where("id is null")
    met = have.mapInArrow(classed(lambda batch: bloom.maybe(words.value, batch)), with_class).join(odd, F.col("id") == F.col("id_"), "left").where("coalesce(kept_, true)")
    met = met.join(several, (F.col("id") == F.col("head_id")) & (F.col("class") == F.col("head_class")), "left").where("kept_ is null or head_id is not null").dropDuplicates(["id", "class"])
    alone = lack.mapInArrow(classed(lambda batch: np.ones(batch.num_rows, bool)), with_class)
    one = alone.where("n > 0").join(nameless, F.col("class") == F.col("head_class"), "left_semi").dropDuplicates(["class"])
    parts = [have.select(*names, "b1", "b2").mapInArrow(clear, source.select(*names).schema), *(x.select(*names) for x in (met, one, alone.where("n = 0")))]
    return reduce(DataFrame.unionByName, parts).toDF(*docs.columns)
