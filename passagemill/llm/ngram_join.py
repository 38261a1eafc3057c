"""N-gram Jaccard join by prefixes under several global token orders.

Of two sets with n and m tokens and enough in common, o = ceil(t (n + m) / (1 + t)) tokens or more are shared. Under any
global order of tokens the first n - o + k of one and m - o + k of the other then share k tokens at least, for every k up
to o. Three orders are used. Under the first one, rare tokens first, the first n - ceil(t n) + 1 tokens of a set are its
buckets: linked sets meet in one. Tokens' counts come from a table of fixed size (``hashed_counts``), so nothing is
shuffled for them; any counts give an order, better ones give fewer candidates. Under the other two, falling and rising
hashes, a pair must share what it has to of a longer prefix, too; only pairs that pass all three are decided, on the full
sets. The filters lose no link. Buckets are by bands of sizes, too, as linked sets have nearly the same size.

Groups of copies: texts with equal sets form one class, named by a 128-bit fingerprint (in first buckets by half of it), so
copies never meet in pairs.
Of buckets with the same classes, as the tokens of a shared passage give, one is kept. In each bucket every class is first
compared with the bucket's least one only. Of buckets that then still hold several components, those of few classes give
the pairs across components; larger ones are compared in blocks, until each pair is either joined through others or
decided. Each pair of blocks is a row of its own, in the task of one block, which is shuffled once; the other goes to all
that it must meet. No partner is capped or sampled away.

Defined cases: null and empty texts, and texts of white space, have no tokens and link with nothing; fewer words than a
shingle make one token; repeated rows of a document are one class; different texts of one id are decided each by itself; a
component has its least id, one without any id has none; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import columnar as co
from . import hashed_counts as hc
from .components import TEXT_ROWS, Workspace, batch_rows, labelled, saved
from .near_dup import _fingerprints, _shared, shingle_sets

SHINGLE, SIMILARITY = 4, (85, 100)
#: Counts of tokens stop here.
LIMIT = 65_535
#: The longer prefixes of the second and third order have so many percent of a set more than the shortest.
LONGER = 5
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20
#: Buckets of so few classes give their pairs, at most so many for each class; larger ones are met in blocks.
FEW = 32
#: Classes with more than one in HEAVY pairs of candidates (so at most HEAVY of them) are copied, for so many pairs each.
HEAVY, SPREAD_ROWS = 1000, 4096


def _least(n, similarity: tuple[int, int]):
    """Tokens that any partner of sets of n tokens shares with them at least."""
    return -(-similarity[0] * n // similarity[1])


def _overlap(n, m, similarity: tuple[int, int]):
    """Tokens that linked sets of n and m tokens share at least."""
    return -(-similarity[0] * (n + m) // (similarity[0] + similarity[1]))


def size_bands(similarity: tuple[int, int]) -> np.ndarray:
    """The least sizes of bands of sets, such that linked sets are in the same band or in neighbouring ones. Wider bands are
    as right, so they never get so narrow that there are very many."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(1 + max(least[-1] * similarity[1] // similarity[0], least[-1] + least[-1] // 1000))
    return np.array(least)


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, buckets: int) -> DataFrame:
    """(doc_id, n, id, h): each text's set size, fingerprint, and half of it as a number; and in rows of their own the
    bucket counts of tokens."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hc.Tally(LIMIT, buckets)
        names = ["doc_id", "n", "id", "h", "block", "at", "counts"]
        for batch in co.slices(batches, "text"):
            grams, offsets = shingle_sets(*co.buffers(co.filled(batch["text"])), size)
            tally.add(co.mix(grams))
            nothing = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets), pa.int64()), ids := _fingerprints(grams, offsets), _half(ids), *nothing], names)
        blocks = tally.rows()
        nothing = [pa.nulls(blocks.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nothing, *blocks.columns], names)

    return source.mapInArrow(run, f"doc_id long, n long, id binary, h long, {hc.ROWS}")


def _half(ids: pa.Array) -> pa.Array:
    """The first half of fingerprints, as a number."""
    raw, _ = co.buffers(ids)
    return pa.array(np.ascontiguousarray(raw).view(np.int64)[::2])


def _class_sets(docs: DataFrame, doc_id: str, text: str, size: int, needed: DataFrame) -> Iterator:
    """A source of texts of which those of needed classes (rep) surely are among the picked, and what picks them."""
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(needed, "rep"))
    lone = not needed.where("rep is null").isEmpty()  # rows without an id are looked at only where a class has no other
    key = F.col(f"`{doc_id}`").cast("long")
    source = docs.select(key.alias("id"), *bloom.hashes(key), F.col(f"`{text}`").alias("text"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """Sets, their offsets and fingerprints, and of each distinct set that isn't empty its place, slice by slice."""
        for whole in batches:
            blank = whole["id"].is_null().to_numpy(zero_copy_only=False)
            rows = whole.filter(pa.array(np.where(blank, lone, bloom.maybe(words.value, whole))))
            for batch in co.slices(iter([rows]), "text"):
                grams, offsets = shingle_sets(*co.buffers(co.filled(batch["text"])), size)
                ids = _fingerprints(grams, offsets)
                _, first = np.unique(ids.dictionary_encode().indices.to_numpy(), return_index=True)
                yield grams, offsets, ids, first[np.diff(offsets)[first] > 0]

    return source, picked


def prefixes(docs: DataFrame, doc_id: str, text: str, size: int, similarity: tuple[int, int], classes: DataFrame, counts, buckets: int) -> DataFrame:
    """(key, h): the tokens of each class's shortest prefix under the first order. ``counts``: a broadcast table of tokens'
    counts. Copies of a class may give it several times."""
    source, picked = _class_sets(docs, doc_id, text, size, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, offsets, ids, first in picked(batches):
            sizes = np.diff(offsets)
            often = counts.value[hc.bucket_of(co.mix(grams), buckets)]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((grams, often, owner))  # by text, rarest first
            place = np.arange(len(grams)) - np.repeat(offsets[:-1], sizes)
            wanted = np.zeros(len(sizes), bool)
            wanted[first] = True
            keep = order[wanted[owner] & (place <= (sizes - _least(sizes, similarity))[owner])]
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), _half(ids).take(pa.array(owner[keep]))], ["key", "h"])

    return source.mapInArrow(run, "key long, h long")


def by_size(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(key, id) of members (key, id, n): a bucket for each of two bands of sizes, the own one and the next. So linked
    sets, whose bands are neighbours at most, still share one."""
    bands = size_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = np.searchsorted(bands, batch["n"].to_numpy(zero_copy_only=False), "right").astype(np.uint64)
            key = batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            for more in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(co.mix(key ^ co.mix(band + np.uint64(more))).view(np.int64)), batch["id"]], ["key", "id"])

    return members.select("key", "id", "n").mapInArrow(run, "key long, id binary")


def _sets_of(docs: DataFrame, doc_id: str, text: str, size: int, needed: DataFrame, columns: str, made) -> DataFrame:
    """(id, n, columns): what ``made`` gives of the sets of the classes ``needed`` (id, rep): a list for each column."""
    source, picked = _class_sets(docs, doc_id, text, size, needed)
    names = ["id", "n", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, offsets, ids, first in picked(batches):
            rows = zip(*(made(grams[offsets[k] : offsets[k + 1]]) for k in first)) if len(first) else [[]] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(offsets)[first], pa.int64()), *(pa.array(c, pa.binary()) for c in rows)], names)

    return source.mapInArrow(run, f"id binary, n long, {columns}").join(needed.select("id"), "id", "left_semi").dropDuplicates(["id"])


def full_sets(docs: DataFrame, doc_id: str, text: str, size: int, needed: DataFrame) -> DataFrame:
    """(id, n, grams): the packed sets."""
    return _sets_of(docs, doc_id, text, size, needed, "grams binary", lambda grams: (grams.tobytes(),))


def set_ends(docs: DataFrame, doc_id: str, text: str, size: int, needed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(id, n, low, high): the packed longer prefixes (``ends``)."""
    return _sets_of(docs, doc_id, text, size, needed, "low binary, high binary", lambda grams: [e.tobytes() for e in ends(grams, similarity)])


def ends(grams: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The longer prefixes of a sorted set under rising and falling hashes, both in rising order. Of each token its upper
    half: tokens that are equal stay so, and the order too."""
    n = len(grams)
    stop = min(n, n - _least(n, similarity) + 1 + LONGER * n // 100)
    upper = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    return upper(grams[:stop]), upper(grams[n - stop :])


def may_link(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, m: int, similarity: tuple[int, int]) -> bool:
    """Whether sets of n and m tokens share enough of their prefixes (``ends``) under the second and third order."""
    o = _overlap(n, m, similarity)
    if o > min(n, m):
        return False
    k = min(len(a[0]) - (n - o), len(b[0]) - (m - o), o)
    x, y = n - o + k, m - o + k
    return _shared(a[0][:x], b[0][:y]) >= k and _shared(a[1][len(a[1]) - x :], b[1][len(b[1]) - y :]) >= k


def _sides(pairs: DataFrame, facts: DataFrame, work: Workspace) -> DataFrame:
    """Pairs (a, b) with what ``facts`` (id, ...) says of both, names ending in _a and _b. Classes with very many pairs
    are copied, each copy for a share of the pairs, so that no task has all."""
    total = pairs.count()
    for side, other in ("ab", "ba"):
        named = facts.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in facts.columns])
        n = F.count(F.lit(1))
        heavy = pairs.groupBy(side).agg(n.alias("n")).where((F.col("n") * HEAVY > total) & (F.col("n") > SPREAD_ROWS))
        heavy = work.saved(heavy.select(side, F.ceil(F.col("n") / SPREAD_ROWS).cast("int").alias("shares")), "heavy")
        shares = F.coalesce("shares", F.lit(1))
        copied = named.join(F.broadcast(heavy), side, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
        dealt = pairs.join(F.broadcast(heavy), side, "left").withColumn("share", F.pmod(F.xxhash64(other), shares).cast("int")).drop("shares")
        pairs = dealt.join(copied, [side, "share"]).drop("share")
    return pairs


def _passing(pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of those pairs (a, b, n, low and high of both) that the filters let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            low_a, high_a, low_b, high_b = (batch[c] for c in ("low_a", "high_a", "low_b", "high_b"))
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = ([np.frombuffer(c[k].as_buffer(), np.uint32) for c in two] for two in ((low_a, high_a), (low_b, high_b)))
                good[k] = may_link(a, b, int(n[k]), int(m[k]), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good))
        co.release()

    return pairs.mapInArrow(run, "a binary, b binary")


def _grams(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint64)


def linked(p: np.ndarray, q: np.ndarray, similarity: tuple[int, int]) -> bool:
    shared = _shared(p, q)
    return similarity[1] * shared >= similarity[0] * (len(p) + len(q) - shared)


def _verified(pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of those pairs (a, b, grams of both) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(_grams(x), _grams(y), similarity) for x, y in zip(batch["grams_a"], batch["grams_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        co.release()

    return pairs.mapInArrow(run, "a binary, b binary")


def _across(blocks: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between different components of the blocks' members: as many as join all that are linked.

    A row holds two lists of members, or the same one twice. Members go by size; pairs whose components links found before
    have joined are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch[c][row].values for c in ("x", "y"))
                coded = pa.chunked_array([x.field("component"), y.field("component")]).combine_chunks().dictionary_encode()
                root = np.arange(len(coded.dictionary))  # kept flat: of each component its present one
                comp = np.split(coded.indices.to_numpy(zero_copy_only=False), [len(x)])
                ids = [s.field("id") for s in (x, y)]
                sets = [[_grams(g) for g in s.field("grams")] for s in (x, y)]
                cut = [[ends(g, similarity) for g in s] for s in sets]
                sizes = np.array([len(g) for g in sets[1]])
                links = []
                for i, p in enumerate(sets[0]):
                    n = len(p)
                    open_ = (root[comp[1]] != root[comp[0][i]]) & (np.minimum(n, sizes) >= _overlap(n, sizes, similarity))
                    for j in np.flatnonzero(open_):
                        mine, other = root[comp[0][i]], root[comp[1][j]]
                        if mine != other and may_link(cut[0][i], cut[1][j], n, int(sizes[j]), similarity) and linked(p, sets[1][j], similarity):
                            root[root == other] = mine
                            links.append((ids[0][i].as_py(), ids[1][j].as_py()))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])
        co.release()

    return blocks.mapInArrow(run, "a binary, b binary")


def met(open_: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """(x, y): the pairs of blocks of each bucket (key, id, component), also of a block with itself. Blocks have about
    BLOCK_ROWS members and BLOCK_BYTES; a bucket has as many as it needs. One side is shuffled once, by its own number."""
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    cells = work.saved(open_.join(sets.select("id", "n"), "id").groupBy("key").agg(n.alias("cells")), "cells")
    cell = F.pmod(F.xxhash64("id", "key"), F.col("cells")).cast("int")
    rows = open_.join(cells, "key").join(sets, "id").withColumn("cell", cell)
    blocks = work.saved(rows.groupBy("key", "cells", "cell").agg(F.collect_list(F.struct("id", "component", "grams")).alias("list")), "blocks")
    still = blocks.select("key", F.col("cell").alias("j"), F.col("list").alias("y"))
    sent = blocks.select("key", F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("j"), F.col("list").alias("x"))
    return sent.join(still, ["key", "j"]).select("x", "y")


def similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, buckets: int = hc.BUCKETS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``. ``similarity`` is a fraction above 0, up to 1."""
    with Workspace(docs.sparkSession) as work, batch_rows(docs.sparkSession, TEXT_ROWS):
        return saved(_decided(docs, doc_id, text, size, similarity, buckets, work), "similar")


def _decided(docs: DataFrame, doc_id: str, text: str, size: int, similarity: tuple[int, int], room: int, work: Workspace) -> DataFrame:
    spark = docs.sparkSession
    first = work.saved(signatures(docs, doc_id, text, size, room), "signatures")
    sig = work.saved(first.where("block is null").select("doc_id", "n", "id", "h"), "texts")
    classes = work.saved(sig.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("h").alias("h")), "classes")
    counts = spark.sparkContext.broadcast(hc.table(first.where("block is not null").select("block", "at", "counts"), LIMIT, room))
    work.drop("signatures")  # tables go as soon as nothing reads them any more
    banded = work.saved(prefixes(docs, doc_id, text, size, similarity, classes, counts, room), "prefixes")
    counts.destroy()
    # Each step is written, so that joins deal out both sides anew, and a full bucket may be split.
    shared = work.saved(banded.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("key"), "shared")
    full = work.saved(_in_buckets(banded, shared).distinct(), "full")
    work.drop("prefixes", "shared")
    met_ = work.saved(_one_of_each(full, "h").join(classes.select("h", "id", "n"), "h"), "met")
    work.drop("full")
    sized = work.saved(by_size(met_, similarity), "sized")
    work.drop("met")
    buckets = work.saved(sized.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").select("key", "hub"), "buckets")
    members = work.saved(_one_of_each(sized.join(buckets, "key"), "id"), "members")  # key, id, hub
    work.drop("sized", "buckets")

    pairs = work.saved(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    def of(ids: DataFrame) -> DataFrame:
        return work.saved(classes.select("id", "rep").join(ids.distinct(), "id"), "needed")

    both = F.explode(F.array("a", "b")).alias("id")
    cut = work.saved(set_ends(docs, doc_id, text, size, of(pairs.select(both)), similarity), "ends")
    close = work.saved(_passing(_sides(pairs, cut, work), similarity), "close")
    work.drop("pairs", "needed", "heavy")
    sets = work.saved(full_sets(docs, doc_id, text, size, of(close.select(both))), "sets")
    links = work.saved(_verified(_sides(close, sets.select("id", "grams"), work), similarity), "links")
    work.drop("close", "sets", "needed", "heavy")
    found = work.saved(labelled(links, work), "components")
    work.drop("edges", "hooks", "roots")

    # Buckets whose members, without the hub that all were compared with, are in several components.
    rest = members.where("id != hub").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")).distinct()
    split = work.saved(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"), "split")
    open_ = work.saved(rest.join(split, "key").select("key", "id", "component"), "open")
    work.drop("members", "split")
    if not open_.isEmpty():
        few = open_.groupBy("key").agg(F.count(F.lit(1)).alias("few")).where(F.col("few") <= FEW).select("key")
        one = open_.join(few, "key", "left_semi")
        two = one.select("key", F.col("id").alias("b"), F.col("component").alias("other"))
        pairs = one.join(two, "key").where("id < b and component != other").select(F.col("id").alias("a"), "b").distinct()
        close = work.saved(_passing(_sides(work.saved(pairs, "pairs"), cut, work), similarity), "close")
        work.drop("pairs", "heavy", "ends")
        large = work.saved(open_.join(few, "key", "left_anti"), "large")
        sets = work.saved(full_sets(docs, doc_id, text, size, of(close.select(both).union(large.select("id")))), "sets")
        more = work.saved(_verified(_sides(close, sets.select("id", "grams"), work), similarity), "more-links")
        if not large.isEmpty():
            with batch_rows(spark, 4):
                more = more.unionByName(work.saved(_across(met(large, sets, work), similarity), "more-links"))
        found = work.saved(labelled(links.unionByName(more), work), "components")
    parts = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    heads = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = parts.join(heads, "component").select("id", "component_id")
    rows = sig.join(named, "id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _in_buckets(banded: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows (key, h) whose key is among the shared ones; a Bloom filter lets most others go before they are shuffled."""
    bits = banded.sparkSession.sparkContext.broadcast(bloom.build(shared, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.maybe(bits.value, batch))).select(["key", "h"])

    return banded.select("key", "h", *bloom.hashes(F.col("key"))).mapInArrow(run, "key long, h long").join(shared, "key")


def _one_of_each(members: DataFrame, who: str) -> DataFrame:
    """Distinct members (key, who) of buckets, of buckets with the same ones only those of one. Buckets are told apart by
    their size and 128 bits of hashes."""
    hashes = [F.bit_xor(F.xxhash64(who, F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *hashes)
    return members.join(same.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
