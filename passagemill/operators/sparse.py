"""BM25: term counts, document lengths and idf are aggregates, queries an equi-join on terms.

The best documents of a query are found in blocks: the postings of each Arrow batch of documents are put together where it
is read, its scores for many queries are summed in one table, and the k best leave it. Queries of few terms are broadcast.
More are answered in passes of so many that a task can hold them: they go to all lanes, each block of documents goes to one
lane, and streams by the queries there. No posting and no score but the k best is shuffled or written for few queries, and
the documents' blocks once a pass for many.

Beyond DIRECT scores the MaxScore scheme does without scoring all that share a common word with a query, on joins.
Terms that few documents have name some good documents, whose full scores give a threshold. The terms that count least,
and together can't lift a document over it, bring in no documents of their own: only those that the other terms bring,
and that may still pass the threshold, are looked up in their postings. Results are those of scoring everything.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace, batch_bytes, saved
from . import blocks

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms (some 100 bytes each) are broadcast up to so many; more are joined as Spark sees fit.
BROADCAST_TERMS = 100_000
#: So many (query, term, document) triples are scored in blocks, without looking for thresholds, whose joins move far more
#: than they spare; the results are the same.
DIRECT = 10**15
#: Queries and documents in a block, at most; documents are numbered in 16 bits.
BLOCK_QUERIES, BLOCK_DOCS = 1024, 8192
#: Bytes of words in a block of documents, about, where many queries are asked.
BLOCK_BYTES = 16 << 20
#: Query terms of a pass (some 25 bytes each in every task), where they are too many to broadcast.
PASS_TERMS = 4_000_000
#: Numbers in a table of scores, about; terms that have a row of their own in a block's table, and numbers there, at most.
TABLE, OFTEN, ROWS = 1 << 18, 512, 1 << 22
#: Scores are ties if they agree to so many digits; what is surely below a threshold is so by more than that.
DIGITS, MARGIN = 6, 2e-6
_SPLIT = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　]+"


def _words(text: str) -> Column:
    """The tokens of a text, in order."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT), lambda t: t != "")


def _terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of every token: split at white space, case kept."""
    return rows.select(F.col(key), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT)).alias("term")).where("term != ''")


def postings(docs: DataFrame, key: str = "id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, term, tf) of documents of distinct keys, counted where they are read: nothing is shuffled."""
    kept = [key, *keep]
    rows = docs.select(*kept, _words(text).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                coded = batch["words"].flatten().dictionary_encode()
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False))
                place, tf = np.unique(doc * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
                doc, code = (pa.array(x) for x in np.divmod(place, max(len(coded.dictionary), 1)))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(doc) for c in kept), coded.dictionary.take(code), pa.array(tf, pa.int64())], [*kept, "term", "tf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(run, f"{schema}, term string, tf long")


def lengths(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, len): tokens of each document, those without any too."""
    return docs.select(F.col(key), F.size(_words(text)).cast("long").alias("len"))


def corpus(sizes: DataFrame) -> DataFrame:
    """One row (n, avglen)."""
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"))


def _raw(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, raw): idf before the floor."""
    return df.crossJoin(F.broadcast(totals.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))


def _floored(raw: DataFrame, mean: DataFrame) -> DataFrame:
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def idf(posted: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf is EPSILON times the mean over all terms, as it was before."""
    raw = _raw(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)
    return _floored(raw, raw.agg(F.avg("raw").alias("mean")))


def small(rows: DataFrame, n: int) -> DataFrame:
    """Rows that are broadcast, if they are so few."""
    return F.broadcast(rows) if n <= BROADCAST_TERMS else rows


def _asked(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    return _terms(queries.select(F.col(query_key), F.col(query_text)), query_key, query_text).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))


def _matched(terms: DataFrame, docs: DataFrame, key: str, text: str, index: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the terms the postings (key, term, tf, len); the mean of all terms' idf as it was; and the corpus' totals."""
    if index is not None:
        posted, sizes = index
        totals = corpus(sizes)
        matched, dfs = posted.join(terms, "term", "left_semi").join(sizes, key), posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        # Only tokens that some query has are grouped; every document's length goes with its tokens.
        rows = docs.select(F.col(key), _words(text).alias("w")).select(key, "w", F.size("w").cast("long").alias("len"))
        totals = corpus(rows)
        each = rows.select(key, "len", F.explode("w").alias("term"))
        matched = each.join(terms, "term", "left_semi").groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        dfs = rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return matched, _raw(dfs, totals).agg(F.avg("raw").alias("mean")), totals


def _weight(avglen) -> F.Column:
    """What one of a query's terms gives a document, without the term's own weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avglen))


def scores(queries: DataFrame, docs: DataFrame, *, query_key: str = "query_id", query_text: str = "text", key: str = "id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, key, score) of every document that shares a term with the query. ``index``: (postings, lengths) as saved.

    For few queries, or where all scores are wanted; ``search`` finds the best ones with less.
    """
    asked = _asked(queries, query_key, query_text)
    terms = asked.select("term").distinct()
    matched, mean, totals = _matched(terms, docs, key, text, index)
    weights = _floored(_raw(matched.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals), mean)
    hits = matched.join(asked.join(weights, "term"), "term").crossJoin(F.broadcast(totals))
    return hits.groupBy(query_key, key).agg(F.sum(F.col("times") * F.col("idf") * _weight(F.col("avglen"))).alias("score"))


def _parts(tf: np.ndarray, docs: np.ndarray, lens: np.ndarray, avglen: float) -> np.ndarray:
    """What one of a query's terms gives each posting's document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[docs] / avglen))


def _postings_of(words: pa.ListArray, tfs: np.ndarray | None, known: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, docs, tf) of some documents: the postings of each term lie together. ``tfs``: how often each word
    counts, if not as often as it is there. ``known``: the terms, if no others matter."""
    n = len(words)
    flat, doc = words.flatten(), np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    if known is None:
        coded = flat.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    else:
        terms, code = known, pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
        ok = code >= 0
        doc, code, tfs = doc[ok], code[ok], None if tfs is None else tfs[ok]
    place = code.astype(np.int64) * n + doc
    if tfs is None:
        place, tf = np.unique(place, return_counts=True)
    else:
        order = np.argsort(place)
        place, tf = place[order], tfs[order]
    code, doc = np.divmod(place, n)
    return terms, np.searchsorted(code, np.arange(len(terms) + 1)), doc, tf


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as it counts, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _slices(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbours whose costs come to some TABLE, or to one that is larger."""
    upto = np.cumsum(costs)
    edges = np.flatnonzero(np.diff((upto - costs) // TABLE)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(costs)])


def _in_turn(postings: tuple, codes: np.ndarray, weights: np.ndarray, n: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that may be one query's k best: each term's postings are added in turn."""
    starts, docs, parts = postings
    total, seen, plain = np.zeros(n), None, True
    if len(weights) and weights.min() <= 0:  # then a score of 0 or less may be one of the best
        seen, plain = np.zeros(n, bool), False
    for c, w in zip(codes.tolist(), weights.tolist()):
        if c >= 0:
            at = docs[starts[c] : starts[c + 1]]
            total[at] += w * parts[starts[c] : starts[c + 1]]
            if not plain:
                seen[at] = True
    at = np.flatnonzero(total > max(least - MARGIN, 0.0)) if plain else np.flatnonzero(seen & (total >= least - MARGIN))
    if len(at) > k:
        at = at[total[at] >= np.partition(total[at], len(at) - k)[len(at) - k] - MARGIN]
    return at, total[at]


def _indexed(starts: np.ndarray, docs: np.ndarray, parts: np.ndarray, n: int) -> tuple:
    """Postings of n documents for ``_best_of``: (starts, docs, parts), terms' numbers of documents, their rows in a table of
    the frequent ones, which follows, and the postings' places in the order of term and document."""
    df = np.diff(starts)
    often = np.flatnonzero(df > n // 8)
    often = often[np.argsort(-df[often], kind="stable")[: min(OFTEN, ROWS // max(n, 1))]]
    row_of = np.full(len(df), -1)
    row_of[often] = np.arange(len(often))
    table, of = np.zeros((len(often), n)), _spans(starts[often], df[often])
    table[np.repeat(np.arange(len(often)), df[often]), docs[of]] = parts[of]
    return (starts, docs, parts), df, row_of, table, np.repeat(np.arange(len(df)), df) * n + docs


def _best_of(postings: tuple, asked: tuple[np.ndarray, np.ndarray, np.ndarray], places: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents of a block for each query, without those that k better ones are
    known for already: ``least`` has the k-th best score so far. ``postings``: as ``_indexed``; ``asked``: (starts,
    terms, weights), a negative term is in no document; ``places``: the order of the documents' keys.

    Scores of many queries are summed in a table, frequent terms by a product of matrices. Who may be one of the best there
    is then scored again with its terms in their order, so that a score never depends on which others are asked for."""
    plainly, df, row_of, table, place = postings
    starts, docs, parts = plainly
    first, codes, weights = asked
    codes = codes.astype(np.int64)  # places pass 32 bits
    n, lengths = len(places), np.diff(first)
    if len(docs) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query = np.repeat(np.arange(len(lengths)), lengths)
    plain = np.bincount(query[weights <= 0], minlength=len(lengths)) == 0
    rare = (codes >= 0) & (row_of[codes] < 0)
    costs = n + np.bincount(query[rare], df[codes[rare]], minlength=len(lengths)).astype(np.int64)
    found = []
    for lo, hi in _slices(costs):
        some = np.arange(first[lo], first[hi])[codes[first[lo] : first[hi]] >= 0]
        q, c, w = query[some] - lo, codes[some], weights[some]
        dense = row_of[c] >= 0
        wanted = np.zeros((hi - lo, len(table)))
        wanted[q[dense], row_of[c[dense]]] = w[dense]
        q, c, w = q[~dense], c[~dense], w[~dense]
        of = _spans(starts[c], df[c])
        sums = wanted @ table
        sums += np.bincount(np.repeat(q * n, df[c]) + docs[of], np.repeat(w, df[c]) * parts[of], minlength=sums.size).reshape(sums.shape)
        bars = np.where(plain[lo:hi], np.maximum(least[lo:hi] - MARGIN, 0.0), np.inf)
        above = sums > bars[:, None]
        many = np.flatnonzero(above.sum(1) > k)
        if len(many):
            kth = np.partition(sums[many], n - k, axis=1)[:, n - k]
            above[many] &= sums[many] >= kth[:, None] - MARGIN
        # Many copies of a document are ties, which are sooner scored all at once.
        alone = ~plain[lo:hi] | (above.sum(1) > 4 * k + 64)
        above[alone] = False
        i, j = np.nonzero(above)
        score = np.zeros(len(i))
        for a, b in _slices(lengths[lo + i]) if len(i) else ():
            terms = lengths[lo + i[a:b]]
            of, pair = _spans(first[lo + i[a:b]], terms), np.repeat(np.arange(b - a), terms)
            wanted_at = codes[of] * n + j[a:b][pair]
            at = np.minimum(np.searchsorted(place, wanted_at), len(place) - 1)
            score[a:b] = np.bincount(pair, np.where(place[at] == wanted_at, weights[of] * parts[at], 0.0), minlength=b - a)
        found.append((lo + i, j, score))
        for x in (lo + np.flatnonzero(alone)).tolist():
            at, score = _in_turn(plainly, codes[first[x] : first[x + 1]], weights[first[x] : first[x + 1]], n, k, least[x])
            found.append((np.full(len(at), x), at, score))
    i, j, score = (np.concatenate(x) for x in zip(*found))
    score = np.round(score, DIGITS)
    kept = _firsts(i, score, places[j], k, least)
    return i[kept], j[kept], score[kept]


def _firsts(query: np.ndarray, score: np.ndarray, places: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Which are the k best of each query, in order; the bar of a query that has as many is raised."""
    order = np.lexsort((places, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], np.arange(len(least)))[query[order]]
    last = order[place == k - 1]
    least[query[last]] = np.maximum(least[query[last]], score[last])
    return order[place < k]


def _in_blocks(questions: DataFrame, n_terms: int, rows: DataFrame, avglen: float, k: int, q: str, key: str) -> DataFrame:
    """(query, key, score): the k best documents of each block for each query. Questions: the query, ``terms`` and their
    ``weights``. Rows: the key, ``words``, ``len``, and ``tfs`` where words are not repeated."""
    spark = rows.sparkSession
    counted, size_d, size_q = "tfs" in rows.columns, BLOCK_DOCS, BLOCK_QUERIES
    key_type, q_type = rows.schema[key].dataType.simpleString(), questions.schema[q].dataType.simpleString()
    schema = f"`{q}` {q_type}, `{key}` {key_type}, score double"

    def slices(batches: Iterator[pa.RecordBatch], known: pa.Array | None) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
        for big in batches:
            for lo in range(0, big.num_rows, size_d):
                batch = big.slice(lo, size_d)
                tfs = batch["tfs"].flatten().to_numpy() if counted else None
                yield batch[key], batch["len"].to_numpy(), _postings_of(batch["words"], tfs, known)

    def starts_of(lists: pa.ListArray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])

    def said(found: tuple, asked: pa.Array, keys: pa.Array) -> pa.RecordBatch:
        i, j, score = found
        return pa.RecordBatch.from_arrays([asked.take(pa.array(i)), keys.take(pa.array(j)), pa.array(score)], [q, key, "score"])

    if n_terms <= BROADCAST_TERMS:
        table = questions.toArrow().combine_chunks()
        if not table.num_rows:
            return spark.createDataFrame([], schema)
        lists, whole = (table[c].chunk(0) for c in ("terms", "weights"))
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        shared = spark.sparkContext.broadcast((table[q].chunk(0), coded.dictionary, (starts_of(lists), coded.indices.to_numpy(), whole.flatten().to_numpy())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known, asked = shared.value
            least = np.full(len(names), -np.inf)
            for keys, lens, (_, starts, docs, tf) in slices(batches, known):
                postings = _indexed(starts, docs, _parts(tf, docs, lens, avglen), len(keys))
                yield said(_best_of(postings, asked, blocks.ranks(keys), k, least), names, keys)

        return rows.mapInArrow(run, schema)

    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    numbers = lambda batch, c, row, kind: np.frombuffer(batch[c][row].as_buffer(), kind)
    sent = ["terms", "ends", "starts", "at", "numbers"]

    def as_bytes(terms: pa.StringArray) -> tuple[pa.Array, pa.Array]:
        ends, data = pa.concat_arrays([terms]).cast(pa.string()).buffers()[1:]
        ends = np.frombuffer(ends, np.int32)[: len(terms) + 1] if len(terms) else np.zeros(1, np.int32)
        return pa.array([b"" if data is None else data.to_pybytes()[: ends[-1]]], pa.binary()), raw(ends, np.int32)

    def doc_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lens, (terms, starts, docs, tf) in slices(batches, None):
            yield pa.RecordBatch.from_arrays([one(keys), *as_bytes(terms), raw(starts, np.int32), raw(docs, np.uint16), raw(tf, np.int32), raw(lens, np.int64)], ["ids", *sent, "lens"])

    def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, size_q):
                batch = big.slice(lo, size_q)
                coded = batch["terms"].flatten().dictionary_encode()
                yield pa.RecordBatch.from_arrays([one(batch[q]), *as_bytes(coded.dictionary), raw(starts_of(batch["terms"]), np.int32), raw(coded.indices.to_numpy(), np.int32), raw(batch["weights"].flatten().to_numpy(), np.float64)], ["asked", *sent])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries come first and are held; of each the k best so far are, too."""
        words, held, best = [], [], []
        for batch in batches:
            for row in range(batch.num_rows):
                ends = numbers(batch, "ends", row, np.int32)
                terms = pa.StringArray.from_buffers(len(ends) - 1, batch["ends"][row].as_buffer(), batch["terms"][row].as_buffer())
                starts, at = numbers(batch, "starts", row, np.int32), batch["at"][row].as_buffer()
                if not batch["ids"][row].is_valid:
                    words.append(terms)
                    asked = pa.concat_arrays([batch["asked"][row].values])
                    held.append((asked, starts.copy(), np.frombuffer(at, np.int32), numbers(batch, "numbers", row, np.float64).copy()))  # not the whole batch
                    continue
                if not held:
                    return
                if not best:
                    coded = pa.concat_arrays(words).dictionary_encode()
                    known, upto = coded.dictionary, np.cumsum([0, *map(len, words)])
                    held = [(asked, first, coded.indices[lo:hi].to_numpy().take(codes), weights) for (asked, first, codes, weights), lo, hi in zip(held, upto, upto[1:])]
                    best = [(np.full(len(asked), -np.inf), np.zeros(0, np.int64), None, np.zeros(0)) for asked, *_ in held]
                    words = coded = None
                keys, lens, docs = batch["ids"][row].values, numbers(batch, "lens", row, np.int64), np.frombuffer(at, np.uint16).astype(np.int64)
                postings = _indexed(starts.astype(np.int64), docs, _parts(numbers(batch, "numbers", row, np.int32), docs, lens, avglen), len(keys))
                places, code = blocks.ranks(keys), pc.fill_null(pc.index_in(known, value_set=terms), -1).to_numpy(zero_copy_only=False)
                for b, (_, first, codes, weights) in enumerate(held):
                    least, i, names, score = best[b]
                    query, doc, more = _best_of(postings, (first, code[codes], weights), places, k, least)
                    if len(query):
                        i, score, new = np.concatenate([i, query]), np.concatenate([score, more]), keys.take(pa.array(doc))
                        names = new if names is None else pa.concat_arrays([names, new])
                        kept = _firsts(i, score, blocks.ranks(names), k, least)
                        best[b] = least, i[kept], names.take(pa.array(kept)), score[kept]
        for (asked, *_), (_, i, names, score) in zip(held, best):
            if names is not None:
                yield said((i, np.arange(len(i)), score), asked, names)

    # Queries go to all lanes, so that these are as many as can be at work, and no more with more input.
    lanes = 2 * spark.sparkContext.defaultParallelism
    docs = rows.mapInArrow(doc_blocks, f"ids array<{key_type}>, {', '.join(f'{c} binary' for c in sent)}, lens binary")
    docs = docs.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    asked = questions.mapInArrow(query_blocks, f"asked array<{q_type}>, {', '.join(f'{c} binary' for c in sent)}")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = asked.unionByName(docs, allowMissingColumns=True).repartitionById(lanes, "lane")
    return both.sortWithinPartitions(F.col("ids").isNotNull()).mapInArrow(meet, schema)


def search(queries: DataFrame, docs: DataFrame, k: int, *, query_key: str = "query_id", query_text: str = "text", key: str = "id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, key, score, rank) of the k best documents of each query, as ``top`` of ``scores``. ``index``: (postings,
    lengths) as saved; without, the texts are read twice."""
    q = query_key
    with Workspace(queries.sparkSession) as work:
        asked = work.saved(_asked(queries, q, query_text), "asked")
        n_terms = asked.count()
        if index is None:
            rows = docs.select(F.col(key), _words(text).alias("words")).withColumn("len", F.size("words").cast("long"))
            # The row without a term counts documents, and their words.
            each = rows.select("len", F.explode(F.array_append(F.array_distinct("words"), F.lit(None).cast("string"))).alias("term"))
            counts = work.saved(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("words")), "counts")
            totals = counts.where("term is null").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avglen"))
            dfs = counts.where("term is not null").select("term", "df")
        else:
            totals = corpus(index[1])
            dfs = work.saved(index[0].groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")
        raw = _raw(dfs, totals)
        weights = _floored(raw, raw.agg(F.avg("raw").alias("mean")))
        terms = work.saved(small(asked, n_terms).join(weights, "term").select(q, "term", "df", (F.col("times") * F.col("idf")).alias("weight")), "weights")
        if (terms.agg(F.sum("df")).first()[0] or 0) > DIRECT:
            return _pruned(work, asked, n_terms, docs, k, q, key, text, index)
        at = F.array_sort(F.collect_list(F.struct("term", "weight")))
        questions = work.saved(terms.groupBy(q).agg(at.alias("t")).select(q, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "questions")
        if index is not None:
            mine = index[0].join(small(asked.select("term").distinct(), n_terms), "term", "left_semi").groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("p"))
            rows = mine.join(index[1], key).select(key, F.col("p.term").alias("words"), F.col("p.tf").alias("tfs"), "len")
        first = totals.first()
        avglen = first["avglen"] if first is not None else None
        passes = 1 if n_terms <= BROADCAST_TERMS else -(-n_terms // PASS_TERMS)
        found = []
        with batch_bytes(queries.sparkSession, *([] if n_terms <= BROADCAST_TERMS else [BLOCK_BYTES])):
            for x in range(passes):
                some = questions if passes == 1 else questions.where(F.pmod(F.xxhash64(q), F.lit(passes)) == x)
                found.append(saved(top(_in_blocks(some, n_terms, rows, avglen or 1.0, k, q, key), k, q, key), "bm25"))
        return functools.reduce(DataFrame.unionByName, found)


def _pruned(work: Workspace, asked: DataFrame, n_terms: int, docs: DataFrame, k: int, q: str, key: str, text: str, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """As ``search``, by MaxScore."""
    if index is None:  # one pass over the texts
        index = work.saved(postings(docs, key, text), "postings"), work.saved(lengths(docs, key, text), "lengths")
    matched, mean, totals = _matched(small(asked.select("term").distinct(), n_terms), docs, key, text, index)
    avglen = totals.first()["avglen"] or 1.0
    posted = work.saved(matched.select("term", key, _weight(F.lit(avglen)).alias("part")), "matched")
    stats = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    weights = _floored(_raw(stats, totals), mean)
    weighed = asked.join(weights, "term").join(stats.select("term", "most"), "term").withColumn("weight", F.col("times") * F.col("idf"))
    terms = work.saved(weighed.select(q, "term", "df", "weight", F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)).alias("bound")), "terms")

    def scored(some: DataFrame) -> DataFrame:
        return posted.join(small(some.select(q, "term", "weight"), n_terms), "term").groupBy(q, key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))

    def looked_up(found: DataFrame, some: DataFrame) -> DataFrame:
        """What these terms give documents (query, key) that are known by name."""
        wanted = found.select(q, key).join(small(some.select(q, "term", "weight"), n_terms), q)
        return posted.join(wanted, ["term", key]).groupBy(q, key).agg(F.sum(F.col("weight") * F.col("part")).alias("more"))

    # The rarest terms, up to the first one that k documents have.
    enough = F.sum((F.col("df") >= k).cast("int")).over(Window.partitionBy(q).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    rare = terms.withColumn("enough", enough).where("coalesce(enough, 0) = 0").drop("enough")
    best = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("score"), key))
    some = work.saved(scored(rare).withColumn("r", best).where(F.col("r") <= k).select(q, key), "some")
    full = looked_up(some, terms)
    worst = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("more"), key))
    bar = full.withColumn("r", worst).where(F.col("r") == k).select(q, F.col("more").alias("bar"))
    upto = F.sum("bound").over(Window.partitionBy(q).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = terms.join(bar, q, "left").withColumn("upto", upto).withColumn("minor", F.coalesce(F.col("upto") < F.col("bar") - MARGIN, F.lit(False)))
    split = work.saved(split.select(q, "term", "weight", "bound", "bar", "minor"), "split")
    rest = split.where("minor").groupBy(q).agg(F.sum("bound").alias("rest"), F.first("bar").alias("bar"))
    brought = scored(split.where("not minor")).join(rest, q, "left").where(F.coalesce(F.col("score") + F.col("rest") >= F.col("bar") - MARGIN, F.lit(True)))
    brought = work.saved(brought.select(q, key, "score"), "brought")
    more = looked_up(brought.join(rest, q, "left_semi"), split.where("minor"))
    whole = brought.join(more, [q, key], "left").select(q, key, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return saved(top(whole, k, q, key), "bm25")


def top(scored: DataFrame, k: int, query_key: str = "query_id", key: str = "id", digits: int = DIGITS) -> DataFrame:
    """(query, key, score, rank) of the k best per query; scores that agree to so many digits are ties, broken by key."""
    said = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return said.withColumn("rank", rank).where(F.col("rank") <= k)
