"""A versioned passage store on Parquet.

A collection is a list of parts, named by a pointer file: a base, and what was written since, newest last. A part holds
rows, the ids that it replaces or deletes, and indexes of its rows: postings and lengths for sparse search, cells for
dense search. So each write costs what it writes: rows of older parts count unless a newer part names their id. When the newer parts hold a share of the rows, or
are many, they are merged into a new base. A new pointer takes the old one's name, so a reader never sees half a version,
and plans that are resolved already keep the parts they read: those that only older versions name are deleted after
``keep_versions`` further ones.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..config import StoreConfig
from ..workspace import batch_bytes, shuffles_deleted
from . import cells, sparse

# Names of distances.
DISTANCES = {"cos": "cosine", "cosine": "cosine", "dot": "dot", "ip": "dot", "inner": "dot", "inner_product": "dot", "l2": "l2", "euclid": "l2", "euclidean": "l2"}


#: Sketches of distinct keys have 2 to this power registers.
SKETCH_BITS = 14


#: Bytes of written rows that one task sorts, about.
RANGE_BYTES = 64 << 20


class StoreError(RuntimeError):
    """A write or a query that the store's settings rule out."""


def to_distance(name: str) -> str:
    try:
        return DISTANCES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}") from None


def equality(filters: dict[str, object] | None) -> Column | None:
    """The conjunction of null-safe equalities; None for no filters."""
    if not filters:
        return None
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()])


def filtered(rows: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    test = equality(filters)
    return rows if test is None else rows.where(test)


def last_of_each(rows: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The row of the highest order for each key; of equal ones always the same, by a hash of the whole row."""
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, MapType)])
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "hash_"))
    # Hashed before rows are dealt out, so that columns which nobody reads afterwards are left behind.
    return rows.withColumn("hash_", hashed).withColumn("place_", place).where("place_ = 1").drop("place_", "hash_")


def upserted(existing: DataFrame | None, new: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The rows with those of ``new`` in place of theirs; within ``new`` the last one wins."""
    last = last_of_each(new, key, order)
    return last if existing is None else existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def without_matches(rows: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """No filter deletes nothing."""
    test = equality(filters)
    return rows if test is None else rows.where(~F.coalesce(test, F.lit(False)))


def count_sketch(key: Column) -> Column:
    """An aggregate: a sketch of the distinct keys, which merges with others. Its error is about 1 %."""
    return F.hll_sketch_agg(key, SKETCH_BITS)


def sketched_count(sketches: Column | str) -> Column:
    """An aggregate: about how many distinct keys the sketches hold together."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketches))


class PassageStore:
    """Named collections of passages below a path that all executors share."""

    def __init__(self, spark: SparkSession, config: StoreConfig | None = None) -> None:
        self.spark, self.config = spark, config or StoreConfig()
        self.distance = to_distance(self.config.distance)
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.config.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.config.path, *names]))

    def _read_text(self, path) -> str | None:
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path, text: str) -> None:
        """All of the text or none of it: a new file takes the old one's name."""
        made = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(made, True)
        stream.write(text.encode())
        stream.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        context.rename(context.makeQualified(made), context.makeQualified(path), overwrite)

    def resolve(self, name: str | None = None) -> str:
        """The collection that an alias names; a name that is no alias stands for itself."""
        name = name or self.config.alias
        return self._read_text(self._path("aliases", name)) or name

    def ensure(self, collection: str | None = None) -> None:
        """Make a collection, with the store's dimension and distance, unless it is there."""
        manifest = self._path(self.resolve(collection), "manifest.json")
        if not self._fs.exists(manifest):
            self._write_text(manifest, json.dumps({"dim": self.config.dim, "distance": self.distance}))

    def promote(self, collection: str) -> None:
        """Let the alias name another collection."""
        if not self._fs.exists(self._path(collection, "manifest.json")):
            raise StoreError(f"no collection {collection!r}")
        self._write_text(self._path("aliases", self.config.alias), collection)

    def _parts(self, name: str) -> list[dict]:
        said = self._read_text(self._path(name, "current"))
        return [] if said is None else json.loads(said)["parts"]

    def _table(self, name: str, part: dict, what: str) -> DataFrame:
        return self.spark.read.parquet(str(self._path(name, part["path"], what)))

    def _merged(self, name: str, parts: list[dict], what: str) -> DataFrame | None:
        """Of each part the rows (or postings, or lengths) whose id no newer part names."""
        out, named = None, None
        for part in reversed(parts):
            rows = self._table(name, part, what)
            if named is not None:
                rows = rows.join(named, "id", "left_anti")
            out = rows if out is None else rows.unionByName(out, allowMissingColumns=True)
            ids = self._table(name, part, "ids")
            named = ids if named is None else named.unionByName(ids).distinct()
        return out

    def rows(self, collection: str | None = None) -> DataFrame | None:
        """The current version's rows; None while there is none."""
        name = self.resolve(collection)
        return self._merged(name, self._parts(name), "rows")

    def index(self, collection: str | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(postings, lengths) of the current version's rows, for sparse search; None while there is none."""
        name = self.resolve(collection)
        parts = self._parts(name)
        return (self._merged(name, parts, "postings"), self._merged(name, parts, "lengths")) if parts else None

    def nearest(self, queries: DataFrame, k: int, collection: str | None = None, *, query_key: str = "query_id", vector: str = "vector", digits: int = 6) -> DataFrame | None:
        """(query, id, score, rank): the k most similar rows of the current version, from the parts' cells; the same as
        ``dense.top`` over all rows. None while there is no version."""
        name = self.resolve(collection)
        found, named = [], None
        for part in reversed(self._parts(name)):
            if part["rows"]:
                found.append(cells.Cells(self.spark, str(self._path(name, part["path"], "cells")), self.distance, named))
            ids = self._table(name, part, "ids")
            named = ids if named is None else named.unionByName(ids).distinct()
        return cells.search(found, queries, k, query_key=query_key, vector=vector, digits=digits) if found else None

    def _index(self, name: str, path: str) -> None:
        """Postings, lengths and cells of a part's rows."""
        rows = self._table(name, {"path": path}, "rows")
        at = lambda what: str(self._path(name, path, what))
        with batch_bytes(self.spark):  # rows are lists of a text's words
            sparse.postings(rows).write.parquet(at("postings"))
        sparse.lengths(rows).write.parquet(at("lengths"))
        cells.build(rows, at("cells"), dim=self.config.dim, kind=self.distance)

    def _write_rows(self, rows: DataFrame, path: str, tasks: int | None = None) -> None:
        """Rows by ranges of the columns to sort by and of id, so that one value's rows may take many files, each file
        sorted: row groups then have narrow bounds, which filters are held against before anything is read. ``tasks``: ranges
        at least, so that what one task sorts doesn't follow the input."""
        by = [*self.config.sort_by, "id"]
        laid = rows if not self.config.sort_by else (rows.repartitionByRange(*by) if tasks is None else rows.repartitionByRange(tasks, *by)).sortWithinPartitions(*by)
        out = laid.write.option("parquet.block.size", self.config.row_group_bytes)
        for column in self.config.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.parquet(path)

    def _write_last(self, rows: DataFrame, path: str) -> None:
        """The last row of each id. Rows are written as they come, and looked up for ids that are there several times: where
        there are none, no text is shuffled; else only rows of those ids are put in order."""
        given = f"{path}-given"
        with shuffles_deleted(self.spark):
            rows.write.parquet(given)
        made = self.spark.read.schema(rows.schema).parquet(given)
        at, kept = (self._jvm.org.apache.hadoop.fs.Path(x) for x in (given, path))
        again = made.groupBy("id").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("id")
        again.write.parquet(f"{path}-again")
        again = self.spark.read.schema(again.schema).parquet(f"{path}-again")
        several = not again.isEmpty()
        if not several and not (self.config.sort_by or self.config.bloom):
            self._fs.rename(at, kept)
        else:
            one = made
            if several:
                named = made.where("id is not null")
                one = named.join(again, "id", "left_anti").unionByName(last_of_each(named.join(again, "id", "left_semi")))
                one = one.unionByName(last_of_each(made.where("id is null")))
            tasks = self._fs.getContentSummary(at).getLength() // RANGE_BYTES + 1
            default = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            with shuffles_deleted(self.spark):
                self._write_rows(one, path, max(tasks, default) if tasks > default else None)
            self._fs.delete(at, True)
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{path}-again"), True)

    def _write(self, name: str, rows: DataFrame, ids: DataFrame | None) -> dict:
        """A new part of rows, of each id the last one; ``ids`` are those it names besides."""
        path = f"p{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        at = lambda what: str(self._path(name, path, what))
        self._write_last(rows, at("rows"))
        made = self.spark.read.schema(rows.schema).parquet(at("rows"))
        named = made.select("id") if ids is None else made.select("id").unionByName(ids.select(F.col("id").cast(made.schema["id"].dataType))).distinct()
        named.write.parquet(at("ids"))
        self._index(name, path)
        return {"path": path, "rows": made.count(), "ids": self.spark.read.parquet(at("ids")).count()}

    def _checked(self, name: str, rows: DataFrame, ids: DataFrame | None) -> dict | None:
        """As ``_write``; None, and nothing is left, if there is nothing to write, and an error if vectors have a wrong
        dimension."""
        part = self._write(name, rows, ids)
        wrong = self._table(name, part, "rows").where(F.size("vector") != self.config.dim).count()
        if wrong or not part["ids"]:
            self._fs.delete(self._path(name, part["path"]), True)
        if wrong:
            raise StoreError(f"{wrong} vectors are not of dimension {self.config.dim}")
        return part if part["ids"] else None

    def _commit(self, name: str, parts: list[dict]) -> None:
        """Name the parts, merged if the newer ones have grown, and delete what no version in keeping names."""
        newer = sum(p["ids"] for p in parts[1:])
        if len(parts) > self.config.max_parts or newer > self.config.merge_share * max(parts[0]["rows"], 1) and len(parts) > 1:
            path = f"p{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            self._write_rows(self._merged(name, parts, "rows"), str(self._path(name, path, "rows")))
            self._index(name, path)
            ids = self._table(name, {"path": path}, "rows").select("id")
            ids.write.parquet(str(self._path(name, path, "ids")))
            n = self._table(name, {"path": path}, "ids").count()
            parts = [{"path": path, "rows": n, "ids": n}]
        said = self._read_text(self._path(name, "current"))
        before = [] if said is None else [[p["path"] for p in json.loads(said)["parts"]], *json.loads(said)["before"]]
        kept, gone = before[: self.config.keep_versions], before[self.config.keep_versions :]
        self._write_text(self._path(name, "current"), json.dumps({"parts": parts, "before": kept}))
        named = {p["path"] for p in parts}.union(*kept)
        for path in {p for version in gone for p in version} - named:
            self._fs.delete(self._path(name, path), True)

    def upsert(self, rows: DataFrame, collection: str | None = None) -> int:
        """Add rows (id, text, vector, ingest_seq and metadata), replacing those of equal ids; how many were given.

        Vectors may be null; those of rows that win must have the store's dimension, or nothing is added.
        """
        self.ensure(collection)
        name = self.resolve(collection)
        given = Observation()
        part = self._checked(name, rows.observe(given, F.count(F.lit(1)).alias("n")), None)
        if part is None:
            return 0
        self._commit(name, [*self._parts(name), part])
        return given.get["n"]

    def exchange(self, rows: DataFrame, gone: DataFrame, collection: str | None = None) -> dict[str, int]:
        """Add rows and delete ids in one version, so that no reader sees the one without the other; rows that are added
        stay, whether or not their ids are among those deleted. How many rows and ids were written."""
        self.ensure(collection)
        name = self.resolve(collection)
        part = self._checked(name, rows, gone)
        if part is None:
            return {"rows": 0, "ids": 0}
        self._commit(name, [*self._parts(name), part])
        return {"rows": part["rows"], "ids": part["ids"]}

    def delete_ids(self, ids: DataFrame, collection: str | None = None) -> int:
        """Delete rows by id; how many ids were asked for."""
        name = self.resolve(collection)
        if (rows := self.rows(name)) is not None:
            self._commit(name, [*self._parts(name), self._write(name, rows.limit(0), ids)])
        return ids.count()

    def delete_matches(self, filters: dict[str, object] | None, collection: str | None = None) -> int:
        """Delete the rows that match; how many did."""
        name = self.resolve(collection)
        if not filters or (rows := self.rows(name)) is None:
            return 0
        part = self._write(name, rows.limit(0), filtered(rows, filters).select("id"))
        if part["ids"]:
            self._commit(name, [*self._parts(name), part])
        return part["ids"]

    def load(self, collection: str | None = None) -> bool:
        """Whether there is such a collection; nothing else must be loaded."""
        return self._fs.exists(self._path(self.resolve(collection), "manifest.json"))

    def save(self) -> None:
        """Every write is saved when it returns."""

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> PassageStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def count(self, filters: dict[str, object] | None = None, collection: str | None = None) -> int:
        rows = self.rows(collection)
        return 0 if rows is None else filtered(rows, filters).count()

    def rebuild(self, rows: DataFrame, collection: str | None = None, *, force: bool = False) -> str:
        """Write rows to a fresh collection, then let the alias name it; an empty one only if forced."""
        name = collection or f"{self.config.alias}_{int(time.time())}_{uuid.uuid4().hex[:6]}"
        if not self.upsert(rows, name) and not force:
            raise StoreError("nothing to promote")
        self.promote(name)
        return name
