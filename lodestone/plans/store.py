"""An index as snapshots: every change writes new parts and then moves one pointer, so readers see all of it or none.

Tables are cut into buckets by a hash of the path, as many as their bytes ask for (BUCKET_BYTES). A change rewrites the buckets of the paths that it touches; a version
is a list of where its buckets stand, so the others stay where they are.
"""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_type
from ..operators import parse_code, postings, textindex
from ..sources.files import Folder
from ..sources.repo import existing, metadata, read_files, read_paths

#: Bytes of files in a bucket, about; times that at which a store is cut anew; buckets of small stores, and of older ones.
BUCKET_BYTES, GROWN, LEAST_BUCKETS = 64 << 20, 4, 64
#: The index's tables.
BLOCKS = "path string, first_line int, text string, shard int, number int"
INDEX = {"blocks": BLOCKS, "grams": postings.LISTS}
#: Ranges of paths below a bucket that are compared by themselves.
SLICES = 256
TABLES = {
    "files": "path string, language string, source_type string, hash string, size_bytes bigint, line_count bigint, indexed_at timestamp, content string",
    "symbols": "path string, ordinal int, name string, kind string, signature string, start_line int, end_line int, exported int, async int, parent_class string, source_type string",
    "imports": "path string, ordinal int, source string, identifiers array<string>, line int",
    "tags": "path string, symbol_ordinal int, symbol_name string, tag string",
}


def changes(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): add, change or unlink, by path and hash; equal files do not appear."""
    d, s = disk.select("path", F.col("hash").alias("new")), stored.select("path", F.col("hash").alias("old"))
    kind = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "unlink").when(F.col("old") != F.col("new"), "change")
    return d.join(s, "path", "full").select("path", kind.alias("change")).where("change is not null")


def digests(files: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, n, x, s) of files (path, hash): for each range of paths, numbers that are equal if its rows are."""
    at = F.xxhash64("path")
    rows = files.select(F.pmod(at, F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.shiftright(at, 32), F.lit(SLICES)).cast("int").alias("slice"), F.xxhash64("path", "hash").alias("h"))
    return rows.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, slice) that two tables of digests do not agree on: buckets first, then the ranges of those."""

    def unequal(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        y = y.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "x", "s")])
        both = x.join(y, keys, "full")
        return both.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("x").eqNullSafe(F.col("_x")) & F.col("s").eqNullSafe(F.col("_s")))).select(*keys)

    whole = lambda t: t.groupBy("bucket").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    some = unequal(whole(a), whole(b), ["bucket"])
    return unequal(a.join(some, "bucket", "left_semi"), b.join(some, "bucket", "left_semi"), ["bucket", "slice"])


def changes_by_digest(disk: DataFrame, stored: DataFrame, buckets: int = LEAST_BUCKETS, known: DataFrame | None = None) -> DataFrame:
    """As ``changes``, joining only rows in ranges of paths whose digests differ; known: the digests of stored, if kept."""
    some = differing(digests(disk, buckets), digests(stored, buckets) if known is None else known)
    at = F.xxhash64("path")
    cut = lambda t: t.select("path", "hash", F.pmod(at, F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.shiftright(at, 32), F.lit(SLICES)).cast("int").alias("slice")).join(some, ["bucket", "slice"], "left_semi")
    return changes(cut(disk), cut(stored))


def stale(disk: DataFrame, stored: DataFrame, step: int = 1, slack: float = 2.0) -> DataFrame:
    """(stale, sampled) of a sample of one path in ``step`` by its hash: changed more than slack seconds after its indexing."""
    both = disk.join(stored, "path").where(F.pmod(F.xxhash64("path"), F.lit(step)) == 0)
    return both.agg(F.count_if(F.col("mtime") > F.unix_timestamp("indexed_at") + slack).alias("stale"), F.count(F.lit(1)).alias("sampled"))


def migrated(table: DataFrame, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """table in a schema: columns that an older one lacks get their default, or null; others are left out."""
    have, out = set(table.columns), []
    for column in schema.split(", "):
        name, kind = column.split(" ", 1)
        value = F.col(name) if name in have else (defaults or {}).get(name, F.lit(None))
        out.append(value.cast(kind).alias(name))
    return table.select(*out)


def fresh(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of files (path, content or hash) that are not stored with the same hash."""
    hashed = files if "hash" in files.columns else files.withColumn("hash", F.md5("content"))
    return hashed.join(stored.select("path", "hash"), ["path", "hash"], "left_anti").select(*files.columns)


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """A child table without the rows of paths in gone, and with the new ones."""
    return old.join(gone.select("path"), "path", "left_anti").unionByName(new)


def build(files: DataFrame, custom: list[tuple[str, str]] = (), indexed_at: str | None = None) -> dict[str, DataFrame]:
    """All tables of files (path, content)."""
    symbols, imports, tags = parse_code.parse_tagged(files, custom)
    return {
        "files": metadata(files, indexed_at).join(files.select("path", "content"), "path"),
        "symbols": symbols.withColumn("source_type", source_type(F.col("path"))),
        "imports": imports,
        "tags": tags,
    }


class Snapshots:
    """Versions below root; CURRENT names the one to read, a list of its tables' buckets."""

    def __init__(self, spark: SparkSession, root: str, indexed: bool = False):
        """indexed: blocks of lines and their gram postings are written with each version, of the buckets that change."""
        self.spark, self.root, self.folder, self.indexed = spark, root, Folder(spark, root), indexed

    def current(self) -> str | None:
        return (self.folder.read("CURRENT").strip() or None) if self.folder.exists("CURRENT") else None

    def _plan(self, version: str | None = None) -> dict:
        version = version or self.current()
        return {} if version is None else json.loads(self.folder.read(f"{version}.json"))

    def buckets(self, version: str | None = None) -> dict[str, dict[str, str]]:
        """Of each table, where its buckets stand."""
        plan = self._plan(version)
        return {name: plan.get(name, {}) for name in TABLES}

    def count(self, version: str | None = None) -> int:
        """Into how many buckets the tables are cut."""
        return self._plan(version).get("buckets", LEAST_BUCKETS)

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets. Columns that it was written without get their defaults."""
        places = [f"{self.root}/{where}" for b, where in self.buckets()[name].items() if only is None or int(b) in only]
        if not places:
            return self.spark.createDataFrame([], TABLES[name])
        old = {"source_type": source_type(F.col("path"))}
        return migrated(self.spark.read.option("mergeSchema", "true").parquet(*places), TABLES[name], old)

    def digests(self) -> DataFrame:
        """The digests of the stored files, as they were written with them; computed for stores that have none."""
        where = self._plan().get("digests")
        return self.spark.read.parquet(f"{self.root}/{where}") if where else digests(self.table("files"), self.count())

    def write(self, tables: dict[str, DataFrame], only: list[int] | None = None) -> str:
        """Writes tables, or some of their buckets, as a new version, then points to it. What no version names goes."""
        before, version = self.current(), f"v{time.time_ns()}"
        count = self.count(before)
        if only is None:
            total = tables["files"].agg(F.sum("size_bytes").alias("n")).first()["n"] or 0
            count = max(LEAST_BUCKETS, total // BUCKET_BYTES + 1)
        now: dict = self.buckets(before) if before else {name: {} for name in TABLES}
        for name, schema in TABLES.items():
            cols = [c.split()[0] for c in schema.split(", ")]
            rows = tables[name].select(*cols).withColumn("bucket", bucket(count))
            n = len(only) if only else count
            rows = rows.repartition(n, "bucket") if n > LEAST_BUCKETS else rows.repartition("bucket")
            rows.write.partitionBy("bucket").parquet(f"{self.root}/{version}/{name}")
            kept = {} if only is None else {b: where for b, where in now[name].items() if int(b) not in only}
            new = [x for x in self.folder.names(f"{version}/{name}") if x.startswith("bucket=")]
            now[name] = kept | {x.split("=")[1]: f"{version}/{name}/{x}" for x in new}
        files = [f"{self.root}/{where}" for where in now["files"].values() if where.startswith(f"{version}/")]
        fresh_digests = digests(self.spark.read.parquet(*files), count) if files else None
        if only is not None and before:
            old = self.digests().where(~F.col("bucket").isin(list(only)))
            fresh_digests = old if fresh_digests is None else old.unionByName(fresh_digests)
        if fresh_digests is not None:
            fresh_digests.write.parquet(f"{self.root}/{version}/digests")
        if self.indexed:
            old = self._plan(before) if before and only is not None else {}
            now |= self._write_index(version, files, count, {k: {b: w for b, w in old.get(k, {}).items() if int(b) not in (only or [])} for k in INDEX})
        now |= {"buckets": count, "digests": f"{version}/digests" if fresh_digests is not None else None}
        self.folder.write(f"{version}.json", json.dumps(now))
        self.folder.write("CURRENT", version)
        named = {w for v in (before, version) if v for t in self._plan(v).values() if isinstance(t, dict) for w in t.values()} | {w for v in (before, version) if v and (w := self._plan(v).get("digests"))}
        for old in self.folder.names():
            if old.startswith("v") and old.endswith(".json") and old[:-5] not in (before, version):
                self.folder.remove(old)
            elif old.startswith("v") and not any(w.startswith(f"{old}/") for w in named) and old != version and "." not in old:
                self.folder.remove(old)
        return version

    def _write_index(self, version: str, files: list[str], count: int, kept: dict[str, dict[str, str]]) -> dict:
        """Where the index of each bucket stands: that of the files just written, and what is kept."""
        if files:
            rows = textindex.numbered(textindex.blocks(self.spark.read.parquet(*files).select("path", "content")), count)
            postings.save(rows, f"{self.root}/{version}/blocks", "number")
            written = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/{version}/blocks")
            postings.save(postings.lists(written, textindex.lowered(), textindex.GRAM), f"{self.root}/{version}/grams", "gram")
        return {k: kept[k] | {x.split("=")[1]: f"{version}/{k}/{x}" for x in self.folder.names(f"{version}/{k}") if x.startswith("part=")} for k in INDEX}

    def text_index(self) -> textindex.TextIndex:
        """Search over the current version's lines, as it was indexed with; ValueError if it was not."""
        plan = self._plan()
        if not all(k in plan for k in INDEX):
            raise ValueError("the store was written without an index")
        tables = [self.spark.read.schema(kind).parquet(*[f"{self.root}/{w}" for w in plan[k].values()]) if plan[k] else self.spark.createDataFrame([], kind) for k, kind in INDEX.items()]
        return textindex.TextIndex(postings.Postings(*tables))

    def healthy(self) -> bool:
        """Whether all of the current version can be read; one that cannot is set aside and the store is empty again.

        Every column of every row is read, twice if the first try fails, and files are held against the digests they were
        written with, so rows that are lost without an error are found too.
        """
        version = self.current()
        for attempt in (0, 1):
            try:
                for name in TABLES:
                    t = self.table(name)
                    t.agg(F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).collect()
                if self._plan().get("digests") and differing(self.digests(), digests(self.table("files"), self.count())).limit(1).count():
                    raise ValueError("rows of files are missing or changed")
                return True
            except (PySparkException, Py4JJavaError, ValueError, KeyError, OSError):
                if attempt and version is not None:
                    self.folder.rename(f"{version}.json", f"{version}.corrupt-{time.time_ns()}")
                    self.folder.remove("CURRENT")
        return False

    def upsert(self, files: DataFrame, deleted: DataFrame | None = None, force: bool = False, custom: list[tuple[str, str]] = ()) -> str | None:
        """Indexes files (path, content) whose hash is new and drops deleted paths (path); None if nothing changed."""
        new_files = files if force else fresh(files, self.table("files"))
        gone = new_files.select("path") if deleted is None else new_files.select("path").unionByName(deleted.select("path"))
        gone = gone.distinct()
        touched = [r["b"] for r in gone.select(bucket(self.count()).alias("b")).distinct().collect()]  # a number for each bucket at most
        if not touched:
            return None
        new = build(new_files, custom)
        size = self.table("files").agg(F.sum("size_bytes").alias("n")).first()["n"] or 0
        if self.current() is None or size > GROWN * BUCKET_BYTES * self.count():  # cut anew
            return self.write({name: replaced(self.table(name), new[name].select(*[c.split()[0] for c in s.split(", ")]), gone) for name, s in TABLES.items()})
        return self.write({name: replaced(self.table(name, touched), new[name].select(*[c.split()[0] for c in s.split(", ")]), gone) for name, s in TABLES.items()}, touched)

    def reindex(self, root: str, path: str | None = None) -> bool:
        """Indexes one file of the tree at root again, or all that are stored; False for links, folders and what is outside.

        One file with the same content changes nothing; without a path every stored file that is still there is read anew.
        """
        if path is not None:
            rel = existing(root, path)
            if rel is None:
                return False
            self.upsert(read_files(self.spark, root, [rel]))
            return True
        self.upsert(read_paths(self.table("files").select("path"), root), force=True)
        return True

    def rebuild(self, files: DataFrame, custom: list[tuple[str, str]] = ()) -> str:
        """Forgets everything and indexes files (path, content)."""
        return self.write(build(files, custom))

    def reconcile(self, disk: DataFrame) -> str | None:
        """Makes the store equal to disk (path, content): adds, changes and deletes."""
        now = disk.select("path", F.md5("content").alias("hash"))
        diff = changes_by_digest(now, self.table("files"), self.count(), self.digests())
        return self.upsert(disk.join(diff.where("change <> 'unlink'"), "path", "left_semi"), diff.where("change = 'unlink'"))


def bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(count)).cast("int")
