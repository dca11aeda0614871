"""A source tree as a batch data source: folders are dealt to tasks, which list and read them where they stand.

The driver looks at folders down to a small depth only and names no file. A partition is a folder's own files, or all
that lies below a folder at that depth. Filters on path and extension are taken into the listing, so folders that cannot
hold a wanted file are not opened. Links are not followed, and what is no regular file inside the root is left out, by the
task that reads.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .repo import EXTENSIONS, existing, ignored_names
from .session import importable

SCHEMA = "path string, extension string, mtime double, size bigint, content string"
#: Folders down to which the driver looks; bytes of text in a batch.
DEPTH, BATCH_BYTES = 2, 8 << 20


@dataclass
class Part(InputPartition):
    folder: str
    below: bool


class TreeFiles(DataSource):
    """Rows of SCHEMA. Options: root; extensions and ignore, separated by commas; depth; content (false: without texts)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        names = lambda key: [x for x in options.get(key, "").split(",") if x]
        self.root = options["root"]
        self.wanted = set(names("extensions") or EXTENSIONS)
        self.skip = set(ignored_names(names("ignore")))
        self.depth, self.content = int(options.get("depth", DEPTH)), options.get("content", "true") != "false"
        self.paths: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, lists and beginnings of paths, and equality and lists of extensions; the rest stays with Spark."""
        for f in filters:
            value = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if value is not None and f.attribute == ("path",):
                self.paths = value if self.paths is None else self.paths & value
            elif value is not None and f.attribute == ("extension",):
                self.wanted &= value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether a wanted path can lie below a folder ("" for the root)."""
        top = f"{folder}/" if folder else ""
        if self.paths is not None and not any(p.startswith(top) for p in self.paths):
            return False
        return all(top.startswith(p) or p.startswith(top) for p in self.prefixes)

    def _take(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes) and os.path.splitext(path)[1] in self.wanted

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """(folders, files) in a folder that may count, sorted; folders that are links or cannot be read have none."""
        folders, files = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in self.skip and self._may_hold(path):
                            folders.append(path)
                    elif self._take(path):
                        files.append(path)
        except OSError:
            return [], []
        return sorted(folders), sorted(files)

    def partitions(self) -> list[Part]:
        out, level = [], [""]
        for depth in range(self.depth + 1):
            out += [Part(f, depth == self.depth) for f in level]
            level = [] if depth == self.depth else [g for f in level for g in self._folders(f)]
        return out

    def _folders(self, folder: str) -> list[str]:
        return self._entries(folder)[0]

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa

        rows: list[tuple] = []
        size, waiting = 0, [part.folder]
        while waiting:
            folders, files = self._entries(waiting.pop())
            if part.below:
                waiting += reversed(folders)
            for path in files:
                if existing(self.root, path) is None:
                    continue
                full = os.path.join(self.root, path)
                try:
                    s, text = os.stat(full), None
                    if self.content:
                        with open(full, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                except OSError:
                    continue
                rows.append((path, os.path.splitext(path)[1], s.st_mtime, s.st_size, text))
                size += s.st_size
                if size >= BATCH_BYTES:
                    yield _batch(pa, rows)
                    rows, size = [], 0
        if rows:
            yield _batch(pa, rows)


def _batch(pa, rows: list[tuple]):
    kinds = [("path", pa.string()), ("extension", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("content", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None, content: bool = True, depth: int = DEPTH) -> DataFrame:
    """SCHEMA of a tree that all executors can reach."""
    importable(spark)
    spark.dataSource.register(TreeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"root": root, "extensions": ",".join(extensions or []), "ignore": ",".join(ignore or []), "content": str(content).lower(), "depth": str(depth)}
    return spark.read.format("lodestone_files").options(**options).load()
