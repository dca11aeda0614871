"""A source tree as a stream of changes, applied to a snapshot store batch by batch.

The stream's offset is a listing of the tree (path to mtime and size) kept in a side file by version, so modified and
deleted files appear, which a plain file stream never shows. Content hashes in the store make repeats harmless.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..plans.store import Snapshots
from ..sources.repo import list_files, read_paths


class TreeChanges(DataSource):
    """Rows (path, change) with change add, change or unlink. Options: root, state (a directory for listings)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_tree"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["root"], self.options["state"])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def initialOffset(self) -> dict:
        return {"version": 0}

    def _listing(self, version: int) -> dict[str, list]:
        path = os.path.join(self.state, f"{version}.json")
        if version == 0 or not os.path.exists(path):
            return {}
        with open(path) as f:
            return json.load(f)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old = self._listing(start["version"])
        new = {p: [m, s] for p, m, s in list_files(self.root)}
        if new == old:
            return iter([]), start
        version = start["version"] + 1
        os.makedirs(self.state, exist_ok=True)
        tmp = os.path.join(self.state, f".{version}")
        with open(tmp, "w") as f:
            json.dump(new, f)
        os.replace(tmp, os.path.join(self.state, f"{version}.json"))
        return iter(difference(old, new)), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(difference(self._listing(start["version"]), self._listing(end["version"])))

    def commit(self, end: dict) -> None:
        for old in range(1, end["version"]):
            path = os.path.join(self.state, f"{old}.json")
            if old < end["version"] - 1 and os.path.exists(path):
                os.remove(path)


def difference(old: dict, new: dict) -> list[tuple[str, str]]:
    """(path, change) from one listing to another, by path."""
    out = [(p, "add") for p in new if p not in old] + [(p, "change") for p in new if p in old and new[p] != old[p]] + [(p, "unlink") for p in old if p not in new]
    return sorted(out)


def apply_changes(store: Snapshots, root: str, batch: DataFrame) -> None:
    """Indexes added and changed files of one batch and drops deleted ones; a batch is as long as the tree changed."""
    changed = batch.where("change <> 'unlink'").select("path")
    store.upsert(read_paths(changed, root), batch.where("change = 'unlink'").select("path"))


def watch(spark: SparkSession, root: str, store: Snapshots, checkpoint: str, interval: str | None = None):
    """Starts the stream; with an interval it polls, without one it takes what there is and ends."""
    spark.dataSource.register(TreeChanges)
    stream = spark.readStream.format("lodestone_tree").option("root", root).option("state", os.path.join(checkpoint, "listings")).load()
    writer = stream.writeStream.option("checkpointLocation", os.path.join(checkpoint, "offsets")).foreachBatch(lambda b, _: apply_changes(store, root, b))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
