"""Notes and their pages written by tasks: each writes files of its own aside, and one commit makes all of them visible.

A commit is a small journal first: what is to be moved where, and the new cursor. It is replayed by the next write if the
commit broke off, so a page is seen with all of a write's notes or with none, and no note is written twice.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.notes import vault_pages
from .session import importable

ASIDE, JOURNAL, CURSOR = ".aside", ".journal", ".cursor"


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]
    last: int


class VaultPages(DataSource):
    """Sink of (target, file, page, last): a page's new sections, the page's file below the folder, the last note's number."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_vault"

    def schema(self) -> str:
        return "target string, file string, page string, last bigint"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VaultWriter(self.options["folder"], self.options["write"])


class VaultWriter(DataSourceWriter):
    def __init__(self, folder: str, write: str):
        self.folder, self.aside = folder, os.path.join(folder, ASIDE, write)

    def write(self, rows: Iterator) -> Written:
        """A task's pages, each whole: what stood there and the new sections. Another attempt writes files of other names."""
        moves, last = [], 0
        for row in rows:
            place = os.path.join(self.folder, row["file"])
            old = ""
            if os.path.exists(place):
                with open(place, encoding="utf-8") as f:
                    old = f.read()
            os.makedirs(self.aside, exist_ok=True)
            own = os.path.join(self.aside, uuid.uuid4().hex)
            with open(own, "w", encoding="utf-8") as f:
                f.write(old + row["page"].split("\n\n", 1)[1] if old else row["page"])
            moves.append((os.path.relpath(own, self.folder), row["file"]))
            last = max(last, row["last"])
        return Written(moves, last)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        plan = {"moves": [m for t in told for m in t.moves], "cursor": max([t.last for t in told], default=0), "aside": os.path.relpath(self.aside, self.folder)}
        _put(os.path.join(self.folder, JOURNAL), json.dumps(plan))
        replay(self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


def _put(path: str, text: str) -> None:
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.new", path)


def replay(folder: str) -> None:
    """Does what the journal says, from wherever that was broken off; nothing without one."""
    journal = os.path.join(folder, JOURNAL)
    if not os.path.exists(journal):
        return
    with open(journal, encoding="utf-8") as f:
        plan = json.load(f)
    for own, file in plan["moves"]:
        source, place = os.path.join(folder, own), os.path.join(folder, file)
        if os.path.exists(source):  # else it has been moved
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(source, place)
    if plan["cursor"]:
        _put(os.path.join(folder, CURSOR), str(plan["cursor"]))
    shutil.rmtree(os.path.join(folder, plan["aside"]), ignore_errors=True)
    os.remove(journal)


def cursor(folder: str) -> int:
    path = os.path.join(folder, CURSOR)
    if not os.path.exists(path):
        return 0
    with open(path, encoding="utf-8") as f:
        return int(f.read() or 0)


def sync_vault(notes: DataFrame, vault: str, folder: str = "notes") -> int:
    """Adds the notes after the vault's cursor to their targets' pages, in parallel; returns how many. All executors have to
    reach the vault."""
    from ..functions.text import safe_path

    spark: SparkSession = notes.sparkSession
    importable(spark)
    spark.dataSource.register(VaultPages)
    top = os.path.join(vault, folder)
    os.makedirs(top, exist_ok=True)
    replay(top)
    since = cursor(top)
    fresh = notes.where(F.col("seq") > since)
    n = fresh.count()
    if n:
        last = fresh.groupBy("target").agg(F.max("seq").alias("last"))
        pages = vault_pages(notes, since).join(last, "target")
        # Targets whose names give one file are one page, in the order of their first notes.
        pages = pages.select(F.concat(safe_path(F.col("target")), F.lit(".md")).alias("file"), "target", "page", "last").groupBy("file").agg(
            F.min("target").alias("target"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "page"))), lambda x: x["page"]), "\n").alias("page"), F.max("last").alias("last")
        )
        pages.select("target", "file", "page", "last").write.format("lodestone_vault").option("folder", top).option("write", uuid.uuid4().hex).mode("append").save()
    return n
