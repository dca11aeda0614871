"""Text and reference search over an index of trigrams by blocks of lines; the same rows as a scan of all lines gives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_pattern, lines, literal_filter, trim
from ..sources.session import shared_path
from . import postings
from .search import _keys

GRAM = 3
#: Lines of a file in one row; bytes of a block, of one file's lines or of several small files; bytes of text in a shard, about.
BLOCK_LINES, BLOCK_BYTES, SHARD_BYTES = 1024, 256 << 10, 64 << 20


def blocks(files: DataFrame, size: int | None = None) -> DataFrame:
    """path (after repo, if files have it), first_line and text of each ``size`` lines (BLOCK_LINES) of a file."""
    keys, size = _keys(files), size or BLOCK_LINES
    cut = files.where("content is not null").select(*keys, lines(F.col("content")).alias("ls"))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / size).cast("int")), lambda k: F.struct((k * size + 1).alias("first_line"), F.array_join(F.slice("ls", k * size + 1, size), "\n").alias("text")))
    return cut.select(*keys, F.explode(each).alias("b")).select(*keys, "b.first_line", "b.text")


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of ``blocks`` in numbered blocks of about BLOCK_BYTES."""
    return postings.numbered(rows, shards, *reversed(_keys(rows)), "first_line", block_bytes=F.octet_length("text") + 1, size=BLOCK_BYTES)


def lowered() -> Column:
    """What grams are taken from."""
    return F.lower("text")


class TextIndex:
    """Text search over blocks of lines and their postings; ``build`` writes them, a store can keep them with its versions."""

    def __init__(self, index: postings.Postings):
        self.index = index

    @classmethod
    def build(cls, files: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> TextIndex:
        """Indexes files (path, content, perhaps repo) below path, or in the shared folder until the driver ends."""
        spark = files.sparkSession
        path = path or shared_path(spark, "textindex")
        total = files.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
        postings.write(numbered(blocks(files), total // shard_bytes + 1), path, lowered(), GRAM)
        return cls(postings.Postings.at(spark, path))

    def _wanted(self, pattern: str, case_sensitive: bool) -> list[int]:
        """Grams that every line with the pattern holds in lower case.

        How letters other than ASCII's fall into lower case can depend on their neighbours, so where case matters only
        stretches of ASCII count; else the pattern in lower case is what lines are searched for.
        """
        parts = re.findall(r"[\x00-\x7f]+", pattern) if case_sensitive else [pattern]
        return list(dict.fromkeys(g for p in parts for g in postings.grams_of(p.lower(), GRAM)))[: postings.MOST_GRAMS]

    def candidates(self, pattern: str, case_sensitive: bool = False) -> DataFrame:
        """The rows of blocks that may hold the pattern; all of them for patterns without a gram."""
        wanted = self._wanted(pattern, case_sensitive)
        return self.index.opened(self.index.holding(wanted)) if wanted else self.index.rows

    def _lines(self, found: DataFrame) -> DataFrame:
        keys = _keys(found)
        return found.select(*keys, "first_line", F.posexplode(lines(F.col("text"))).alias("p", "t")).select(*keys, (F.col("first_line") + F.col("p")).alias("line"), F.col("t").alias("text"))

    def find_text(self, pattern: str, case_sensitive: bool = False, use_regex: bool = False) -> DataFrame:
        """As ``search.find_text``."""
        hit = literal_filter(F.col("text"), pattern, case_sensitive, use_regex)
        rows = self._lines(self.candidates(pattern, case_sensitive).where(literal_filter(F.col("text"), pattern, case_sensitive))).where(hit)
        return rows.select(*_keys(rows), "line", trim(F.col("text")).alias("content"))

    def find_references(self, name: str) -> DataFrame:
        """As ``search.find_references``."""
        pattern = identifier_pattern(name)
        rows = self._lines(self.candidates(name, True).where(F.col("text").contains(name))).where(F.col("text").rlike(pattern))
        return rows.select(*_keys(rows), "line", trim(F.col("text")).alias("content"))
