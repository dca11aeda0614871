"""Ranked symbol search over postings of names, opening classes of symbols by the best score that they can have."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, query_words
from ..sources.session import shared_path
from . import postings
from .search import find_symbols, rank_order, symbol_scores

#: Symbols in a shard, about.
SHARD_ROWS = 1_000_000


def _grams(part: str) -> list[int]:
    """Grams that names with this part hold: of two characters where it has no more. % and _ stand for any characters."""
    out: dict[int, None] = {}
    for run in re.split(r"[%_]", part):
        run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        out.update(dict.fromkeys(postings.grams_of(run, 3 if len(run) > 2 else 2)))
    return list(out)[: postings.MOST_GRAMS]


class SymbolIndex:
    """An index below a path; ``build`` writes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = postings.Postings.at(spark, path)

    @classmethod
    def build(cls, symbols: DataFrame, path: str | None = None, shard_rows: int = SHARD_ROWS) -> SymbolIndex:
        """Indexes symbols (path, ordinal, name and more) below path, or in the shared folder until the driver ends."""
        spark = symbols.sparkSession
        path = path or shared_path(spark, "symbolindex")
        order = ["path", "ordinal", *(["repo"] if "repo" in symbols.columns else [])]
        postings.write(postings.numbered(symbols, symbols.count() // shard_rows + 1, *order), path, fold(F.col("name")), 2, 3)
        return cls(spark, path)

    def bounds(self, query: str) -> DataFrame | None:
        """(shard, number, bound) of the symbols that may match, and the best score that each can have; None if a part of
        the query is too short for postings.

        A symbol that holds the whole query has 100 at most, one below src/ 5 more, and 25 for each word that it holds.
        Words of one character, or with others than ASCII's, do not decide whether a symbol is found, so they count for all.
        """
        words = query_words(query)
        parts: dict[str, tuple[int, int]] = {query: (100, 0)}
        free = 5
        for w in words:
            whole, bonus = parts.get(w, (0, 0))
            if len(w) > 1:
                parts[w] = (whole, bonus + (25 if w.isascii() else 0))
            if len(w) < 2 or not w.isascii():
                free += 25
        found = []
        for part, (whole, bonus) in parts.items():
            wanted = _grams(part)
            if not wanted:
                return None
            found.append(self.index.holding(wanted).select("shard", "number", F.lit(whole + bonus).alias("bound")))
        return reduce(DataFrame.unionAll, found).groupBy("shard", "number").agg((F.sum("bound") + free).alias("bound"))

    def find_symbols(self, query: str, limit: int | None = None, **filters) -> DataFrame:
        """As ``search.find_symbols``. With a limit, classes of symbols with one bound are opened, the highest first, until
        ``limit`` symbols score more than those of the next class can."""
        bounds = self.bounds(query) if query and isinstance(query, str) else None
        if bounds is None:
            return find_symbols(self.index.rows.drop("shard", "number", "part"), query, limit, **filters)
        if not limit:
            return find_symbols(self._open(bounds), query, **filters)
        self.opened, classes = 0, bounds.groupBy("bound").count().orderBy(F.desc("bound")).collect()  # a row for each possible sum
        rows = self._open(bounds.limit(0))
        for i, c in enumerate(classes):
            self.opened += c["count"]
            after = classes[i + 1]["bound"] if i + 1 < len(classes) else -1
            if self.opened < limit and after >= 0:
                continue
            rows = self._open(bounds.where(F.col("bound") >= c["bound"]))
            if after < 0 or symbol_scores(rows, query, **filters).where(F.col("score") > after).limit(limit).count() >= limit:
                break
        return symbol_scores(rows, query, **filters).orderBy(*rank_order()).limit(limit)

    def _open(self, which: DataFrame) -> DataFrame:
        return self.index.opened(which).drop("shard", "number", "part")
