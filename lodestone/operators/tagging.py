"""Semantic tags of symbols, from the text of their lines, in Arrow batches: a file's text meets its symbols once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ROUTE, Tagger, route_lines_of
from ..functions.text import trim
from ..sources.session import importable
from .parse_lines import exploded
from .search import _keys

#: Patterns of exported names (fixed values).
EXPORTS_OBJECT = r"module\.exports\s*=\s*\{([^}]+)\}"
EXPORTS_NAME = r"exports\.(\w+)"


def _met(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, list[str]]:
    """The files' keys, content and spans (their symbols)."""
    keys = _keys(files, symbols)
    span = F.struct("ordinal", "name", "start_line", "end_line", F.col("async") if "async" in symbols.columns else F.lit(0).alias("async"))
    spans = symbols.groupBy(*keys).agg(F.collect_list(span).alias("spans"))
    importable(files.sparkSession)
    return files.select(*keys, "content").join(spans, keys).select(*keys, "content", "spans"), keys


def _by_file(rows: DataFrame, keys: list[str], schema: str, each) -> DataFrame:
    """A row (keys and what ``each`` gives) for each tuple of each(content, symbols)."""
    kinds = [c.split()[1] for c in schema.split(", ")]
    arrow = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], [[] for _ in kinds]
            spans = b.column(len(keys) + 1).to_pylist()
            for k, text in enumerate(b.column(len(keys)).to_pylist()):
                symbols = sorted((s["ordinal"], s["name"], s["start_line"], s["end_line"], s["async"]) for s in spans[k])
                for row in each(text or "", symbols):
                    at.append(k)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))] + [pa.array(c, arrow[t]) for c, t in zip(out, kinds, strict=True)], names=[*keys, *[c.split()[0] for c in schema.split(", ")]])

    return rows.mapInArrow(run, ", ".join([f"{k} string" for k in keys] + [schema]))


def route_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, ordinal, name): each route line's innermost symbol; the first of equally long ones."""

    def each(text: str, symbols: list[tuple]) -> list[tuple]:
        return [(line, symbols[i][0], symbols[i][1]) for line, i in route_lines_of(text, symbols) if i >= 0]

    return _by_file(*_met(files, symbols), "line int, ordinal int, name string", each)


def tag_symbols(files: DataFrame, symbols: DataFrame, custom: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, symbol_ordinal, symbol_name, tag), after repo if files and symbols have it; custom: (pattern, tag).

    Where files are scanned anyway, ``parse_code.parse_tagged`` gives the same rows in one pass.
    """
    custom = list(custom)
    return _by_file(*_met(files, symbols), "symbol_ordinal int, symbol_name string, tag string", lambda text, symbols: Tagger(custom).tags(text, symbols))


def source_tags(files: DataFrame) -> DataFrame:
    """(path, tag, name, line) of whole files: route lines and exported names (without a line)."""
    verb = F.coalesce(F.nullif(F.regexp_extract("text", ROUTE, 1), F.lit("")), F.regexp_extract("text", ROUTE, 2))
    routes = exploded(files).where(F.col("text").rlike(ROUTE)).select("path", F.lit("route_handler").alias("tag"), F.concat(F.upper(verb), F.lit(" route")).alias("name"), "line")
    names = F.filter(F.transform(F.split(F.regexp_extract("content", EXPORTS_OBJECT, 1), ","), trim), lambda n: n != "")
    singles = F.regexp_extract_all("content", F.lit(EXPORTS_NAME), F.lit(1))
    exported = files.select("path", F.explode(F.concat(names, singles)).alias("name"))
    return routes.unionByName(exported.select("path", F.lit("exported").alias("tag"), "name", F.lit(None).cast("int").alias("line")))
