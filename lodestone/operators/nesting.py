"""The tree of symbols that stand in each other: ancestors of any depth, and symbols on changed lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import enclosing, touched
from ..sources.session import importable
from .search import _keys


def ancestors(symbols: DataFrame) -> DataFrame:
    """(path, ordinal, ancestor, depth), after repo if there is one: for each symbol every other one whose lines hold its own.

    depth 1 is the innermost, the symbol's parent. Of symbols with the same lines the first holds the others. A file's
    spans are gathered (a few numbers each) and swept once in their order with a stack, whose content are the ancestors,
    so a file costs its symbols times their depth and no symbol is tried against all others. Symbols without lines have none.
    """
    return _swept(symbols)


def descendants(symbols: DataFrame, name: str) -> DataFrame:
    """(path, name, depth, ordinal, of): everything that stands in symbols of a name, at any depth; ``of`` is that symbol's ordinal.

    Names go with the spans of files that have the name, so the sweep tells all and nothing is joined. Joined to the sweep
    instead, a stored table of symbols was broadcast whole, for its files are small beside its rows.
    """
    below = _swept(symbols, name)
    return below.select(*_keys(symbols), "name", "depth", "ordinal", F.col("ancestor").alias("of"))


def _swept(symbols: DataFrame, under: str | None = None) -> DataFrame:
    """The rows of ``ancestors``; with ``under`` only those of ancestors of that name, and the symbols' own names."""
    keys = _keys(symbols)
    named = [] if under is None else ["name"]
    rows = symbols.where("start_line is not null and end_line is not null")
    gathered = [F.collect_list(F.struct("ordinal", "start_line", "end_line", *named)).alias("spans")]
    if under is None:
        spans = rows.groupBy(*keys).agg(*gathered)
    else:
        spans = rows.groupBy(*keys).agg(*gathered, F.bool_or(F.col("name") == under).alias("has")).where("has").drop("has")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ordinal, ancestor, depth, names = [], [], [], [], []
            for k, spans in enumerate(b.column(len(keys))):
                s = spans.as_py()  # of one file at a time
                number = [x["ordinal"] for x in s]
                for i, around in enumerate(enclosing([x["start_line"] for x in s], [x["end_line"] for x in s], number)):
                    found = [(d, j) for d, j in enumerate(around, 1) if under is None or s[j]["name"] == under]
                    at += [k] * len(found)
                    ordinal += [number[i]] * len(found)
                    ancestor += [number[j] for _, j in found]
                    depth += [d for d, _ in found]
                    names += [s[i]["name"]] * len(found) if named else []
            take = pa.array(at, pa.int32())
            own = [pa.array(x, pa.int32()) for x in (ordinal, ancestor, depth)] + ([pa.array(names, pa.string())] if named else [])
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))] + own, names=[*keys, "ordinal", "ancestor", "depth", *named])

    importable(symbols.sparkSession)
    kinds = [*[f"{k} string" for k in keys], "ordinal int, ancestor int, depth int", *[f"{n} string" for n in named]]
    return spans.select(*keys, "spans").mapInArrow(run, ", ".join(kinds))


def on_lines(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, ordinal, name) of symbols that hold one of the lines (path, line), each once; lines are sorted and searched."""
    keys = _keys(lines, symbols)
    asked = lines.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("lines"))
    spans = symbols.groupBy(*keys).agg(F.collect_set(F.struct("ordinal", "name", "start_line", "end_line")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ordinal, name = [], [], []
            for k, (s, on) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                hit = touched([x["start_line"] for x in s], [x["end_line"] for x in s], on)
                found = sorted({(x["ordinal"], x["name"]) for x, h in zip(s, hit, strict=True) if h})
                at += [k] * len(found)
                ordinal += [f[0] for f in found]
                name += [f[1] for f in found]
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))] + [pa.array(ordinal, pa.int32()), pa.array(name, pa.string())], names=[*keys, "ordinal", "name"])

    importable(symbols.sparkSession)
    return spans.join(asked, keys).select(*keys, "spans", "lines").mapInArrow(run, ", ".join([*[f"{k} string" for k in keys], "ordinal int, name string"]))
