"""Symbols and imports of source files by structural scanning, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Tagger
from ..functions.scan import link_children, scan
from ..functions.text import extension, language
from ..sources.session import importable, stored
from . import parse_lines, tagging

SCHEMA = (
    "path string, rec string, ordinal int, name string, kind string, signature string, start_line int, end_line int, exported int, async int, "
    "parent_class string, children array<int>, source string, identifiers array<string>, line int"
)
SCANNED = ["javascript", "typescript", "tsx", "python", "go", "rust", "java", "csharp"]


#: Bytes of files for each core up to which they are dealt anew; more come in enough parts by themselves.
SMALL_BYTES = 8 << 20


def spread(files: DataFrame) -> DataFrame:
    """Few bytes dealt to all cores, for what follows takes time with every byte; many as they come, without a shuffle."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    known = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the optimizer's estimate
    return files.repartition(cores) if known < cores * SMALL_BYTES else files


def records(files: DataFrame, custom: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each symbol (rec = symbol) or import (rec = import) of files (path, content) in scanned languages.

    With a list of further rules, empty or not, the symbols' tags too (rec = tag: ordinal and name of the symbol, the tag in
    ``source``), while text and spans are at hand.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    kinds = [{"string": pa.string(), "int": pa.int32()}.get(f.split()[1]) or pa.list_({"array<int>": pa.int32(), "array<string>": pa.string()}[f.split()[1]]) for f in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(custom) if custom is not None else None
        for b in batches:
            at, rows = [], []
            for i, (content, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                symbols, imports = scan(content or "", lang)
                children = link_children(symbols)
                new = [("symbol", k, *s, children.get(k, []), None, None, None) for k, s in enumerate(symbols)]
                new += [("import", k, *[None] * 9, *x) for k, x in enumerate(imports)]
                if tagger and symbols:
                    spans = [(k, s[0], s[3], s[4], s[6]) for k, s in enumerate(symbols)]
                    new += [("tag", k, name, *[None] * 8, tag, None, None) for k, name, tag in tagger.tags(content, spans)]
                at += [i] * len(new)
                rows += new
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32()))] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", *names])

    importable(files.sparkSession)
    lang = language(F.col("path"))
    wanted = files.select("path", "content", lang.alias("lang")).where(F.col("lang").isin(SCANNED))
    return spread(wanted).mapInArrow(run, SCHEMA)


def parse(files: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of all files: scanned languages and line-oriented formats together.

    With ``once`` the scanners and line parsers run now, and only once; else each use of the tables runs them.
    """
    rows = stored(records(files), "records") if once else records(files)
    return _symbols(files, rows, once), _imports(files, rows)


def parse_tagged(files: DataFrame, custom: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, tags) of all files, scanned and tagged in one pass, now and only once."""
    rows = stored(records(files, list(custom)), "records")
    symbols = _symbols(files, rows, True)
    plain = files.where(~language(F.col("path")).isin(SCANNED))
    tags = rows.where("rec = 'tag'").select("path", F.col("ordinal").alias("symbol_ordinal"), F.col("name").alias("symbol_name"), F.col("source").alias("tag"))
    return symbols, _imports(files, rows), tags.unionByName(tagging.tag_symbols(plain, parse_lines.parse(plain), custom))


def _symbols(files: DataFrame, rows: DataFrame, once: bool) -> DataFrame:
    symbols = rows.where("rec = 'symbol'").select(*parse_lines.SYMBOL_COLUMNS)
    symbols = symbols.unionByName(parse_lines.parse(files))
    return stored(symbols, "symbols") if once else symbols


def _imports(files: DataFrame, rows: DataFrame) -> DataFrame:
    imports = rows.where("rec = 'import'").select("path", "ordinal", "source", "identifiers", "line")
    sourced = parse_lines.bash_imports(files.where(F.lower(extension(F.col("path"))).isin("sh", "bash")))
    place = Window.partitionBy("path").orderBy("line")
    sourced = sourced.select("path", (F.row_number().over(place) - 1).alias("ordinal"), "source", "identifiers", "line")
    return imports.unionByName(sourced)


def children(files: DataFrame) -> DataFrame:
    """(path, ordinal, child): the ordinals of each symbol's children, of scanned languages."""
    return records(files).where("rec = 'symbol'").select("path", "ordinal", F.explode("children").alias("child"))
