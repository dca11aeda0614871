"""Symbols and imports of line-oriented formats, as plain expressions over exploded lines.

Every parser takes files (path, content) and returns symbols (path, ordinal, name, kind, signature, start_line, end_line,
exported, async, parent_class). A symbol spans its line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, lines, trim

#: The patterns of the formats (fixed values).
BASH_FUNCTION = r"^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{?"
BASH_SOURCE = r"^(?:source|\.)\s+(.+)"
CSS_RULE = r"^([.#][\w-]+)\s*\{"
JSON_KEY = r'^\s*"([\w$-]+)"\s*:'
GRAPHQL_TYPE = r"^(?:type|input|enum|interface|union|scalar|directive)\s+(\w+)"
GRAPHQL_CALL = r"^(?:query|mutation|subscription)\s+(\w+)"
MARKDOWN_HEAD = r"^(#{1,2})\s+(.+)"
TOML_SECTION = r"^\[+([^\]]+)\]+"
MARKUP_TAG = r"(?i)<(script|style)\b[^>]*>"
COMPONENT_FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"
COMPONENT_ARROW = r"(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\("
SQL_TABLE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
SQL_VIEW = r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(\w+)"

SYMBOL_COLUMNS = ["path", "ordinal", "name", "kind", "signature", "start_line", "end_line", "exported", "async", "parent_class"]


def exploded(files: DataFrame) -> DataFrame:
    """path, line (from 1), text; repo before them if files have it."""
    keys = [c for c in ("repo", "path") if c in files.columns]
    return files.select(*keys, F.posexplode(lines(F.col("content"))).alias("p", "text")).select(*keys, (F.col("p") + 1).alias("line"), "text")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _symbols(rows: DataFrame, *found: tuple[Column, Column], signature: Column | None = None, exported: Column | None = None, asynchronous: Column | None = None) -> DataFrame:
    """Rows (path, line, text) to symbols: one for each (name, kind) whose name is not null, in this order in a line."""
    sig = trim(F.col("text")) if signature is None else signature
    options = F.filter(F.array(*[F.struct(F.lit(i).alias("k"), n.alias("name"), k.alias("kind")) for i, (n, k) in enumerate(found)]), lambda s: s["name"].isNotNull())
    out = rows.withColumn("_s", F.explode(options))
    zero = F.lit(0)
    return out.select(
        "path", F.col("line").alias("_line"), F.col("_s.k").alias("_k"), F.col("_s.name").alias("name"), F.col("_s.kind").alias("kind"), sig.alias("signature"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), (zero if exported is None else exported.cast("int")).alias("exported"),
        (zero if asynchronous is None else asynchronous.cast("int")).alias("async"), F.lit(None).cast("string").alias("parent_class"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Numbers a file's symbols by _line and _k, which go."""
    w = Window.partitionBy("path").orderBy("_line", "_k")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).select(*SYMBOL_COLUMNS)


def _numbered(parser: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A parser with numbers; its rows before that are in ``raw``, so that many parsers can share one numbering."""

    @wraps(parser)
    def run(files: DataFrame) -> DataFrame:
        return _in_order(parser(files))

    run.raw = parser
    return run


def _t() -> Column:
    return F.col("text")


@_numbered
def bash(files: DataFrame) -> DataFrame:
    name = _found(_t(), BASH_FUNCTION)
    return _symbols(exploded(files), (F.when(~name.isin("if", "for", "while"), name), F.lit("function")))


def bash_imports(files: DataFrame) -> DataFrame:
    """path, source, identifiers, line of sourced files."""
    rows = exploded(files).withColumn("source", _found(_t(), BASH_SOURCE))
    return rows.where("source is not null").select("path", trim(F.col("source")).alias("source"), F.array().cast("array<string>").alias("identifiers"), "line")


@_numbered
def css(files: DataFrame) -> DataFrame:
    name = _found(_t(), CSS_RULE)
    return _symbols(exploded(files), (name, F.lit("class")), signature=name)


@_numbered
def json_keys(files: DataFrame) -> DataFrame:
    return _symbols(exploded(files), (_found(_t(), JSON_KEY), F.lit("variable")))


def _plain_key(sign: str) -> Column:
    key = _found(_t(), rf"^\s*([\w$_-]+)\s*{sign}")
    return F.when(~F.regexp_replace(_t(), r"^\s+", "").startswith("#"), key)


@_numbered
def yaml(files: DataFrame) -> DataFrame:
    return _symbols(exploded(files), (_plain_key(":"), F.lit("variable")))


@_numbered
def graphql(files: DataFrame) -> DataFrame:
    types = _found(_t(), GRAPHQL_TYPE)
    calls = _found(_t(), GRAPHQL_CALL)
    return _symbols(exploded(files), (types, F.lit("class")), (calls, F.lit("function")))


@_numbered
def markdown(files: DataFrame) -> DataFrame:
    kind = F.when(F.length(F.regexp_extract(_t(), MARKDOWN_HEAD, 1)) == 1, "class").otherwise("function")
    return _symbols(exploded(files), (trim(_found(_t(), MARKDOWN_HEAD, 2)), kind))


@_numbered
def toml(files: DataFrame) -> DataFrame:
    section = trim(_found(_t(), TOML_SECTION))
    return _symbols(exploded(files), (section, F.lit("class")), (F.when(section.isNull(), _plain_key("=")), F.lit("variable")))


@_numbered
def markup(files: DataFrame) -> DataFrame:
    return _symbols(exploded(files), (F.lower(_found(_t(), MARKUP_TAG)), F.lit("class")))


@_numbered
def components(files: DataFrame) -> DataFrame:
    """Functions in script sections; lines with a section's tag are left out, and the last tag before decides."""
    tag = F.when(_t().contains("<script"), 1).when(_t().contains("</script>"), 0)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = exploded(files).withColumn("_tag", tag).withColumn("_in", F.last("_tag", ignorenulls=True).over(w)).where("_tag is null and _in = 1")
    named = _found(_t(), COMPONENT_FUNCTION)
    arrow = _found(_t(), COMPONENT_ARROW)
    return _symbols(rows, (named, F.lit("function")), (arrow, F.lit("function")), exported=_t().contains("export"), asynchronous=_t().contains("async"))


@_numbered
def sql(files: DataFrame) -> DataFrame:
    """Tables, then views; a statement may run over lines, so the text is cut at matches and the line counted before."""
    out = None
    for k, (pattern, kind, verb) in enumerate(
        [
            (SQL_TABLE, "class", "CREATE TABLE "),
            (SQL_VIEW, "function", "CREATE VIEW "),
        ]
    ):
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        gaps = F.split("content", pattern, -1)
        whole = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        rows = files.select("path", F.posexplode(names).alias("i", "name"), gaps.alias("g"), whole.alias("m"))
        breaks = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
        line = F.lit(1) + breaks(F.slice("g", 1, F.col("i") + 1)) + breaks(F.slice("m", 1, F.col("i")))
        part = rows.select("path", F.lit(k).alias("k"), "i", "name", F.lit(kind).alias("kind"), F.concat(F.lit(verb), "name").alias("signature"), line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out.select(
        "path", F.col("k").alias("_line"), F.col("i").alias("_k"), "name", "kind", "signature", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.lit(0).alias("exported"), F.lit(0).alias("async"), F.lit(None).cast("string").alias("parent_class"),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sh bash": bash, "sql": sql, "css scss less": css, "json": json_keys, "yaml yml": yaml, "graphql gql": graphql,
    "md": markdown, "toml": toml, "xml html": markup, "vue svelte": components,
}


def parse(files: DataFrame) -> DataFrame:
    """Symbols of all files of these formats, each by its extension."""
    ext = F.lower(extension(F.col("path")))
    return _in_order(reduce(DataFrame.unionByName, [parser.raw(files.where(ext.isin(names.split()))) for names, parser in PARSERS.items()]))
