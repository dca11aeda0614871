"""The query functions: ranked symbol search, text and reference search, importers, tags, outlines, slices, status."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, identifier_pattern, like, line_slice, lines, literal_filter, query_words, split_words, trim
from .parse_lines import exploded


def _keys(*tables: DataFrame) -> list[str]:
    """What names a file in all of these tables: repo, if they have it, and path."""
    return [c for c in ("repo", "path") if all(c in t.columns for t in tables)]


DEFAULT_TYPES = ("code", "query")
CODE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def symbol_scores(symbols: DataFrame, query: str, kind: str | None = None, exported_only: bool = False, source_types: list[str] | None = None) -> DataFrame:
    """Matching symbols with base_score (exact 100, prefix 75, substring 50, plus 5 below src/) and score.

    symbols: path, name, kind, exported, source_type and more. A symbol matches by the whole query or by any of its words
    of two letters or more; each word of the query that is one of the name's adds 25. An empty list of source types
    filters nothing; None means code and query.
    """
    if not query or not isinstance(query, str):
        return symbols.withColumns({"base_score": F.lit(0), "score": F.lit(0)}).where(F.lit(False))
    name, words = F.col("name"), query_words(query)
    out = symbols.where(reduce(or_, [like(name, f"%{w}%") for w in [query, *(w for w in words if len(w) > 1)]]))
    types = DEFAULT_TYPES if source_types is None else source_types
    if types:
        out = out.where(F.col("source_type").isin(*types))
    if kind:
        out = out.where(F.col("kind") == kind)
    if exported_only:
        out = out.where(F.col("exported") == 1)
    exact = fold(name) == fold(F.lit(query))
    base = F.when(exact, 100).when(like(name, f"{query}%"), 75).when(like(name, f"%{query}%"), 50).otherwise(0) + F.when(like(F.col("path"), "src/%"), 5).otherwise(0)
    bonus = reduce(lambda a, w: a + F.when(F.array_contains(split_words(name), w), 25).otherwise(0), words, F.lit(0))
    return out.withColumn("base_score", base).withColumn("score", F.col("base_score") + bonus)


def rank_order() -> list[Column]:
    """Best first; names by locale, then by bytes, then by place."""
    return [F.col("score").desc(), F.collate("name", "UNICODE"), F.col("base_score").desc(), F.col("name"), F.col("path"), F.col("ordinal")]


def find_symbols(symbols: DataFrame, query: str, limit: int | None = None, **filters) -> DataFrame:
    """symbol_scores in order, and the first ``limit`` of them if it is given and not 0."""
    out = symbol_scores(symbols, query, **filters).orderBy(*rank_order())
    return out.limit(limit) if limit else out


def find_text(files: DataFrame, pattern: str, case_sensitive: bool = False, use_regex: bool = False) -> DataFrame:
    """(path, line, content), with repo if files have it: lines with a literal string. Files without it are left out before lines are cut."""
    literal_filter(F.col("content"), pattern, case_sensitive, use_regex)  # raises before the plan is made
    return (
        exploded(files.where(literal_filter(F.col("content"), pattern, case_sensitive)))
        .where(literal_filter(F.col("text"), pattern, case_sensitive))
        .select(*_keys(files), "line", trim(F.col("text")).alias("content"))
    )


def find_references(files: DataFrame, name: str) -> DataFrame:
    """(path, line, content): lines with a whole identifier, in its case."""
    pattern = identifier_pattern(name)
    return exploded(files.where(F.col("content").contains(name))).where(F.col("text").rlike(pattern)).select(*_keys(files), "line", trim(F.col("text")).alias("content"))


def import_suffixes(path: str) -> list[str]:
    """The sources by which a file may be imported; at least two segments of a path of three or more."""
    base = next((path[: -len(e)] for e in CODE_EXTENSIONS if path.endswith(e)), path)
    out: dict[str, None] = {}

    def add(whole: str, slash: bool) -> None:
        parts = whole.split("/")
        for i in range(len(parts) - 1, -1, -1):
            if len(parts) - i < (2 if len(parts) >= 3 else 1):
                continue
            suffix = "/".join(parts[i:])
            out.update(dict.fromkeys([suffix, *([suffix + "/"] if slash else []), *(suffix + e for e in CODE_EXTENSIONS)]))

    add(base, False)
    if base.endswith("/index") or base == "index":
        add(base[: base.rfind("/index")], True)  # of a bare "index" this leaves "inde", as users of the tool know it
    return list(out)


def find_importers(imports: DataFrame, path: str) -> DataFrame:
    """(path), with repo if imports have it: files other than this one with an import that may mean it. imports: path, source."""
    if not path or not isinstance(path, str):
        return imports.select(*_keys(imports)).where(F.lit(False))
    source = F.col("source")
    match = reduce(or_, [source.isin(s, "./" + s) | like(source, "%/" + s) for s in import_suffixes(path)])
    return imports.where(match & (F.col("path") != path)).select(*_keys(imports)).distinct()


def import_graph(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, target), with repo if both tables have it: for all files at once, by equality of suffixes; case of paths
    after a slash is ignored. Files of different repositories do not meet.

    An import's source yields itself, itself without ./, and what follows each of its slashes; a file yields the suffixes
    of import_suffixes. Both sides are exploded and joined on the suffix, so no pair is tried that does not match.
    """
    parts = F.split("source", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("s"), F.lit(True).alias("tail")))
    tails = F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<struct<s:string,tail:boolean>>"))
    whole = F.array(F.struct(F.col("source").alias("s"), F.lit(False).alias("tail")), F.struct(F.regexp_replace("source", r"^\./", "").alias("s"), F.lit(False).alias("tail")))
    repo = [c for c in _keys(imports, files) if c != "path"]
    left = imports.select(*repo, F.col("path").alias("importer"), F.explode(F.concat(whole, tails)).alias("k")).select(*repo, "importer", fold(F.col("k.s")).alias("key"), F.col("k.s").alias("s"), "k.tail")
    base = F.regexp_replace("path", r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")

    def ends(b: Column) -> Column:
        seg = F.split(b, "/")
        least = F.when(F.size(seg) >= 3, 2).otherwise(1)
        return F.transform(F.sequence(least, F.size(seg)), lambda k: F.array_join(F.slice(seg, F.size(seg) - k + 1, k), "/"))

    barrel = F.when(base.endswith("/index"), F.regexp_replace(base, r"/index$", "")).when(base == "index", F.lit("inde"))
    plain = ends(base)
    some = F.coalesce(ends(barrel), F.array().cast("array<string>"))
    stems = F.array_distinct(F.concat(plain, some))
    every = F.flatten(F.transform(stems, lambda s: F.concat(F.array(s), F.array(*[F.concat(s, F.lit(e)) for e in CODE_EXTENSIONS]))))
    every = F.array_distinct(F.concat(every, F.transform(some, lambda s: F.concat(s, F.lit("/")))))
    right = files.select(*repo, F.col("path").alias("target"), F.explode(every).alias("suffix")).withColumn("key", fold(F.col("suffix")))
    hit = left.join(right, [*repo, "key"]).where((F.col("tail") | (F.col("s") == F.col("suffix"))) & (F.col("importer") != F.col("target")))
    return hit.select(*repo, "importer", "target").distinct()


def find_by_tag(tags: DataFrame, symbols: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    """tag, symbol_name, kind, signature, start_line, end_line, path, and repo before them if there is one; by repo, path
    and first line."""
    keys = _keys(tags, symbols)
    out = tags.where(F.col("tag") == tag).join(symbols.withColumnRenamed("ordinal", "symbol_ordinal"), [*keys, "symbol_ordinal"])
    out = out.select(*keys[:-1], "tag", "symbol_name", "kind", "signature", "start_line", "end_line", "path").orderBy(*keys, "start_line", "symbol_name")
    return out.limit(limit) if limit else out


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """A file's symbols in their order, one repository's after the other's."""
    return symbols.where(F.col("path") == path).orderBy(*_keys(symbols), "ordinal")


def outline_nested(symbols: DataFrame) -> DataFrame:
    """Top-level symbols of all files with their members (children: names in order).

    A class holds the members that name it; of classes of one name each shows the last one's; members of unknown parents
    stay at the top.
    """
    keys = _keys(symbols)
    classes = symbols.where("kind = 'class'").groupBy(*keys, F.col("name").alias("parent_class")).agg(F.max("ordinal").alias("owner"))
    members = symbols.where("parent_class is not null and kind <> 'class'").join(classes, [*keys, "parent_class"])
    held = members.groupBy(*keys, "parent_class").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("c"))
    held = held.select(*keys, F.col("parent_class").alias("name"), F.col("c.name").alias("children"))
    top = symbols.join(members.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti")
    of = F.when(F.col("kind") == "class", F.coalesce("children", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return top.join(held, [*keys, "name"], "left").select(*keys, "ordinal", "name", "kind", of.alias("children"))


def read_symbols(files: DataFrame, symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """(ord, path, name, start_line, end_line, text) for specs (ord, path, name): the first symbol of the name, or nulls.

    With repo in files and symbols there is a row for each repository that has the symbol, or for the one that the spec
    names in a column repo. A file's specs are gathered first, so that its text meets them once and is cut into lines once.
    """
    keys = _keys(files, symbols)
    first = symbols.groupBy(*keys, "name").agg(F.min_by(F.struct("start_line", "end_line"), "ordinal").alias("s"))
    asked = specs.join(first, [*_keys(specs, first), "name"], "left").groupBy(*keys).agg(F.collect_list(F.struct("ord", "name", "s")).alias("asked"))
    cut = asked.join(files.select(*keys, lines(F.col("content")).alias("ls")), keys, "left")
    span = lambda x: F.when(x["s"].isNotNull(), F.array_join(F.slice(F.col("ls"), x["s"]["start_line"], F.greatest(x["s"]["end_line"] - x["s"]["start_line"] + 1, F.lit(0))), "\n"))
    rows = cut.select(*keys, F.explode(F.transform("asked", lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"), x["s"].alias("s"), span(x).alias("text")))).alias("r"))
    return rows.select("r.ord", *keys, "r.name", "r.s.start_line", "r.s.end_line", "r.text")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """The file's row, or none."""
    return files.where(F.col("path") == path)


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("path") == path).orderBy(*_keys(imports), "ordinal")


def tags_of(tags: DataFrame, path: str) -> DataFrame:
    """(symbol_name, tag) of a file, after repo if there is one."""
    return tags.where(F.col("path") == path).select(*_keys(tags)[:-1], "symbol_name", "tag")


def identifiers_json(imports: DataFrame) -> DataFrame:
    """imports with their identifiers as a JSON list."""
    return imports.withColumn("identifiers", F.to_json("identifiers"))


def read_range(files: DataFrame, path: str, start: float | None, end: float | None) -> DataFrame:
    """(path, start_line, end_line, text): start at least 1, end at least start."""
    a = max(1, int(start or 1))
    b = max(a, int(end or a))
    return files.where(F.col("path") == path).select(*_keys(files), F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), line_slice(F.col("content"), F.lit(a), F.lit(b)).alias("text"))


def context(files: DataFrame, symbols: DataFrame, imports: DataFrame, path: str, name: str) -> DataFrame:
    """The symbol's text, the file's import sources and its outline's names: one row, or one for each repository that has it."""
    keys = _keys(files, symbols, imports)
    spec = files.sparkSession.createDataFrame([(0, path, name)], "ord int, path string, name string")
    one = read_symbols(files, symbols, spec).select(*keys, "name", "text")
    sources = imports.where(F.col("path") == path).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "source"))).alias("i")).select(*keys, F.col("i.source").alias("imports"))
    names = symbols.where(F.col("path") == path).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("o")).select(*keys, F.col("o.name").alias("outline"))
    return one.join(sources, keys, "left").join(names, keys, "left")


def tree(files: DataFrame, prefix: str | None = None, depth: int | None = None) -> DataFrame:
    """Paths in order, those with a prefix if one is given; with a depth, folders of so many parts in the place of what is below."""
    path = F.col("path")
    out = files.where(path.startswith(prefix)) if prefix else files
    if depth:
        parts = F.split(path, "/")
        out = out.withColumn("path", F.when(F.size(parts) > depth, F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/"))).otherwise(path))
        out = out.select(*_keys(files)).distinct()
    return out.select(*_keys(files)).orderBy(*_keys(files))


def status(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: files, symbols, imports, last_indexed (null when there are none)."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("last_indexed"))
    return f.crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(imports.agg(F.count(F.lit(1)).alias("imports")))


def diagnostic(files: DataFrame, symbols: DataFrame, imports: DataFrame, tags: DataFrame) -> DataFrame:
    """(check, value, passed): the seven checks of an index's health and the verdict, which all must pass."""
    has_type = "source_type" in symbols.columns
    code = symbols.where("source_type = 'code'") if has_type else symbols.where(F.lit(False))
    checks = [("files_indexed", files), ("symbols_indexed", symbols), ("code_symbols", code), ("find_symbols_works", code), ("imports_tracked", imports), ("semantic_tags", tags)]
    rows = [d.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("check"), "value", (F.col("value") > 0).alias("passed")) for n, d in checks]
    rows.append(files.sparkSession.range(1).select(F.lit("source_type_column").alias("check"), F.lit(int(has_type)).cast("long").alias("value"), F.lit(has_type).alias("passed")))
    out = reduce(DataFrame.unionByName, rows)
    verdict = out.agg(F.bool_and("passed").alias("passed")).select(F.lit("healthy").alias("check"), F.col("passed").cast("long").alias("value"), "passed")
    return out.unionByName(verdict)


# --- several repositories at once: every table has a column repo ---


def find_symbols_by_repo(symbols: DataFrame, query: str, limit: int | None = None, **filters) -> DataFrame:
    """Each repository's first ``limit`` results, the best first, then by repository and rank in it (column place)."""
    w = Window.partitionBy("repo").orderBy(*rank_order())
    out = symbol_scores(symbols, query, **filters).withColumn("place", F.row_number().over(w))
    out = out.where(F.col("place") <= limit) if limit else out
    return out.orderBy(F.col("score").desc(), "repo", "place")


def find_by_tag_by_repo(tags: DataFrame, symbols: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    """Each repository's first ``limit`` tagged symbols, then the first ``limit`` of all, by repository."""
    out = tags.where(F.col("tag") == tag).join(symbols.withColumnRenamed("ordinal", "symbol_ordinal"), ["repo", "path", "symbol_ordinal"])
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("path", "start_line", "symbol_name")))
    out = out.where(F.col("place") <= limit) if limit else out
    out = out.select("repo", "place", "tag", "symbol_name", "kind", "path", "start_line").orderBy("repo", "place")
    return out.limit(limit) if limit else out


def status_by_repo(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, files, symbols) and a row of totals, whose repo is null."""
    f = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    s = symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"))
    each = f.join(s, "repo", "full").select("repo", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("repo"), F.sum("files").alias("files"), F.sum("symbols").alias("symbols")))


def of_repo(table: DataFrame, repo: str | None) -> DataFrame:
    """One repository's rows, for the reads that name one; none for an unknown name, all without a name."""
    return table if repo is None else table.where(F.col("repo") == repo).drop("repo")


def tree_by_repo(files: DataFrame, repo: str | None = None, prefix: str | None = None) -> DataFrame:
    """(repo, paths in order) of all repositories or of one."""
    rows = files if repo is None else files.where(F.col("repo") == repo)
    rows = rows.where(F.col("path").startswith(prefix)) if prefix else rows
    return rows.groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("paths"))
