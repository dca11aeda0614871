"""Every query of the code-intelligence part by name, and the SQL that checks it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import history, nesting, notes, parse_code, parse_lines, search, tagging, telemetry
from .operators.symbolindex import SymbolIndex
from .operators.textindex import TextIndex
from .plans import languages, store
from .plans.corpora import view, with_views
from .sources import config
from .sources import repo as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

IDENT = "[0-9A-Za-z_]"
TRIM = r"regexp_replace({}, '^[\s\x0B\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+|[\s\x0B\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+$', '', 'g')"


def query(oracle: str | None = None, *views: str):
    """Registers f(spark, sf_dir); oracle reads the views as v_<name>."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = with_views(oracle, *views)
        return f

    return add


def lines_sql(v: str) -> str:
    """path, line, text of a view of files, as the start of a select list's table."""
    return f"(select path, unnest(range(1, len(ls) + 1)) as line, unnest(ls) as text from (select path, string_split(content, chr(10)) as ls from {v}))"


# --- sources, metadata, paths ---


@query("select path, 'text' as language, 'docs' as source_type, md5(content) as hash, cast(strlen(content) as bigint) as size_bytes, cast(len(string_split(content, chr(10))) as bigint) as line_count from v_docs_files", "docs_files")
def file_metadata(spark, d):
    return src.metadata(view(spark, d, "docs_files")).drop("indexed_at")


@query("select path from v_paths where not list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build'])", "paths")
def ignore_filter(spark, d):
    v = view(spark, d, "paths")
    return v.where(~src.is_ignored(F.col("path"))).select("path")


@query(r"select path from v_paths where regexp_extract(path, '[^/](\.[^./]*)$', 1) in ('.js', '.json', '.md', '.vue', '.scss', '.ts')", "paths")
def ext_filter(spark, d):
    v = view(spark, d, "paths")
    return v.where(src.is_supported(F.col("path"))).select("path")


@query(
    """select path, case string_split(path, '.')[-1] when 'js' then 'javascript' when 'json' then 'text' when 'md' then 'text' when 'vue' then 'text' when 'sql' then 'sql'
    when 'py' then 'python' when 'scss' then 'css' when 'rs' then 'rust' else 'unknown' end as language from v_paths""",
    "paths",
)
def detect_language(spark, d):
    return view(spark, d, "paths").select("path", fx.language(F.col("path")).alias("language"))


@query(
    r"""select path, case when base = 'code' and (regexp_matches(path, '\.(test|spec)\.[^.]+$') or list_has_any(string_split(path, '/')[:-2], ['__tests__', '__mocks__', '__fixtures__', 'test', 'tests', 'spec', 'specs', 'mock', 'mocks', 'fixture', 'fixtures']))
    then 'test' else base end as source_type from (select path, case lower(string_split(path, '.')[-1]) when 'json' then 'config' when 'md' then 'docs' when 'vue' then 'markup' when 'sql' then 'query' when 'scss' then 'style' else 'code' end as base from v_paths)""",
    "paths",
)
def source_type(spark, d):
    return view(spark, d, "paths").select("path", fx.source_type(F.col("path")).alias("source_type"))


@query("select path from v_docs_files where starts_with(path, 'src/src1/')", "docs_files")
def tree_prefix(spark, d):
    return search.tree(view(spark, d, "docs_files"), "src/src1/")


@query(r"select page_id, coalesce(nullif(array_to_string(list_filter(list_transform(string_split_regex(url, '[\\/]+'), lambda p: case when regexp_replace(p, '[^A-Za-z0-9._-]', '_', 'g') in ('.', '..') then '_' else regexp_replace(p, '[^A-Za-z0-9._-]', '_', 'g') end), lambda p: p <> ''), '/'), ''), 'global') as safe from pages")
def safe_path(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fx.safe_path(F.col("url")).alias("safe"))


@query("select p_partkey, list_filter(list_transform(string_split_regex(regexp_replace(n, '([A-Z])', ' \\1', 'g'), '[\\s_]+'), lambda w: lower(w)), lambda w: w <> '') as words from (select p_partkey, replace(p_name, ' ', case when p_partkey % 2 = 0 then '_' else 'X' end) as n from part)")
def split_words(spark, d):
    n = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("X")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", fx.split_words(n).alias("words"))


# --- text ---


def _find_text(pattern: str, sensitive: bool) -> str:
    hit = f"contains(text, '{pattern}')" if sensitive else f"contains(lower(text), lower('{pattern}'))"
    return f"select path, cast(line as int) as line, {TRIM.format('text')} as content from {lines_sql('v_docs_files')} where {hit}"


@query(_find_text("The Th", False), "docs_files")
def find_text_ci(spark, d):
    return search.find_text(view(spark, d, "docs_files"), "The Th")


@query(_find_text("The ", True), "docs_files")
def find_text_cs(spark, d):
    return search.find_text(view(spark, d, "docs_files"), "The ", case_sensitive=True)


@query(rf"select path, cast(line as int) as line, {TRIM.format('text')} as content from {lines_sql('v_docs_files')} where regexp_matches(text, '\bment\b')", "docs_files")
def find_references(spark, d):
    return search.find_references(view(spark, d, "docs_files"), "ment")


@query("select path, 2 as start_line, 4 as end_line, array_to_string(string_split(content, chr(10))[2:4], chr(10)) as text from v_code_files where path = 'src/mod_7/part_7.js'", "code_files")
def read_range(spark, d):
    return search.read_range(view(spark, d, "code_files"), "src/mod_7/part_7.js", 2, 4)


# --- parsing ---

CODE_SYMBOLS = """(select path, k, sz, unnest([0, 1, 2, 3]) as ordinal from (select concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path, p_partkey as k, p_size % 6 as sz from part))"""
CODE_ROW = """select path, cast(ordinal as int) as ordinal,
  case ordinal when 0 then concat('load', k) when 1 then concat('GET /p/', k) when 2 then concat('Box', k) else 'area' end as name,
  case ordinal when 0 then 'function' when 1 then 'route' when 2 then 'class' else 'method' end as kind,
  case ordinal when 0 then concat('async function load', k, '(id) {') when 1 then concat('GET /p/', k) when 2 then concat('class Box', k) else 'area(x)' end as signature,
  cast([2, 5, 8, 9][ordinal + 1] as int) as start_line, cast([4, 7, 12, 11][ordinal + 1] as int) as end_line, cast(0 as int) as exported, cast(case when ordinal = 0 then 1 else 0 end as int) as async,
  case when ordinal = 3 then concat('Box', k) end as parent_class from """


def code(spark, d, once: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and imports; scanned once for queries that use the tables more than once."""
    files = view(spark, d, "code_files")
    return files, *parse_code.parse(files, once)


@query(CODE_ROW + CODE_SYMBOLS)
def parse_js(spark, d):
    return code(spark, d, once=False)[1]


@query("select concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path, cast(0 as int) as ordinal, concat('./lib/brand_', p_partkey % 40) as source, ['db'] as identifiers, cast(1 as int) as line from part")
def parse_js_imports(spark, d):
    return code(spark, d, once=False)[2]


def _line_query(name: str, corpus: str, parser, rows: str) -> None:
    """Checks a line parser by rows (id, ordinal, name, kind, signature, line, exported, async) made from supplier ids s."""
    ext = corpus.split("_")[0]
    suffix = {"bash": "sh"}.get(ext, ext)

    def f(spark, d):
        return parser(view(spark, d, corpus))

    f.__name__ = name
    query(
        f"""select concat('conf/', s, '.{suffix}') as path, cast(r.o as int) as ordinal, r.n as name, r.k as kind, r.g as signature, cast(r.l as int) as start_line, cast(r.l as int) as end_line,
        cast(r.e as int) as exported, cast(r.a as int) as async, cast(null as varchar) as parent_class from (select s, unnest([{rows}]) as r from (select cast(s_suppkey as varchar) as s from supplier))"""
    )(f)


def _r(o: int, n: str, k: str, g: str, line: int, e: int = 0, a: int = 0) -> str:
    return f"{{'o': {o}, 'n': {n}, 'k': '{k}', 'g': {g}, 'l': {line}, 'e': {e}, 'a': {a}}}"


_line_query("parse_yaml", "yaml_files", parse_lines.yaml, ", ".join([_r(0, "'key_' || s", "variable", "'key_' || s || ': 1'", 1), _r(1, "'nested-x'", "variable", "'nested-x: 2'", 2)]))
_line_query("parse_json", "json_files", parse_lines.json_keys, _r(0, "'a' || s", "variable", "'\"a' || s || '\": 1, \"b\": 2'", 2))
_line_query("parse_toml", "toml_files", parse_lines.toml, ", ".join([_r(0, "'sec' || s", "class", "'[sec' || s || ']'", 1), _r(1, "'k'", "variable", "'k = 1'", 2), _r(2, "'arr'", "class", "'[[arr]]'", 4)]))
_line_query("parse_css", "css_files", parse_lines.css, ", ".join([_r(0, "'.c' || s", "class", "'.c' || s", 1), _r(1, "'#id'", "class", "'#id'", 3)]))
_line_query("parse_markdown", "md_files", parse_lines.markdown, ", ".join([_r(0, "'Title ' || s", "class", "'# Title ' || s", 1), _r(1, "'Part'", "function", "'##  Part'", 3)]))
_line_query("parse_graphql", "graphql_files", parse_lines.graphql, ", ".join([_r(0, "'T' || s", "class", "'type T' || s || ' {'", 1), _r(1, "'Q'", "function", "'query Q { a }'", 4)]))
_line_query("parse_sql", "sql_files", parse_lines.sql, ", ".join([_r(0, "'t' || s", "class", "'CREATE TABLE t' || s", 2), _r(1, "'v' || s", "function", "'CREATE VIEW v' || s", 1), _r(2, "'w'", "function", "'CREATE VIEW w'", 4)]))
_line_query("parse_bash", "bash_files", parse_lines.bash, ", ".join([_r(0, "'run' || s", "function", "'run' || s || '() {'", 1), _r(1, "'go'", "function", "'function go ( )'", 6)]))
_line_query("parse_vue", "vue_files", parse_lines.components, ", ".join([_r(0, "'f' || s", "function", "'export async function f' || s || '() {'", 3, 1, 1), _r(1, "'g'", "function", "'const g = (x) => x'", 4)]))


@query("select concat('conf/', s_suppkey, '.sh') as path, './lib.sh' as source, cast([] as varchar[]) as identifiers, cast(5 as int) as line from supplier")
def parse_bash_imports(spark, d):
    return parse_lines.bash_imports(view(spark, d, "bash_files"))


@query(
    rf"""select path, cast(row_number() over (partition by path order by line) - 1 as int) as ordinal, lower(regexp_extract(text, '(?i)<(script|style)\b[^>]*>', 1)) as name, 'class' as kind,
    {TRIM.format("text")} as signature, cast(line as int) as start_line, cast(line as int) as end_line, cast(0 as int) as exported, cast(0 as int) as async, cast(null as varchar) as parent_class
    from {lines_sql("v_pages_files")} where regexp_matches(text, '(?i)<(script|style)\b[^>]*>')""",
    "pages_files",
)
def parse_html(spark, d):
    return parse_lines.markup(view(spark, d, "pages_files"))


def _language_queries(lang: str) -> None:
    """Symbols and imports of files in one language, in several shapes."""

    def symbols(spark, d):
        return parse_code.parse(view(spark, d, f"{lang}_files"))[0]

    def imports(spark, d):
        return parse_code.parse(view(spark, d, f"{lang}_files"))[1]

    for k, (f, what) in enumerate(((symbols, "symbols"), (imports, "imports")), 1):
        if not any(shape[k] for shape in languages.SHAPES[lang][1]):
            continue
        f.__name__ = f"parse_{lang}_{what}"
        query(languages.expected_sql(lang, what))(f)


for _lang in languages.SHAPES:
    _language_queries(_lang)


# --- tags ---

TAG_LISTS = """[['async', 'db_read', 'tenant_scoped', 'no_error_handling'], ['async', 'db_read', 'unscoped_query', 'no_error_handling'], ['async', 'db_write', 'unscoped_query', 'error_handler'],
  ['async', 'no_error_handling'], ['async', 'validated'], ['async', 'auth']]"""
TAGS_SQL = f"""(select path, cast(ordinal as int) as symbol_ordinal, case when ordinal = 0 then concat('load', k) else concat('GET /p/', k) end as symbol_name,
  unnest(case when ordinal = 0 then {TAG_LISTS}[sz + 1] else ['route_handler'] end) as tag from {CODE_SYMBOLS} where ordinal < 2)"""


@query(f"select * from {TAGS_SQL}")
def tag_symbols(spark, d):
    return parse_code.parse_tagged(view(spark, d, "code_files"))[2]


@query(f"select tag, count(*) as n from {TAGS_SQL} group by tag")
def tag_counts(spark, d):
    files, symbols, _ = code(spark, d)
    return tagging.tag_symbols(files, symbols).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("select concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path, cast(5 as int) as line, cast(1 as int) as ordinal, concat('GET /p/', p_partkey) as name from part")
def route_innermost(spark, d):
    files, symbols, _ = code(spark, d)
    return tagging.route_lines(files, symbols)


@query("select concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path, 'route_handler' as tag, 'GET route' as name, cast(5 as int) as line from part")
def source_tags(spark, d):
    return tagging.source_tags(view(spark, d, "code_files"))


@query(f"select * from (select tag, symbol_name, 'function' as kind, concat('async function ', symbol_name, '(id) {{') as signature, cast(2 as int) as start_line, cast(4 as int) as end_line, path from {TAGS_SQL} where tag = 'db_write') order by path, start_line limit 25")
def find_by_tag(spark, d):
    files, symbols, _ = code(spark, d)
    return search.find_by_tag(tagging.tag_symbols(files, symbols), symbols, "db_write", 25)


@query(
    """select concat('twin/f', s_suppkey, '.js') as path, cast(0 as int) as symbol_ordinal, concat('twin', s_suppkey) as symbol_name, unnest(['async', 'db_write', 'unscoped_query', 'error_handler']) as tag from supplier"""
)
def tag_collision(spark, d):
    """Two functions of one name in a file: the last one's tags, at the first one's place."""
    files = view(spark, d, "twin_files")
    return tagging.tag_symbols(files, parse_code.parse(files, once=True)[0])


@query("""select concat('twin/f', s_suppkey, '.js') as path, 'exported' as tag, unnest([concat('twin', s_suppkey), 'other', 'one']) as name, cast(null as int) as line from supplier""")
def exported_names(spark, d):
    return tagging.source_tags(view(spark, d, "twin_files"))


@query(
    """select concat('lang/f', p_partkey, '.js') as path, cast(r.o as int) as ordinal, cast(r.c as int) as child from (select p_partkey, unnest(case p_partkey % 3 when 1 then [{'o': 0, 'c': 1}, {'o': 0, 'c': 3}, {'o': 1, 'c': 2}]
    when 2 then [{'o': 0, 'c': 1}] else cast([] as struct(o int, c int)[]) end) as r from part)"""
)
def symbol_children(spark, d):
    return parse_code.children(view(spark, d, "javascript_files"))


_DEEP = "select path, p_partkey as k, p_size % 4 as deep from (select *, concat('deep/f', p_partkey, '.js') as path from part)"
_DEEP_SYMBOLS = f"(select path, deep, unnest(range(0, deep + 2)) as o from ({_DEEP}))"


@query(
    f"""+s as (select path, cast(o as int) as ordinal, cast(case when o = deep + 1 then 1 + 2 * deep + 2 else o + 1 end as int) as a, cast(case when o = deep + 1 then 1 + 2 * deep + 2 else 2 * deep + 1 - o + 1 end as int) as b from {_DEEP_SYMBOLS}),
    up as (select s.path, s.ordinal, max(p.ordinal) as parent from s join s p on s.path = p.path and p.a <= s.a and p.b >= s.b and p.ordinal < s.ordinal group by all),
    tree as (select path, ordinal, parent as ancestor, 1 as depth from up union all select t.path, t.ordinal, u.parent, t.depth + 1 from tree t join up u on u.path = t.path and u.ordinal = t.ancestor)
    select path, ordinal, ancestor, cast(depth as int) as depth from tree""".replace("+s as", "with recursive s as", 1)
)
def symbol_ancestors(spark, d):
    """Functions in functions, up to five deep, and one beside them; the SQL climbs from parent to parent."""
    return nesting.ancestors(parse_code.parse(view(spark, d, "deep_files"), once=True)[0])


@query(f"select path, case when o = deep + 1 then 'last' else concat('f', o, '_', deep) end as name, cast(o as int) as depth, cast(o as int) as ordinal, cast(0 as int) as of from {_DEEP_SYMBOLS} where o between 1 and deep and deep = 3")
def symbol_descendants(spark, d):
    return nesting.descendants(parse_code.parse(view(spark, d, "deep_files"), once=True)[0], "f0_3")


@query("select path, ordinal, source, to_json(identifiers)::varchar as identifiers, line from (" + languages.expected_sql("javascript", "imports") + ")")
def identifiers_json(spark, d):
    return search.identifiers_json(parse_code.parse(view(spark, d, "javascript_files"))[1])


# --- search ---


def _find(q: str, words: list[str], where: str, long: list[str]) -> str:
    likes = " or ".join(f"name like '%{w}%'" for w in [q, *long])
    bonus = " + ".join(f"(case when list_contains(ws, '{w}') then 25 else 0 end)" for w in words)
    return f"""select path, ordinal, name, kind, score from (select *, (case when name = '{q}' then 100 when starts_with(name, '{q}') then 75 when contains(name, '{q}') then 50 else 0 end)
      + (case when starts_with(path, 'src/') then 5 else 0 end) + {bonus} as score from (select *, string_split(name, '_') as ws from v_symbols) where ({likes}) and {where})"""


CODE_OR_QUERY = "source_type in ('code', 'query')"
SHOWN = ["path", "ordinal", "name", "kind", "score"]


@query(_find("red_plate", ["red", "plate"], CODE_OR_QUERY, ["red", "plate"]), "symbols")
def find_symbol_exact(spark, d):
    return search.find_symbols(view(spark, d, "symbols"), "red_plate").select(*SHOWN)


@query(_find("hot", ["hot"], CODE_OR_QUERY + " and kind = 'function' and exported = 1", ["hot"]), "symbols")
def find_symbol_prefix(spark, d):
    return search.find_symbols(view(spark, d, "symbols"), "hot", kind="function", exported_only=True).select(*SHOWN)


@query(_find("old rod", ["old", "rod"], "source_type = 'config'", ["old", "rod"]), "symbols")
def find_symbol_multiword(spark, d):
    return search.find_symbols(view(spark, d, "symbols"), "old rod", source_types=["config"]).select(*SHOWN)


@query(_find("blueR", ["blue", "r"], "true", ["blue"]).replace("like '%blueR%'", "like '%bluer%'").replace("name = 'blueR'", "name = 'bluer'").replace("'blueR')", "'bluer')"), "symbols")
def find_symbol_camel(spark, d):
    return search.find_symbols(view(spark, d, "symbols"), "blueR", source_types=[]).select(*SHOWN)


@query(_find("hot_ring", ["hot", "ring"], CODE_OR_QUERY, ["hot", "ring"]) + " order by score desc, name, path, ordinal limit 20", "symbols")
def find_symbol_limit(spark, d):
    return search.find_symbols(view(spark, d, "symbols"), "hot_ring", limit=20).select(*SHOWN)


@query("select distinct concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path from part where p_partkey % 40 = 3")
def find_importers(spark, d):
    return search.find_importers(code(spark, d, once=False)[2], "src/lib/brand_3.js")


@query("select concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as importer, concat('src/lib/brand_', p_partkey % 40, '.js') as target from part")
def import_graph(spark, d):
    return search.import_graph(code(spark, d, once=False)[2], view(spark, d, "lib_files"))


@query("select concat('src/lib/brand_', p_partkey % 40, '.js') as target, count(*) as n from part group by 1")
def importer_fan_in(spark, d):
    return search.import_graph(code(spark, d, once=False)[2], view(spark, d, "lib_files")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(CODE_ROW + CODE_SYMBOLS + " where path = 'src/mod_9/part_9.js'")
def outline(spark, d):
    return search.outline(code(spark, d, once=False)[1], "src/mod_9/part_9.js")


@query("select path, cast(ordinal as int) as ordinal, name, kind, case when kind = 'class' then ['area'] else cast([] as varchar[]) end as children from (" + CODE_ROW + CODE_SYMBOLS + ") where ordinal < 3")
def outline_nested(spark, d):
    return search.outline_nested(code(spark, d)[1])


@query(
    """select cast(p_partkey as bigint) as ord, concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js') as path, case when p_size % 2 = 0 then 'area' else 'none' end as name, cast(case when p_size % 2 = 0 then 9 else 0 end as int) as start_line,
    cast(case when p_size % 2 = 0 then 11 else 0 end as int) as end_line, case when p_size % 2 = 0 then concat('  area(x) {', chr(10), '    return x;', chr(10), '  }') end as text from part"""
)
def read_symbols_batch(spark, d):
    files, symbols, _ = code(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet")
    specs = part.select(F.col("p_partkey").alias("ord"), F.expr("concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js')").alias("path"), F.expr("if(p_size % 2 = 0, 'area', 'none')").alias("name"))
    return search.read_symbols(files, symbols, specs).fillna(0, ["start_line", "end_line"])


@query("select 'src/mod_9/part_9.js' as path, 'Box9' as name, concat('class Box9 {', chr(10), '  area(x) {', chr(10), '    return x;', chr(10), '  }', chr(10), '}') as text, ['./lib/brand_9'] as imports, ['load9', 'GET /p/9', 'Box9', 'area'] as outline")
def symbol_context(spark, d):
    return search.context(*code(spark, d), "src/mod_9/part_9.js", "Box9")


@query("select count(*) as files, timestamp '2026-01-01 00:00:00' as last_indexed, 4 * count(*) as symbols, count(*) as imports from part")
def index_stats(spark, d):
    files, symbols, imports = code(spark, d)
    return search.status(src.metadata(files, "2026-01-01 00:00:00"), symbols, imports)


@query("select unnest(['files_indexed', 'symbols_indexed', 'code_symbols', 'find_symbols_works', 'imports_tracked', 'semantic_tags', 'source_type_column', 'healthy']) as \"check\", unnest([n, 4 * n, 4 * n, 4 * n, n, t, 1, 1]) as value, true as passed from (select (select count(*) from part) as n, (select count(*) from " + TAGS_SQL + ") as t)")
def diagnostic(spark, d):
    files, symbols, imports = code(spark, d)
    tags = tagging.tag_symbols(files, symbols)
    return search.diagnostic(src.metadata(files), symbols.withColumn("source_type", fx.source_type(F.col("path"))), imports, tags)


# --- search over postings ---


def _either(*sql: str) -> str:
    return " union all ".join(f"select '{k}' as asked, * from ({s})" for k, s in enumerate(sql))


@query(_either(_find_text("The Th", False), _find_text("The ", True), _find_text("é", False), rf"select path, cast(line as int) as line, {TRIM.format('text')} as content from {lines_sql('v_docs_files')} where regexp_matches(text, '\bment\b')"), "docs_files")
def text_index_search(spark, d):
    """The same lines as by a scan: a pattern in any case, one in its case, one too short for the index, an identifier."""
    index = TextIndex.build(view(spark, d, "docs_files"))
    found = [index.find_text("The Th"), index.find_text("The ", case_sensitive=True), index.find_text("é"), index.find_references("ment")]
    return reduce(DataFrame.unionByName, [f.select(F.lit(str(k)).alias("asked"), "*") for k, f in enumerate(found)])


@query(_either(f"select * from ({_find('hot_ring', ['hot', 'ring'], CODE_OR_QUERY, ['hot', 'ring'])}) order by score desc, name, path, ordinal limit 20", f"select * from ({_find('red_plate', ['red', 'plate'], CODE_OR_QUERY, ['red', 'plate'])})"), "symbols")
def symbol_index_search(spark, d):
    index = SymbolIndex.build(view(spark, d, "symbols"))
    found = [index.find_symbols("hot_ring", limit=20), index.find_symbols("red_plate")]
    return reduce(DataFrame.unionByName, [f.select(F.lit(str(k)).alias("asked"), *SHOWN) for k, f in enumerate(found)])


# --- several repositories ---


@query(
    "select repo, place, path, ordinal, name, score from (select *, cast(row_number() over (partition by repo order by score desc, name, path, ordinal) as int) as place from (" + _find("red_plate", ["red", "plate"], CODE_OR_QUERY, ["red", "plate"]).replace("select path,", "select repo, path,", 1) + ")) where place <= 5",
    "symbols",
)
def multirepo_search(spark, d):
    return search.find_symbols_by_repo(view(spark, d, "symbols"), "red_plate", 5).select("repo", "place", "path", "ordinal", "name", "score")


def by_repo(df: DataFrame) -> DataFrame:
    """Code files and what comes of them, dealt to four repositories by the number in their path."""
    return df.withColumn("repo", F.concat(F.lit("repo"), (F.regexp_extract("path", r"part_(\d+)", 1).cast("int") % 4).cast("string")))


REPO = "concat('repo', cast(regexp_extract(path, 'part_([0-9]+)', 1) as int) % 4)"


@query(
    f"""select repo, cast(place as int) as place, tag, symbol_name, 'function' as kind, path, cast(2 as int) as start_line from (select *, row_number() over (partition by repo order by path) as place from (select *, {REPO} as repo from {TAGS_SQL} where tag = 'db_write'))
    where place <= 7 order by repo, place limit 7"""
)
def multirepo_tags(spark, d):
    files, symbols, _ = code(spark, d)
    return search.find_by_tag_by_repo(by_repo(tagging.tag_symbols(files, symbols)), by_repo(symbols), "db_write", 7)


@query(f"select {REPO} as repo, path, cast(line as int) as line, {TRIM.format('text')} as content from {lines_sql('v_code_files')} where contains(lower(text), 'db.insert')", "code_files")
def multirepo_text(spark, d):
    return search.find_text(by_repo(view(spark, d, "code_files")), "DB.insert")


@query(f"select {REPO} as repo, list(path order by path) as paths from v_code_files where starts_with(path, 'src/mod_1') group by 1", "code_files")
def multirepo_tree(spark, d):
    return search.tree_by_repo(by_repo(view(spark, d, "code_files")), prefix="src/mod_1")


@query(f"select * from ({CODE_ROW} {CODE_SYMBOLS}) where path = 'src/mod_9/part_9.js' and {REPO} = 'repo1'")
def multirepo_outline(spark, d):
    """A read that names a repository; the other three have no such file."""
    symbols = by_repo(code(spark, d, once=False)[1])
    found = [search.outline(search.of_repo(symbols, r), "src/mod_9/part_9.js") for r in ("repo1", "repo2", "unknown")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def repos(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, symbols, imports and tags of two repositories that hold the same paths, each indexed by itself."""
    out = []
    for name in ("repo0", "repo1"):
        files = view(spark, d, "repo_files").where(F.col("repo") == name).drop("repo")
        symbols, imports = parse_code.parse(files, once=True)
        out.append([t.withColumn("repo", F.lit(name)) for t in (files, symbols, imports, tagging.tag_symbols(files, symbols))])
    return tuple(a.unionByName(b) for a, b in zip(*out, strict=True))


_TWIN = "(select concat('repo', p_partkey % 2) as repo, p_partkey as k, concat('src/f', p_partkey // 2, '.js') as path, p_partkey % 2 as more from part)"
_LOAD = "concat('async function load(id) {{ return pool.query(''SELECT ', k, '''); }}')".replace("{{", "{").replace("}}", "}")


@query(f"select repo, 'db_read' as tag, 'load' as symbol_name, 'function' as kind, {_LOAD} as signature, cast(2 + more as int) as start_line, cast(2 + more as int) as end_line, path from {_TWIN}")
def equal_paths_by_tag(spark, d):
    """Equal paths and names in two repositories: each tag meets its own repository's symbol."""
    _, symbols, _, tags = repos(spark, d)
    return search.find_by_tag(tags, symbols, "db_read")


@query(
    f"""select ord, repo, path, name, cast(case when name = 'load' then 2 + more when name = 'none' then null else 3 + more end as int) as start_line, cast(case when name = 'load' then 2 + more when name = 'none' then null else 3 + more end as int) as end_line,
    case when name = 'load' then {_LOAD} when name <> 'none' then concat('function own', k, '() {{ return 1; }}') end as text from (
    select k as ord, repo, path, k, more, 'load' as name from {_TWIN} union all select ord, r.repo, r.path, k, more, 'load' from (select cast(k + 1000000 as bigint) as ord, path from {_TWIN} where more = 0) s join {_TWIN} r on r.path = s.path
    union all select k + 2000000, repo, path, k, more, concat('own', k) from {_TWIN} union all select k + 3000000, repo, path, k, more, 'none' from {_TWIN})""".replace("{{", "{").replace("}}", "}")
)
def equal_paths_read(spark, d):
    """Specs that name a repository get its symbol or nulls; those that name none get a row for each repository that has it."""
    files, symbols, _, _ = repos(spark, d)
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{d}/part.parquet").select(k, F.expr("concat('repo', p_partkey % 2)").alias("repo"), F.expr("concat('src/f', p_partkey div 2, '.js')").alias("path"))
    own = F.concat(F.lit("own"), k.cast("string"))
    named = [part.select((k + n).alias("ord"), "repo", "path", name.alias("name")) for n, name in ((0, F.lit("load")), (2_000_000, own), (3_000_000, F.lit("none")))]
    named = search.read_symbols(files, symbols, named[0].unionByName(named[1]).unionByName(named[2]))
    free = part.where(k % 2 == 0).select((k + 1_000_000).alias("ord"), "path", F.lit("load").alias("name"))
    return named.unionByName(search.read_symbols(files, symbols, free))


@query(f"select repo, path, 'load' as name, {_LOAD} as text, [concat('./f', k // 2 + 1)] as imports, ['load', concat('own', k)] as outline from {_TWIN} where path = 'src/f7.js'")
def equal_paths_context(spark, d):
    files, symbols, imports, _ = repos(spark, d)
    return search.context(files, symbols, imports, "src/f7.js", "load")


@query(f"select a.repo, a.path as importer, b.path as target from {_TWIN} a join {_TWIN} b on a.repo = b.repo and b.k // 2 = a.k // 2 + 1")
def equal_paths_graph(spark, d):
    """Imports within each repository."""
    files, _, imports, _ = repos(spark, d)
    return search.import_graph(imports, files)


@query("select distinct concat('src/', string_split(path, '/')[2], '/') as path from v_code_files", "code_files")
def tree_depth(spark, d):
    return search.tree(view(spark, d, "code_files"), depth=2)


@query("select repo, count(distinct path) as files, count(*) as symbols from v_symbols group by repo union all select null, cast(sum(f) as bigint), cast(sum(s) as bigint) from (select count(distinct path) as f, count(*) as s from v_symbols group by repo)", "symbols")
def multirepo_status(spark, d):
    s = view(spark, d, "symbols")
    return search.status_by_repo(s.select("repo", "path").distinct(), s)


# --- history ---

AS_OF = dt.date(2001, 8, 1)


@query(
    """select file, edit_count, bug_fix_count, edit_count + 2 * bug_fix_count as score from (select file, count(*) as edit_count, count(*) filter (where message = 'Fix order') as bug_fix_count, min(seq) as seq
    from v_commits join v_commit_files using (hash) where date >= date '2001-08-01' - 400 group by file) order by score desc, seq, file limit 20""",
    "commits", "commit_files",
)
def hotspots(spark, d):
    return history.hotspots(view(spark, d, "commits"), view(spark, d, "commit_files"), 400, 20, AS_OF)


@query("select hash, message, date, author, email from v_commits where hash in (select hash from v_commit_files where file = 'src/part_11.js') order by seq limit 15", "commits", "commit_files")
def git_log(spark, d):
    return history.log(view(spark, d, "commits"), view(spark, d, "commit_files"), "src/part_11.js", 15)


@query(
    """select id, cast(l as int) as line, concat(md5(id), '00000000') as hash, case when l = 1 then concat('A', id) end as author, cast(case when l = 1 then 17 else 0 end as bigint) as timestamp, case when l = 1 then 'S' end as summary,
    case when l = 1 then 'first' else 'author x' end as content from (select cast(s_suppkey as varchar) as id, unnest([1, 2]) as l from supplier)"""
)
def blame_lines(spark, d):
    return history.blame(view(spark, d, "blames")).fillna(0, ["timestamp"])


@query("select id, concat('x', s % 9, '.js') as file, cast(unnest([s % 5 + 1, s % 5 + 2, s % 5 + 3, 20]) as int) as line from (select cast(s_suppkey as varchar) as id, s_suppkey as s from supplier)")
def diff_lines(spark, d):
    return history.diff_lines(view(spark, d, "diffs"))


# --- notes ---


def noted(spark, d) -> DataFrame:
    return view(spark, d, "notes_csv").select("seq", "target", "note", "author", F.split("tags_csv", ",").alias("tags"), "timestamp")


NOTES = "(select seq, target, note, author, string_split(tags_csv, ',') as tags, timestamp from v_notes_csv)"


@query(f"select * from {NOTES} where target in ('src/conv_3.js:fn', 'src/conv_3.js')", "notes_csv")
def recall(spark, d):
    return notes.recall(noted(spark, d), "src/conv_3.js:fn")


@query(f"select * from {NOTES} where starts_with(target, 'src/conv_1') and list_contains(tags, 'pattern')", "notes_csv")
def patterns(spark, d):
    return notes.patterns(noted(spark, d), "src/conv_1")


@query(f"select * from {NOTES} where list_contains(tags, 'lesson') and list_contains(tags, 'handover')", "notes_csv")
def lessons(spark, d):
    return notes.lessons(noted(spark, d), "handover")


@query("select conv_id as id, cast(2 as int) + 0 as n, concat('keep src/lib/a', conv_id, '.js small') as text, concat('src/lib/a', conv_id, '.js') as target from (select distinct conv_id from conversations) where conv_id % 3 < 2")
def extract_lessons(spark, d):
    return notes.extract_lessons(view(spark, d, "handovers"))


@query(
    f"""with n as (select * from {NOTES}) select 'total' as "group", 'notes' as key, count(*) as n from n union all select 'tag', t, count(*) from (select unnest(tags) as t from n) group by t
    union all select 'author', author, count(*) from n group by author union all select 'target', target, count(*) from n group by target""".replace("with n as", "+n as", 1),
    "notes_csv",
)
def learning_report(spark, d):
    return notes.report(noted(spark, d))


# --- telemetry ---


@query("select seq, tool, file_tokens, response_tokens, greatest(0, file_tokens - response_tokens) as tokens_saved from v_calls", "calls")
def token_savings(spark, d):
    return telemetry.savings(view(spark, d, "calls")).select("seq", "tool", "file_tokens", "response_tokens", "tokens_saved")


@query("select tool, count(*) as calls, cast(sum(greatest(0, file_tokens - response_tokens)) as bigint) as tokens_saved from v_calls group by tool", "calls")
def telemetry_by_tool(spark, d):
    return telemetry.by_tool(view(spark, d, "calls"))


@query(
    """select count(*) as total_queries, cast(sum(s) as bigint) as total_tokens_saved, cast(floor(sum(s) / count(*) + 0.5) as bigint) as average_tokens_saved,
    cast(sum((s * 150 + 500) // 1000) as double) / 10000 as total_cost_large, cast(sum((s * 30 + 500) // 1000) as double) / 10000 as total_cost_medium, cast(sum((s * 8 + 500) // 1000) as double) / 10000 as total_cost_small from (select seq, greatest(0, file_tokens - response_tokens) as s from v_calls)""",
    "calls",
)
def telemetry_report(spark, d):
    return telemetry.report(view(spark, d, "calls"))


@query(ORACLE_SQL["telemetry_report"])
def telemetry_advance(spark, d):
    """Totals that are kept by part of the log while calls come in three lots, out of order."""
    calls, parts = view(spark, d, "calls"), None
    for lot in (2, 0, 1):
        parts = telemetry.advance(parts, calls.where(F.col("seq") % 3 == lot), 1000)
    return telemetry.report_of(parts)


@query("select p_partkey as call, cast(ceil(strlen(content) / 4) as bigint) as file_tokens from (select p_partkey, (select any_value(content) from v_code_files where path = concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js')) as content from part)", "code_files")
def file_baseline(spark, d):
    files = view(spark, d, "code_files")
    results = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("call"), F.expr("concat('src/mod_', p_partkey % 50, '/part_', p_partkey, '.js')").alias("path"))
    return telemetry.baseline(results.unionAll(results), src.metadata(files))


# --- maintenance ---


@query(
    """select coalesce(a.path, b.path) as path, case when b.path is null then 'add' when a.path is null then 'unlink' else 'change' end as change from v_disk a full join v_stored b on a.path = b.path
    where a.path is null or b.path is null or a.hash <> b.hash""",
    "disk", "stored",
)
def change_diff(spark, d):
    return store.changes(view(spark, d, "disk"), view(spark, d, "stored"))


@query(ORACLE_SQL["change_diff"])
def change_diff_digests(spark, d):
    """The same changes, by digests of ranges of paths; only what lies in differing ranges is joined."""
    return store.changes_by_digest(view(spark, d, "disk"), view(spark, d, "stored"))


@query("select path, hash from v_disk where not exists (select 1 from v_stored s where s.path = v_disk.path and s.hash = v_disk.hash)", "disk", "stored")
def dedupe_by_hash(spark, d):
    return store.fresh(view(spark, d, "disk"), view(spark, d, "stored"))


@query("select path, hash from v_stored where path not in (select path from v_disk) union all select path, hash from v_disk", "disk", "stored")
def upsert_snapshot(spark, d):
    new = view(spark, d, "disk")
    return store.replaced(view(spark, d, "stored"), new, new.select("path"))


@query("select path, ordinal, name from v_symbols where path not like 'src/%'", "symbols")
def cascade_delete(spark, d):
    s = view(spark, d, "symbols").select("path", "ordinal", "name")
    return store.replaced(s, s.limit(0), s.where(F.col("path").startswith("src/")).select("path").distinct())


OLD_SYMBOLS = "path string, ordinal int, name string, kind string, exported int, source_type string"


@query("select path, ordinal, name, kind, exported, 'code' as source_type from v_symbols", "symbols")
def migrate_symbols(spark, d):
    """Rows of a table that was written before source_type was there."""
    return store.migrated(view(spark, d, "symbols").drop("source_type"), OLD_SYMBOLS, {"source_type": F.lit("code")})


@query("select path, 'text' as language, 'docs' as source_type, md5(content) as hash from v_docs_files where path = (select min(path) from v_docs_files)", "docs_files")
def file_lookup(spark, d):
    files = view(spark, d, "docs_files")
    return search.file_by_path(src.metadata(files), files.agg(F.min("path")).first()[0]).select("path", "language", "source_type", "hash")


@query("select 'src/mod_9/part_9.js' as path, cast(0 as int) as ordinal, './lib/brand_9' as source, ['db'] as identifiers, cast(1 as int) as line")
def imports_lookup(spark, d):
    return search.imports_of(code(spark, d, once=False)[2], "src/mod_9/part_9.js")


@query(f"select symbol_name, tag from {TAGS_SQL} where path = 'src/mod_9/part_9.js'")
def tags_lookup(spark, d):
    files, symbols, _ = code(spark, d)
    return search.tags_of(tagging.tag_symbols(files, symbols), "src/mod_9/part_9.js")


# --- what a result tells of its query ---

_COSTS = {"large": "150", "medium": "30", "small": "8"}
_UNITS = {k: f"((s * {p} + 500) // 1000)" for k, p in _COSTS.items()}


@query(
    "select seq, tool, timing_ms, file_tokens, response_tokens, s as tokens_saved, cast(count(*) over w as bigint) as total_queries, case when s is not null then cast(sum(coalesce(s, 0)) over w as bigint) end as total_tokens_saved, case when s is not null then 'byte_approx' end as estimate_method, "
    + ", ".join(f"cast({u} as double) / 10000 as cost_{k}, case when s is not null then cast(sum(coalesce({u}, 0)) over w as double) / 10000 end as total_cost_{k}" for k, u in _UNITS.items())
    + " from (select *, greatest(0, file_tokens - response_tokens) as s from (select seq, tool, seq % 97 / 10 as timing_ms, case when tool <> 'view' then file_tokens end as file_tokens, case when tool <> 'view' then response_tokens end as response_tokens from v_calls)"
    " where true) window w as (order by seq rows unbounded preceding)".replace("greatest(0, file_tokens - response_tokens)", "case when file_tokens is not null then greatest(0, file_tokens - response_tokens) end"),
    "calls",
)
def telemetry_meta(spark, d):
    """Views are told their time only."""
    calls = view(spark, d, "calls")
    some = [F.when(F.col("tool") != "view", F.col(c)).alias(c) for c in ("file_tokens", "response_tokens")]
    return telemetry.meta(calls.select("seq", "tool", (F.col("seq") % 97 / 10).alias("timing_ms"), *some))


# --- notes, once more ---


@query(f"select * from (select * from {NOTES} where list_contains(tags, 'lesson') order by seq desc limit 10) order by seq", "notes_csv")
def recent_lessons(spark, d):
    return notes.recent_lessons(noted(spark, d))


@query(
    f"""select target, concat('## ', target, chr(10), chr(10), string_agg(concat('### ', timestamp, ' - ', array_to_string(tags, ', '), chr(10), chr(10), note, chr(10)), chr(10) order by seq)) as page from {NOTES} where seq > 5 group by target""",
    "notes_csv",
)
def vault_pages(spark, d):
    return notes.vault_pages(noted(spark, d), 5)


@query("select seq, regexp_replace(regexp_replace(target, '[/:.]', '-', 'g'), '-+', '-', 'g') as name from v_notes_csv", "notes_csv")
def note_slugs(spark, d):
    return noted(spark, d).select("seq", fx.slug(F.col("target")).alias("name"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') as at from orders")
def iso_times(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fx.iso(F.col("o_orderdate")).alias("at"))


@query("select 'python' as command, ['-m', 'lodestone.tools', '/repo'] as args, '{}' as env")
def worker_config(spark, d):
    w = config.worker("/repo")
    return spark.range(1).select(F.lit(w["command"]).alias("command"), F.array(*[F.lit(a) for a in w["args"]]).alias("args"), F.lit(str(w["env"])).alias("env"))


@query(
    """select distinct file, cast(s_suppkey as int) as ordinal, concat('n', s_suppkey) as name from (select concat('x', s_suppkey % 9, '.js') as file, unnest([s_suppkey % 5 + 1, s_suppkey % 5 + 2, s_suppkey % 5 + 3, 20]) as line from supplier)
    join (select s_suppkey, concat('x', s_suppkey % 9, '.js') as path, s_suppkey % 20 as a from supplier) on path = file where a <= line and a + 2 >= line"""
)
def changed_symbols(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    first = (F.col("s_suppkey") % 20).cast("int")
    symbols = s.select(F.concat(F.lit("x"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".js")).alias("path"), F.col("s_suppkey").cast("int").alias("ordinal"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"), first.alias("start_line"), (first + 2).alias("end_line"))
    return history.changed_symbols(history.diff_lines(view(spark, d, "diffs")), symbols)
