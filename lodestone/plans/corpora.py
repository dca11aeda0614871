"""Virtual corpora over the driver's tables, in SQL that both engines read: the same text on both sides of a check.

Braces of the generated code are doubled, for the strings are formats: {part} and so on are tables.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.session import stored
from . import languages

BODY = """case p_size % 6
  when 0 then 'return pool.query(''SELECT 1 WHERE tenant_id = 1'');' when 1 then 'return pool.query(''SELECT 2'');'
  when 2 then 'try {{ db.insert(id); }} catch (e) {{ }}' when 3 then 'await fetch(id);' when 4 then 'return validate(id);'
  else 'return authenticate(id);' end"""


def _lines(*parts: str) -> str:
    return "concat(" + ", chr(10), ".join(parts) + ")"


_CODE_PATH = "concat('src/mod_', cast(p_partkey % 50 as string), '/part_', cast(p_partkey as string), '.js')"
_K = "cast(p_partkey as string)"
_S = "cast(s_suppkey as string)"

CORPORA: dict[str, str] = {
    "docs_files": "select concat('src/', source, '/', lang, '_', cast(doc_id as string), '.md') as path, text as content from {documents}",
    "pages_files": "select concat('web/', cast(page_id as string), '.html') as path, html as content from {pages}",
    "code_files": f"select {_CODE_PATH} as path, "
    + _lines(
        "concat('const db = require(''./lib/brand_', cast(p_partkey % 40 as string), ''');')",
        f"concat('async function load', {_K}, '(id) {{{{')",
        f"concat('  ', {BODY})",
        "'}}'",
        f"concat('router.get(''/p/', {_K}, ''', (req, res) => {{{{')",
        "'  res.send(1);'",
        "'}});'",
        f"concat('class Box', {_K}, ' {{{{')",
        "'  area(x) {{'",
        "'    return x;'",
        "'  }}'",
        "'}}'",
        "''",
    )
    + " as content from {part}",
    "lib_files": "select distinct concat('src/lib/brand_', cast(p_partkey % 40 as string), '.js') as path from {part}",
    "symbols": """select concat(case when p_partkey % 3 = 0 then 'src/' else 'lib/' end, 'f', cast(p_partkey % 97 as string), '.js') as path,
  cast(p_partkey as int) as ordinal, case when p_partkey % 4 = 0 then replace(p_name, ' ', '') else replace(p_name, ' ', '_') end as name,
  case p_size % 3 when 0 then 'function' when 1 then 'class' else 'method' end as kind, cast(p_size % 2 as int) as exported,
  case p_size % 5 when 0 then 'code' when 1 then 'code' when 2 then 'query' when 3 then 'config' else 'test' end as source_type,
  concat('repo', cast(p_partkey % 4 as string)) as repo from {part}""",
    "paths": """select concat(case p_partkey % 12 when 0 then 'src/a' when 1 then 'tests/a' when 2 then 'src/__mocks__/a' when 3 then 'node_modules/x/a' when 4 then 'lib/dist/a'
  when 5 then 'spec/a' when 6 then 'src/a.test' when 7 then 'src/a.spec' when 8 then 'fixtures/x/a' when 9 then 'src/build/a' when 10 then 'contest/a' else 'a' end,
  case when p_partkey % 12 in (6, 7) then '' else cast(p_partkey as string) end,
  case p_size % 11 when 0 then '.js' when 1 then '.TS' when 2 then '.json' when 3 then '.JSON' when 4 then '.md' when 5 then '.vue' when 6 then '.sql' when 7 then '.py'
  when 8 then '' when 9 then '.scss' else '.rs' end) as path, p_partkey from {part}""",
    "twin_files": f"select concat('twin/f', {_S}, '.js') as path, "
    + _lines(
        f"concat('function twin', {_S}, '(id) {{{{')",
        "'  await fetch(id);'",
        "'}}'",
        f"concat('async function twin', {_S}, '(id) {{{{')",
        "'  try {{ db.insert(id); }} catch (e) {{ }}'",
        "'}}'",
        f"concat('module.exports = {{{{ twin', {_S}, ', other }}}};')",
        "'exports.one = 1;'",
    )
    + " as content from {supplier}",
    "repo_files": "select concat('repo', cast(p_partkey % 2 as string)) as repo, concat('src/f', cast(cast(floor(p_partkey / 2) as bigint) as string), '.js') as path, concat(case when p_partkey % 2 = 1 then concat('// note', chr(10)) else '' end, "
    + _lines(
        "concat('const x = require(''./f', cast(cast(floor(p_partkey / 2) as bigint) + 1 as string), ''');')",
        f"concat('async function load(id) {{{{ return pool.query(''SELECT ', {_K}, '''); }}}}')",
        f"concat('function own', {_K}, '() {{{{ return 1; }}}}')",
    )
    + ") as content from {part}",
    "deep_files": """select concat('deep/f', cast(p_partkey as string), '.js') as path, case p_size % 4 when 0 then concat('function f0_0() {{', chr(10), '}}', chr(10), 'function last() {{}}') when 1 then concat('function f0_1() {{', chr(10), 'function f1_1() {{', chr(10), '}}', chr(10), '}}', chr(10), 'function last() {{}}') when 2 then concat('function f0_2() {{', chr(10), 'function f1_2() {{', chr(10), 'function f2_2() {{', chr(10), '}}', chr(10), '}}', chr(10), '}}', chr(10), 'function last() {{}}') when 3 then concat('function f0_3() {{', chr(10), 'function f1_3() {{', chr(10), 'function f2_3() {{', chr(10), 'function f3_3() {{', chr(10), '}}', chr(10), '}}', chr(10), '}}', chr(10), '}}', chr(10), 'function last() {{}}') end as content from {part}""",
    "yaml_files": f"select concat('conf/', {_S}, '.yaml') as path, " + _lines(f"concat('key_', {_S}, ': 1')", "'  nested-x: 2'", "'# no: 3'", "'plain text'") + " as content from {supplier}",
    "json_files": f"select concat('conf/', {_S}, '.json') as path, " + _lines("'{{'", f"concat('  \"a', {_S}, '\": 1, \"b\": 2')", "'}}'") + " as content from {supplier}",
    "toml_files": f"select concat('conf/', {_S}, '.toml') as path, " + _lines(f"concat('[sec', {_S}, ']')", "'k = 1'", "'# c = 2'", "'[[arr]]'") + " as content from {supplier}",
    "css_files": f"select concat('conf/', {_S}, '.css') as path, " + _lines(f"concat('.c', {_S}, ' {{{{ }}}}')", "' .inner {{ }}'", "'#id{{'", "'a:hover {{'") + " as content from {supplier}",
    "md_files": f"select concat('conf/', {_S}, '.md') as path, " + _lines(f"concat('# Title ', {_S})", "'### no'", "'##  Part  '", "'text'") + " as content from {supplier}",
    "graphql_files": f"select concat('conf/', {_S}, '.graphql') as path, " + _lines(f"concat('type T', {_S}, ' {{{{')", "'  type inner'", "'}}'", "'query Q {{ a }}'") + " as content from {supplier}",
    "sql_files": f"select concat('conf/', {_S}, '.sql') as path, " + _lines(f"concat('CREATE VIEW v', {_S}, ' AS SELECT 1;')", "'create table'", f"concat('  if not exists t', {_S}, ' (a int);')", "'CREATE OR REPLACE VIEW w AS SELECT 2;'") + " as content from {supplier}",
    "bash_files": f"select concat('conf/', {_S}, '.sh') as path, " + _lines(f"concat('run', {_S}, '() {{{{')", "'  if () {{'", "'}}'", "'if () {{'", "'source ./lib.sh '", "'function go ( )'") + " as content from {supplier}",
    "vue_files": f"select concat('conf/', {_S}, '.vue') as path, "
    + _lines("'function out() {{}}'", "'<script setup>'", f"concat('export async function f', {_S}, '() {{{{')", "'const g = (x) => x'", "'</script>'", "'let z = ('")
    + " as content from {supplier}",
    "commits": """select row_number() over (order by o_orderdate desc, o_orderkey) as seq, md5(cast(o_orderkey as string)) as hash,
  case when o_orderpriority like '1%' then 'Fix order' when o_orderpriority like '2%' then 'bugfix of order' else 'update' end as message,
  o_orderdate as date, 'a' as author, 'a@example.org' as email from {orders}""",
    "commit_files": "select distinct md5(cast(l_orderkey as string)) as hash, concat('src/part_', cast(l_partkey % 150 as string), '.js') as file from {lineitem}",
    "notes_csv": """select row_number() over (order by conv_id, turn) as seq,
  concat('src/conv_', cast(conv_id % 20 as string), '.js', case when turn % 2 = 1 then ':fn' else '' end) as target, text as note, role as author,
  case turn % 4 when 0 then 'lesson' when 1 then 'pattern' when 2 then 'lesson,handover' else 'other' end as tags_csv, '2026-01-01T00:00:00.000Z' as timestamp from {conversations}""",
    "calls": """select event_id as seq, event_type as tool, cast(floor(value * 100) as bigint) as file_tokens, cast(floor(value * 7) as bigint) + event_id % 300 as response_tokens from {events}""",
    "handovers": """select conv_id as id, concat('# Report', chr(10), case when conv_id % 3 = 0 then '## Lessons Learned' when conv_id % 3 = 1 then '##  key learnings' else '## Other' end, chr(10),
  '- keep src/lib/a', cast(conv_id as string), '.js small', chr(10), '* tiny', chr(10), '- abc', chr(10), 'text', chr(10), '## Next', chr(10), '- not this one') as content
  from (select distinct conv_id from {conversations}) t""",
    "blames": """select cast(s_suppkey as string) as id, concat(md5(cast(s_suppkey as string)), '00000000 1 1 2', chr(10), 'author A', cast(s_suppkey as string), chr(10), 'author-time 17', chr(10), 'summary S', chr(10),
  chr(9), 'first', chr(10), md5(cast(s_suppkey as string)), '00000000 2 2', chr(10), chr(9), 'author x') as content from {supplier}""",
    "diffs": """select cast(s_suppkey as string) as id, concat('--- a/x.js', chr(10), '+++ b/x', cast(s_suppkey % 9 as string), '.js', chr(10), '@@ -1,2 +', cast(s_suppkey % 5 + 1 as string), ',3 @@ f', chr(10), '+a', chr(10),
  '@@ -9 +20 @@', chr(10), '@@ -30,2 +29,0 @@', chr(10)) as content from {supplier}""",
    "disk": "select concat(case when doc_id % 7 = 0 then 'new/' else 'd/' end, cast(doc_id as string)) as path, md5(case when doc_id % 5 = 0 then concat(text, '!') else text end) as hash from {documents}",
    "stored": "select concat(case when doc_id % 11 = 0 then 'old/' else 'd/' end, cast(doc_id as string)) as path, md5(text) as hash from {documents}",
}


CORPORA |= {f"{lang}_files": languages.files_sql(lang) for lang in languages.SHAPES}


def tables_of(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


#: Corpora whose rows are numbered in one order of all: the table and the order, nulls last as the other engine has them.
NUMBERED = {"commits": ("orders", "o_orderdate desc, o_orderkey"), "notes_csv": ("conversations", "conv_id, turn")}

#: Estimated bytes of the rows of one range; fewer, if that makes fewer ranges than the session has shuffle partitions.
RANGE_BYTES = 16 << 20


def numbered(rows: DataFrame, *order: Column, name: str = "seq") -> DataFrame:
    """rows with their number in an order of all, from 1, as row_number() gives it, without one task for all rows.

    Rows are dealt by ranges of the order, sorted within them and stored once, so that every use sees the same ranges. A row's
    number is its place in its range after the count of the rows in ranges before it; only these counts, one a range, are summed
    in one place.
    """
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the optimizer's estimate
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, known // RANGE_BYTES + 1))
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place from 0 in the lower 33
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy("__range").count()
    before = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(counts), "__range").select(*rows.columns, (F.col("__before") + place + 1).alias(name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus as a DataFrame."""
    sql = CORPORA[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    if name in NUMBERED:
        table, order = NUMBERED[name]
        keys = [F.col(k.split()[0]) for k in order.split(", ")]
        keys = [k.desc_nulls_last() if " desc" in o else k.asc_nulls_last() for k, o in zip(keys, order.split(", "), strict=True)]
        used = tables[table].select([c for c in tables[table].columns if c in sql])
        sql, tables[table] = sql.replace(f"row_number() over (order by {order})", "__seq"), numbered(used, *keys, name="__seq")
    return spark.sql(sql, **tables)


def with_views(sql: str, *names: str) -> str:
    """SQL for the other engine, with the corpora as common table expressions v_<name>."""
    ctes = ", ".join(f"v_{n} as ({CORPORA[n].format(**{t: t for t in tables_of(CORPORA[n])})})" for n in names)
    return f"with {ctes}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if names else sql
