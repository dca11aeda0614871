"""Sweeps, tags and indexes against the plain way of doing each."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from util import rows_of

from lodestone.functions import intervals, rules
from lodestone.operators import nesting, parse_code, search, tagging
from lodestone.operators.symbolindex import SymbolIndex
from lodestone.operators.textindex import TextIndex
from lodestone.plans import store


def spans(rng, n, lines):
    starts = [rng.randint(1, lines) for _ in range(n)]
    return starts, [min(lines, a + rng.choice([0, 1, 3, 10, lines])) for a in starts], rng.sample(range(n), n)


@pytest.mark.parametrize("seed", range(40))
def test_intervals(seed):
    rng = random.Random(seed)
    starts, ends, number = spans(rng, rng.randint(0, 25), 30)
    lines = sorted(rng.sample(range(1, 31), 12))
    holds = lambda j, a, b: starts[j] <= a and ends[j] >= b
    every = range(len(starts))
    for line, got in zip(lines, intervals.innermost(starts, ends, number, lines), strict=True):
        around = [(ends[j] - starts[j], number[j], j) for j in every if holds(j, line, line)]
        assert got == (min(around)[2] if around else -1)
    for i, got in enumerate(intervals.enclosing(starts, ends, number)):
        same = lambda j: (starts[j], ends[j]) == (starts[i], ends[i])  # noqa: B023, E731
        around = [j for j in every if j != i and holds(j, starts[i], ends[i]) and not (same(j) and number[j] > number[i])]
        assert got == sorted(around, key=lambda j: (ends[j] - starts[j], -number[j]))
    assert intervals.touched(starts, ends, lines) == [any(a <= x <= b for x in lines) for a, b in zip(starts, ends, strict=True)]


def test_intervals_are_near_linear():
    n = 100_000
    starts, ends = list(range(1, n + 1)), [min(n, i + 3) for i in range(1, n + 1)]
    began = time.perf_counter()
    assert len(intervals.innermost(starts, ends, list(range(n)), list(range(1, n + 1)))) == n
    assert sum(map(len, intervals.enclosing(starts, ends, list(range(n))))) >= 0
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("seed", range(15))
def test_tags_against_slices(seed):
    rng = random.Random(seed)
    some = ["pool.query('SELECT 1')", "db.insert(x)", "try {", "await fetch(u)", "const a = tenant_id;", "router.get('/a', f)", "app\n.post(", "validate(x)", "prisma.user.findMany(", "", "knex('t')", "pool.query(\n'SELECT", "authenticate(", "x.select (", "audit(audit("]
    text = "\n".join(rng.choice(some) for _ in range(30))
    starts, ends, number = spans(rng, 12, 31)
    symbols = [(k, f"n{rng.randint(0, 6)}", a, b, rng.randint(0, 1)) for k, a, b in zip(number, starts, ends, strict=True)]
    custom = [(r"(?i)AUDIT\(", "audited"), (r"audit\(audit", "twice")]
    lines = text.split("\n")

    def holds(p, body):
        flags, p = (re.A | re.I, p[4:]) if p.startswith("(?i)") else (re.A, p)
        return re.search(p, body, flags) is not None

    want, by_name = [], {}
    for k, name, a, b, is_async in sorted(symbols):
        by_name[name] = ("\n".join(lines[a - 1 : b]), is_async)
    routes = set()
    for i, line in enumerate(lines, 1):
        if holds(rules.ROUTE, line):
            around = [(b - a, k, name) for k, name, a, b, _ in symbols if a <= i <= b]
            routes |= {min(around)[2]} if around else set()
    for name, (body, is_async) in by_name.items():
        call = holds(rules.DB_CALL, body)
        tags = ["async"] * is_async + [t for p, t in ((rules.DB_READ, "db_read"), (rules.DB_WRITE, "db_write")) if holds(p, body)]
        tags += ["tenant_scoped" if rules.TENANT in body else "unscoped_query"] * call
        tags += ["error_handler"] if holds(rules.TRY, body) else ["no_error_handling"] * (call or holds(rules.FETCH, body))
        tags += [t for p, t in ((rules.AUTH, "auth"), (rules.VALIDATED, "validated"), (rules.ROUTE, "route_handler"), *custom) if holds(p, body)]
        tags += ["route_handler"] if name in routes and "route_handler" not in tags else []
        want += [(min(k for k, n, *_ in symbols if n == name), name, t) for t in tags]
    assert sorted(rules.Tagger(custom).tags(text, symbols)) == sorted(want)


def test_tags_of_one_pass(spark):
    """Scanning and tagging at once gives what tagging after it gives, with repositories and line formats too."""
    files = spark.createDataFrame([("a.js", "async function f() { return pool.query('SELECT 1'); }\nrouter.get('/x', (q, r) => {\n  r.send(1);\n});\n"), ("b.sh", "go() {\n"), ("c.css", ".a {"), ("d.js", None), ("e.js", "")], "path string, content string")
    symbols, _, tags = parse_code.parse_tagged(files, [(r"^go\(\)", "entry")])
    assert rows_of(tags) == rows_of(tagging.tag_symbols(files, symbols, [(r"^go\(\)", "entry")]))
    assert {(r["symbol_name"], r["tag"]) for r in tags.collect()} == {("f", "async"), ("f", "db_read"), ("f", "unscoped_query"), ("f", "no_error_handling"), ("GET /x", "route_handler"), ("go", "entry")}
    both = [t.withColumn("repo", F.lit(r)) for r in ("r1", "r2") for t in (files, symbols)]
    assert tagging.tag_symbols(both[0].unionByName(both[2]), both[1].unionByName(both[3])).where("repo = 'r2'").count() == 5


def test_nesting(spark):
    symbols = spark.createDataFrame([("a", 0, "f", 1, 9), ("a", 1, "g", 2, 8), ("a", 2, "h", 2, 8), ("a", 3, "k", 3, 3), ("b", 0, "f", 1, 2), ("b", 1, "x", None, None)], "path string, ordinal int, name string, start_line int, end_line int")
    got = {(r["path"], r["ordinal"], r["ancestor"], r["depth"]) for r in nesting.ancestors(symbols).collect()}
    assert got == {("a", 1, 0, 1), ("a", 2, 1, 1), ("a", 2, 0, 2), ("a", 3, 2, 1), ("a", 3, 1, 2), ("a", 3, 0, 3)}
    lines = spark.createDataFrame([("a", 9), ("a", 3), ("a", 3), ("c", 1)], "path string, line int")
    assert {(r["path"], r["name"]) for r in nesting.on_lines(lines, symbols.where("start_line is not null")).collect()} == {("a", "f"), ("a", "g"), ("a", "h"), ("a", "k")}
    assert nesting.ancestors(symbols.limit(0)).count() == 0


def test_descendants_join_nothing(spark):
    """Names go with the sweep: what stands in symbols of a name is told by file and repository, without a table to broadcast."""
    rows = [("r1", "a", 0, "f", 1, 9), ("r1", "a", 1, "g", 2, 8), ("r1", "a", 2, "f", 3, 7), ("r1", "a", 3, None, 4, 4), ("r1", "a", 4, "f", None, None), ("r2", "a", 0, "g", 1, 9), ("r2", "a", 1, "f", 2, 2), ("r2", "b", 0, "f", 1, 2), ("r2", "b", 1, "x", 2, 2)]
    symbols = spark.createDataFrame(rows, "repo string, path string, ordinal int, name string, start_line int, end_line int")
    got = nesting.descendants(symbols, "f")
    assert got.columns == ["repo", "path", "name", "depth", "ordinal", "of"]
    assert {tuple(r) for r in got.collect()} == {("r1", "a", "g", 1, 1, 0), ("r1", "a", "f", 2, 2, 0), ("r1", "a", None, 3, 3, 0), ("r1", "a", None, 1, 3, 2), ("r2", "b", "x", 1, 1, 0)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert nesting.descendants(symbols, "none").count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "éclair", "ÉCLAIR", "İstanbul", "a.b(c)", "ab", "x", "ΑΣ", "ας", "\t tab ", "🙂🙂🙂", "foo_bar", "Straße"]
    rows = [(f"r{i % 2}", f"d/f{i // 2}", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return spark.createDataFrame([*rows, ("r0", "none", None), ("r1", "empty", "")], "repo string, path string, content string")


def test_text_index(spark, texts, monkeypatch):
    monkeypatch.setattr("lodestone.operators.textindex.BLOCK_LINES", 7)
    monkeypatch.setattr("lodestone.operators.textindex.BLOCK_BYTES", 600)
    monkeypatch.setattr("lodestone.operators.postings.AT_ONCE", 500)
    index = TextIndex.build(texts, shard_bytes=4000)
    total = index.index.rows.count()
    assert index.index.rows.select("shard").distinct().count() > 2
    for pattern in ("alpha Beta", "BETA", "é", "éclair", "ÉC", "istanbul", "İst", "ΑΣ", "ας x", "🙂🙂🙂", "b(c", "foo_", "straße", "nowhere at all", "x\nx", "  "):
        for sensitive in (False, True):
            assert rows_of(index.find_text(pattern, sensitive)) == rows_of(search.find_text(texts, pattern, sensitive)), (pattern, sensitive)
    for name in ("foo_bar", "alpha", "ab", "ment", "é"):
        assert rows_of(index.find_references(name)) == rows_of(search.find_references(texts, name)), name
    assert index.candidates("nowhere at all").count() == 0 < index.candidates("alpha Beta x ab").count() < total
    with pytest.raises(ValueError):
        index.find_text("a", use_regex=True)
    assert TextIndex.build(texts.limit(0)).find_text("alpha").count() == 0


def test_text_index_joins_where_many_blocks_match(spark, texts, monkeypatch):
    monkeypatch.setattr("lodestone.operators.textindex.BLOCK_BYTES", 300)
    index = TextIndex.build(texts, shard_bytes=4000)
    monkeypatch.setattr("lodestone.operators.postings.FEW", 3)
    assert rows_of(index.find_text("alpha")) == rows_of(search.find_text(texts, "alpha"))


def test_symbol_index(spark):
    rng = random.Random(3)
    parts = ["get", "Get", "user", "User", "by", "id", "x", "name", "createPO", "é", "É", "load", "_"]
    rows = []
    for i in range(400):
        name = rng.choice(["_", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        rows.append((rng.choice(["src/a.js", "lib/b.js", "src/c.js"]), i, name, rng.choice(["function", "class"]), rng.randint(0, 1), rng.choice(["code", "query", "docs"])))
    symbols = spark.createDataFrame(rows, "path string, ordinal int, name string, kind string, exported int, source_type string")
    index = SymbolIndex.build(symbols, shard_rows=90)
    for query in ("getUser", "user by id", "get_user", "user%id", "x", "é", "é user", "po", "nothing", "", "load load user"):
        for limit, more in ((None, {}), (1, {}), (7, {"kind": "class", "source_types": []}), (1000, {"exported_only": True})):
            want = search.find_symbols(symbols, query, limit, **more).collect()
            got = index.find_symbols(query, limit, **more).select(*symbols.columns, "base_score", "score").collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in want], (query, limit, more)
    index.find_symbols("get_user", 1)
    assert 0 < index.opened < 400


def test_index_goes_with_the_store(spark, tmp_path):
    """Each version has the index of its own lines; only buckets that change are indexed again."""
    s = store.Snapshots(spark, str(tmp_path / "s"), indexed=True)
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    same = lambda p: rows_of(s.text_index().find_text(p)) == rows_of(search.find_text(s.table("files"), p))
    s.upsert(frame([(f"d/f{i}.md", f"# Title {i}\nalpha beta\n" * (i % 5)) for i in range(20)]))
    assert same("title 1") and same("beta") and same("zz") and s.text_index().find_text("title").count() == 40
    before = s._plan()["grams"]
    s.upsert(frame([("d/f3.md", "gamma ray\n")]), frame([("d/f4.md", "")]).select("path"))
    assert same("title") and same("gamma") and s.text_index().find_text("gamma").count() == 1
    after = s._plan()["grams"]
    assert 0 < len(set(after.values()) - set(before.values())) <= 2 < len(set(after.values()) & set(before.values()))
    with pytest.raises(ValueError):
        store.Snapshots(spark, str(tmp_path / "t")).text_index()
