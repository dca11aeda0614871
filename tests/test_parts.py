import datetime as dt
import io
import json
import os
import subprocess
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from util import rows_of

from lodestone import tools
from lodestone.functions import scan, text
from lodestone.operators import history, notes, search, tagging, telemetry
from lodestone.plans import languages, store
from lodestone.sources import config, git, repo, tree, vault
from lodestone.sources import notes as note_files
from lodestone.streaming import events, watch


# --- paths and files ---


def test_inside():
    assert repo.inside("/r", "../outside.txt") is None
    assert repo.inside("/r", "src/../src/app.js") == "src/app.js"


def test_existing_refuses_links(tmp_path):
    root = tmp_path / "root"
    (root / "src").mkdir(parents=True)
    (root / "src/app.js").write_text("const ok = true;\n")
    (tmp_path / "outside.js").write_text("x")
    os.symlink(tmp_path / "outside.js", root / "src/link.js")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/o.js").write_text("x")
    os.symlink(tmp_path / "other", root / "linked")
    assert repo.existing(str(root), "src/app.js") == "src/app.js"
    assert repo.existing(str(root), "src/link.js") is None
    assert repo.existing(str(root), "linked/o.js") is None
    assert repo.existing(str(root), "../outside.js") is None
    assert [p for p, _, _ in repo.list_files(str(root))] == ["src/app.js"]


def test_safe_paths(spark):
    pairs = {"../../src/service.js:handler": "_/_/src/service.js_handler", "src/services/order service.js": "src/services/order_service.js", "": "global", "//": "global"}
    df = spark.createDataFrame([(k,) for k in pairs], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", text.safe_path(F.col("p")).alias("s")).collect()} == pairs
    assert all(note_files.safe_relative(k) == v for k, v in pairs.items())


def test_ignored(spark):
    assert repo.ignored_names(["**/gen/**", "tmp"])[-2:] == ["gen", "tmp"]
    df = spark.createDataFrame([("a/dist/x.js",), ("a/distx/x.js",), ("gen/x.js",)], "path string")
    assert [r[0] for r in df.where(~repo.is_ignored(F.col("path"), ["**/gen/**"])).collect()] == ["a/distx/x.js"]


# --- text search ---


def test_literal_and_identifier(spark):
    f = spark.createDataFrame([("a", "a+b\naaab\n(a+)+$\n"), ("b", "foo.bar()\nfooXbar\n  été menté ment \n")], "path string, content string")
    assert [r["content"] for r in search.find_text(f, "a+b").collect()] == ["a+b"]
    assert search.find_text(f, "(a+)+$").count() == 1
    assert [r["line"] for r in search.find_references(f, "foo.bar").collect()] == [1]
    assert [r["content"] for r in search.find_references(f, "ment").collect()] == ["été menté ment"]
    assert search.find_references(f, "men").count() == 0
    for bad in ("", None, "x" * 257):
        with pytest.raises(ValueError):
            search.find_references(f, bad)
    with pytest.raises(ValueError, match="disabled"):
        search.find_text(f, "x", use_regex=True)


def test_like_keeps_wildcards(spark):
    df = spark.createDataFrame([("aXb",), ("ab",), (r"a\b",), ("É",)], "s string")
    hit = lambda p: [r[0] for r in df.where(text.like(F.col("s"), p)).collect()]
    assert hit("A_B") == ["aXb", r"a\b"]
    assert hit(r"%\%") == [r"a\b"]
    assert hit("é") == []


def test_suffixes():
    assert search.import_suffixes("src/lib/a.ts")[0] == "lib/a"
    assert "a" not in search.import_suffixes("src/lib/a.ts")
    assert "lib/x/" in search.import_suffixes("src/lib/x/index.js")
    assert "inde" in search.import_suffixes("index.js")


# --- scanners ---


def test_javascript():
    symbols, imports = scan.scan(
        "const { a, b: c } = require('y');\nimport d, { e as f } from 'mod';\nconst up = async (x, y) => x;\nrouter.post('/p', auth, async (q) => {\n  const s = '}';\n});\n"
        "class Box extends Y {\n  async area(x) {\n    return x;\n  }\n}\n",
        "javascript",
    )
    assert symbols == [
        ("up", "function", "up(x, y)", 3, 3, 0, 1, None),
        ("POST /p", "route", "POST /p", 4, 6, 0, 1, None),
        ("Box", "class", "class Box", 7, 11, 0, 0, None),
        ("area", "method", "area(x)", 8, 10, 0, 1, "Box"),
    ]
    assert imports == [("y", ["a", "c"], 1), ("mod", ["d", "e"], 2)]


def test_other_languages():
    names = lambda t, lang: [(s[0], s[1], s[3], s[4], s[7]) for s in scan.scan(t, lang)[0]]
    assert names("@d\nclass K:\n    def m(self):\n        return 1\n\nasync def f(a,\n  b):\n    pass\n", "python") == [("K", "class", 2, 4, None), ("m", "method", 3, 4, "K"), ("f", "function", 6, 8, None)]
    assert names("type S struct {\n  x int\n}\nfunc (s *S) Get() int {\n  return 1\n}\n", "go") == [("S", "class", 1, 3, None), ("Get", "method", 4, 6, "S")]
    assert names("pub enum C { A, B(u8) }\nimpl T for P {\n  fn a(&self) {}\n}\n", "rust") == [("C", "enum", 1, 1, None), ("A", "enum_member", 1, 1, "C"), ("B", "enum_member", 1, 1, "C"), ("P", "impl", 2, 4, None), ("a", "method", 3, 3, "P")]
    assert names("public class A {\n  int x = 1, y;\n  A(int q) { }\n  void go() { }\n}\n", "java") == [("A", "class", 1, 5, None), ("x", "property", 2, 2, "A"), ("y", "property", 2, 2, "A"), ("A", "constructor", 3, 3, "A"), ("go", "method", 4, 4, "A")]
    assert names("namespace N {\n  public class A {\n    public int P { get; set; }\n  }\n}\n", "csharp") == [("N", "namespace", 1, 5, None), ("A", "class", 2, 4, "N"), ("P", "property", 3, 3, "A")]
    assert scan.scan("", "python") == ([], []) and scan.scan("}}}((", "javascript") == ([], [])


@pytest.mark.parametrize("lang", sorted(languages.SHAPES))
def test_shapes(lang):
    fill = lambda x: x.replace("§", "7") if isinstance(x, str) else [fill(y) for y in x] if isinstance(x, list) else x
    shapes, lang = languages.SHAPES[lang][1], lang.split("_")[0]  # further sets of a language's shapes are named after it
    for text, symbols, imports in shapes:
        assert len(scan.mask(text, lang)) == len(text)
        got = scan.scan(fill(text), lang)
        assert got[0] == [tuple(map(fill, r)) for r in symbols]
        assert got[1] == [tuple(map(fill, r)) for r in imports]


def test_script_mask():
    """Patterns, templates in templates, divisions: brackets in them open nothing."""
    text = "function a(x) {\n  return x.replace(/[{(]/g, '') / 2 / 3;\n}\nfunction b() { return `x ${f(`y {`)} z } ${ {a: 1}.a }`; }\nclass C {\n  m() { return /}/.test(q) }\n}\n"
    assert [(s[0], s[3], s[4], s[7]) for s in scan.scan(text, "javascript")[0]] == [("a", 1, 3, None), ("b", 4, 4, None), ("C", 5, 7, None), ("m", 6, 6, "C")]
    assert [s[:1] + s[3:5] for s in scan.scan("function f() { g(]; }\nfunction h() {}\n", "javascript")[0]] == [("f", 1, 1), ("h", 2, 2)]
    assert scan.scan("function f() { `${", "javascript")[0][0][0] == "f"


def test_children():
    symbols, _ = scan.scan("class A {\n  m() {}\n}\n", "javascript")
    assert scan.link_children(symbols) == {0: [1]}


def test_custom_tags(spark):
    files = spark.createDataFrame([("a.js", "function f() {\n  audit(1);\n}\n")], "path string, content string")
    symbols = spark.createDataFrame([("a.js", 0, "f", 1, 3, 0)], "path string, ordinal int, name string, start_line int, end_line int, async int")
    assert [r["tag"] for r in tagging.tag_symbols(files, symbols, [(r"audit\(", "audited")]).collect()] == ["audited"]


# --- store and stream ---


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    assert s.table("files").count() == 0 and s.healthy()
    s.upsert(frame([("a.js", "function f() {\n}\n"), ("b.md", "# T\n")]))
    assert {r["name"] for r in s.table("symbols").collect()} == {"f", "T"}
    assert s.upsert(frame([("a.js", "function f() {\n}\n")])) is None
    s.reconcile(frame([("a.js", "function g() {\n}\n"), ("c.json", '{\n"k": 1}')]))
    assert {(r["path"], r["name"]) for r in s.table("symbols").collect()} == {("a.js", "g"), ("c.json", "k")}
    assert s.upsert(frame([("a.js", "function g() {\n}\n")]), force=True) is not None
    places = s.buckets()["files"]
    assert len(places) == 2
    s.upsert(frame([("a.js", "function h() {\n}\n")]))  # only the bucket of a.js is written anew
    assert len(set(s.buckets()["files"].values()) & set(places.values())) == 1 and s.healthy()
    top = os.path.join(s.root, sorted(s.buckets()["files"].values())[-1])
    with open(os.path.join(top, next(f for f in os.listdir(top) if f.endswith(".parquet"))), "wb") as f:
        f.write(b"broken")
    assert not s.healthy() and s.current() is None and s.table("files").count() == 0


def test_reindex_and_rebuild(spark, tmp_path):
    """One path is indexed again only if it is a file of the tree: no links, no folders, nothing outside."""
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src/a.js").write_text("function a() {\n}\n")
    (root / "src/b.js").write_text("function b() {\n}\n")
    (tmp_path / "outside.js").write_text("function out() {\n}\n")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/o.js").write_text("function o() {\n}\n")
    os.symlink(tmp_path / "outside.js", root / "src/link.js")
    os.symlink(tmp_path / "other", root / "linked")
    s = store.Snapshots(spark, str(tmp_path / "s"))
    names = lambda: sorted(r["name"] for r in s.table("symbols").collect())
    assert s.reindex(str(root), "src/a.js") and names() == ["a"]
    for bad in ("src/link.js", "linked/o.js", "../outside.js", "src", "src/none.js", str(tmp_path / "outside.js")):
        assert not s.reindex(str(root), bad)
    version = s.current()
    assert s.reindex(str(root), "src/a.js") and s.current() == version  # the same content
    (root / "src/a.js").write_text("function a2() {\n}\n")
    assert s.reindex(str(root)) and names() == ["a2"]
    s.rebuild(repo.read_files(spark, str(root)))
    assert names() == ["a2", "b"]


def test_migrated(spark):
    old = spark.createDataFrame([("a", 1)], "path string, gone int")
    out = store.migrated(old, "path string, source_type string, n int", {"source_type": F.lit("code")})
    assert [r.asDict() for r in out.collect()] == [{"path": "a", "source_type": "code", "n": None}]


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.DEFAULTS
    (tmp_path / "lodestone.json").write_text('{"store": "x", "ignore": ["a"]}')
    assert config.load(str(tmp_path), {"polling": True, "store": "y"}) == {"store": "y", "ignore": ["a"], "polling": True}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/lodestone.toml").write_text('store = "z"')
    assert config.load(str(tmp_path / "t"))["store"] == "z"
    env = {"PWD": "/p", "INIT_CWD": "/i"}
    assert [config.project_root(*a) for a in (("/g", env, "/c"), (None, env, "/c"), (None, {"INIT_CWD": "/i"}, "/c"), (None, {}, "/c"))] == ["/g", "/p", "/i", "/c"]
    path = str(tmp_path / "d" / "totals.json")
    assert config.read_totals(path) == config.ZEROS
    assert config.write_totals(path, {"total_queries": 3, "total_tokens_saved": 5, "total_cost_avoided": {"large": 0.1}})
    assert config.read_totals(path) == {"total_queries": 3, "total_tokens_saved": 5, "total_cost_avoided": {"large": 0.1}}
    with open(path, "w") as f:
        f.write("{broken")
    assert config.read_totals(path) == config.ZEROS


def test_tools(spark, tmp_path):
    """Named tools over two repositories, with routing, unknown names and the line protocol."""
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.js").write_text("const u = require('./b');\nasync function load(id) {\n  db.insert(id);\n}\n")
    r = tools.Repos(spark)
    assert r.add_root(str(tmp_path / "none")) == {"error": f"Path does not exist: {tmp_path / 'none'}"}
    assert r.add_root(str(tmp_path / "one")) | {"root": ""} == {"added": "one", "root": "", "files": 1, "symbols": 1}
    t = tools.tools(r)
    assert json.loads(tools.call(t, "outline", path="a.js"))["data"][0]["name"] == "load"  # the only one needs no name
    assert r.add("two", spark.createDataFrame([("b.js", "function load() {\n}\n")], "path string, content string"))["symbols"] == 1
    assert "error" in r.add("two", spark.createDataFrame([], "path string, content string"))
    ask = lambda tool, /, **kw: json.loads(tools.call(t, tool, **kw))
    assert [(x["repo"], x["name"]) for x in ask("find_symbol", query="load")["data"]] == [("one", "load"), ("two", "load")]
    assert [x["path"] for x in ask("find_symbol", query="load", repo="two")["data"]] == ["b.js"]
    assert ask("find_text", pattern="INSERT", repo="one")["data"] == [{"path": "a.js", "line": 3, "content": "db.insert(id);"}]
    assert [x["repo"] for x in ask("find_text", pattern="function")["data"]] == ["one", "two"]
    assert [x["path"] for x in ask("tree", repo="two")["data"]] == ["b.js"]
    assert [x["tag"] for x in ask("tags", path="a.js", repo="one")["data"]] == ["async", "db_write", "unscoped_query", "no_error_handling"]
    assert ask("read_symbol", path="b.js", name="load", repo="two")["data"][0]["text"] == "function load() {\n}"
    assert [(x["repo"], x["files"], x["symbols"]) for x in ask("list_repos")["data"]] == [("one", 1, 1), ("two", 1, 1)]
    assert ask("find_importers", path="b.js", repo="one")["data"] == [{"path": "a.js"}]
    assert "Unknown repo" in ask("outline", path="a.js", repo="no")["error"] and "timing_ms" in ask("status")["_meta"]
    assert "error" in ask("nothing")
    out = io.StringIO()
    tools.serve(t, ['{"tool": "tree", "arguments": {"repo": "two"}}\n', "\n", "broken\n"], out)
    rows = [json.loads(x) for x in out.getvalue().splitlines()]
    assert rows[0]["data"] == [{"path": "b.js"}] and "error" in rows[1] and len(rows) == 2


def test_tools_over_equal_paths(spark):
    """Two repositories that hold the same path: each answer is of its own, and tells the repository."""
    r = tools.Repos(spark)
    r.add("one", spark.createDataFrame([("src/i.js", "const a = require('./x');\nfunction load() { return pool.query('SELECT 1'); }\n")], "path string, content string"))
    r.add("two", spark.createDataFrame([("src/i.js", "function other() {}\nfunction load() { return pool.query('SELECT 2'); }\n")], "path string, content string"))
    s = tools.Session(r, tools.tools(r))
    ask = lambda tool, /, **kw: json.loads(s.call(tool, **kw))["data"]
    assert [(x["repo"], x["symbol_name"]) for x in ask("find_by_tag", tag="db_read")] == [("one", "load"), ("two", "load")]
    assert [(x["repo"], x["text"][-5:], x["outline"]) for x in sorted(ask("context", path="src/i.js", name="load"), key=lambda x: x["repo"])] == [("one", "'); }", ["load"]), ("two", "'); }", ["other", "load"])]
    assert {(x["repo"], x["text"].split()[-2]) for x in ask("read_symbol", path="src/i.js", name="load")} == {("one", "1');"), ("two", "2');")}
    assert [x.get("text") for x in ask("read_symbols", specs=[["src/i.js", "other"], ["src/i.js", "none"]], repo="two")] == ["function other() {}", None]
    assert ask("tree", depth=1) == [{"repo": "one", "path": "src/"}, {"repo": "two", "path": "src/"}]
    assert len(ask("find_text", pattern="function", limit=2)) == 2


def test_session_totals(spark, tmp_path):
    """What a call saved is told with it; totals go on in the next session."""
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.js").write_text("function load() {\n" + "  // " + "x" * 4000 + "\n}\n")
    path = str(tmp_path / "p/.lodestone/telemetry.json")
    for turn in (1, 2):
        r = tools.Repos(spark)
        r.add_root(str(tmp_path / "p"))
        s = tools.Session(r, tools.tools(r), path)
        m = json.loads(s.call("outline", path="a.js"))["_meta"]
        assert m["tokens_saved"] > 900 and m["total_tokens_saved"] == turn * m["tokens_saved"] and m["estimate_method"] == "byte_approx"
        assert m["total_cost_avoided"]["large"] == round(turn * m["cost_avoided"]["large"], 4) > 0
        assert set(json.loads(s.call("status"))["_meta"]) == {"timing_ms"}
        assert json.loads(s.call("telemetry"))["total_queries"] == 3 * turn - 1
    assert json.loads(s.call("find_symbol", query="load"))["_meta"]["tokens_saved"] > 900
    assert json.loads(s.call("find_text", pattern="nowhere"))["_meta"]["tokens_saved"] == 0


def test_served_before_indexed(spark, tmp_path, monkeypatch):
    """Tools answer while a folder is indexed, and from the index when it is there."""
    (tmp_path / "a.js").write_text("function a() {}\n")
    r, go, real = tools.Repos(spark), threading.Event(), tools.read_files
    monkeypatch.setattr(tools, "read_files", lambda *a: go.wait(60) and real(*a))
    s = tools.Session(r, tools.tools(r))
    r.begin(str(tmp_path), "one")
    assert json.loads(s.call("outline", path="a.js")) == {"indexing": ["one"]} and not r.ready(0.01)
    go.set()
    assert r.ready(120) and [x["name"] for x in json.loads(s.call("outline", path="a.js"))["data"]] == ["a"]


def test_more_tools(spark, tmp_path, monkeypatch):
    """Tools of git, notes and hand-overs, of reindexing, and the cut of long results."""
    root = tmp_path / "r"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (root / "a.js").write_text("function one() {}\n")
    run("add", ".")
    run("commit", "-m", "fix start")
    r = tools.Repos(spark)
    r.add_root(str(root))
    s = tools.Session(r, tools.tools(r, vault=str(tmp_path / "v")))
    ask = lambda tool, /, **kw: json.loads(s.call(tool, **kw))
    assert ask("git_status")["data"][0]["branch"] == "main" and s.call("git_diff").startswith("(no changes)")
    assert [x["message"] for x in ask("git_log", max_count=0)["data"]] == ["fix start"]
    assert ask("git_hotspots", days=0)["data"][0]["bug_fix_count"] == 1 and ask("git_blame", path="a.js")["data"][0]["author"] == "A"
    assert "error" in ask("git_blame", path="none.js")
    (root / "a.js").write_text("function two() {}\n")
    (root / "b.js").write_text("function b() {}\n")
    assert ask("reindex", path="a.js")["reindexed"] == "a.js" and "error" in ask("reindex", path="../x")
    assert [x["name"] for x in ask("outline", path="a.js")["data"]] == ["two"] and ask("outline", path="b.js")["data"] == []
    assert "reindexed" in ask("reindex") and [x["name"] for x in ask("outline", path="b.js")["data"]] == ["b"]
    assert ask("annotate", target="a.js:two", note="slow", tags=["lesson"])["author"] == "unknown"
    assert ask("ingest_handover", markdown="## Lessons Learned\n- keep src/a.js small\n- never mind it\n", worker="w")["ingested"] == 2
    assert [x["note"] for x in ask("recall", target="a.js:two")["data"]] == ["slow"] and len(ask("lessons", tag="handover")["data"]) == 2 and ask("patterns", directory="a")["data"] == []
    assert {x["key"]: x["n"] for x in ask("learning_report")["data"]}["lesson"] == 3
    assert ask("sync_notes")["synced"] == 3 and ask("sync_notes")["synced"] == 0
    assert ask("worker_config", root="/r")["command"] == "python"
    monkeypatch.setattr(tools.rows_of, "__defaults__", (1,))
    assert len((m := ask("tree"))["data"]) == 1 and m["_meta"]["cut_at"] == 1


def test_inject_meta():
    assert json.loads(telemetry.inject_meta('{"a": 1}', {"t": 2})) == {"a": 1, "_meta": {"t": 2}}
    assert json.loads(telemetry.inject_meta("[1]", {"t": 2})) == {"data": [1], "_meta": {"t": 2}}
    assert telemetry.inject_meta("plain", {"t": 2}) == 'plain\n{\n  "_meta": {\n    "t": 2\n  }\n}'


def test_vault_entry(tmp_path):
    entry = {"target": "../src/a.js:f", "note": "hello", "author": None, "tags": ["x", "y"], "timestamp": "2026-05-19T00:00:00.000Z"}
    path = note_files.write_entry(str(tmp_path), entry)
    assert os.path.relpath(path, tmp_path) == "notes/2026-05-19T00-00-00-000Z--src-a-js-f.md"
    assert open(path).read() == "---\ntarget: ../src/a.js:f\nauthor: unknown\ntags: [x, y]\ndate: 2026-05-19T00:00:00.000Z\n---\n\nhello\n"


def test_stream(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.js").write_text("function a() {\n}\n")
    (root / "b.js").write_text("function b() {\n}\n")
    s = store.Snapshots(spark, str(tmp_path / "s"))
    # the reader itself: adds, then a change and a delete, and the same answer when asked again
    r = watch._Reader(str(root), str(tmp_path / "l"))
    rows, one = r.read(r.initialOffset())
    assert list(rows) == [("a.js", "add"), ("b.js", "add")]
    watch.apply_changes(s, str(root), spark.createDataFrame([("a.js", "add"), ("b.js", "add")], "path string, change string"))
    (root / "a.js").write_text("function a2() {\n}\n//\n")
    (root / "b.js").unlink()
    rows, two = r.read(one)
    assert list(rows) == [("a.js", "change"), ("b.js", "unlink")] == list(r.readBetweenOffsets(one, two))
    watch.apply_changes(s, str(root), spark.createDataFrame([("a.js", "change"), ("b.js", "unlink")], "path string, change string"))
    assert [x["name"] for x in s.table("symbols").collect()] == ["a2"]


def test_watch_end_to_end(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.js").write_text("function a() {\n}\n")
    s = store.Snapshots(spark, str(tmp_path / "s"))
    q = watch.watch(spark, str(root), s, str(tmp_path / "c"), "1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x["name"] for x in s.table("symbols").collect()] == ["a"]


def test_event_log_in_any_order(spark, tmp_path):
    """A log in order, and the same log shuffled and replayed, give the same store; bursts are told once, tombstones hold."""
    root = tmp_path / "tree"
    root.mkdir()
    for name in ("a", "b", "d"):
        (root / f"{name}.js").write_text(f"function {name}() {{}}\n")
    at = lambda ms: dt.datetime.fromtimestamp(1_700_000_000 + ms / 1000, dt.UTC).isoformat()
    log = [("a.js", "add", 0, 1), ("b.js", "add", 10, 2), ("c.js", "add", 20, 3), ("a.js", "change", 100, 4), ("c.js", "unlink", 150, 5), ("d.js", "add", 4000, 6), ("a.js", "change", 200, 7), ("b.js", "unlink", 250, 8), ("b.js", "add", 250, 9)]
    late = ("c.js", "add", 30, 3)  # of a path that is gone, and older
    tick = lambda ms: {"path": "", "change": "tick", "at": at(ms), "seq": 0}
    row = lambda e: {"path": e[0], "change": e[1], "at": at(e[2]), "seq": e[3]}
    orders = {"straight": [[*map(row, log)], [row(late), tick(20_000)], [tick(60_000)]], "mixed": [[row(e) for e in log[::-2] + log[::2][::-1]], [row(e) for e in (late, *log[3:], *log)] + [tick(20_000)], [tick(60_000)]]}
    stores, told = {}, {}
    for name, files in orders.items():
        (tmp_path / name).mkdir()
        s = stores[name] = store.Snapshots(spark, str(tmp_path / f"store-{name}"))
        seen = []
        for k, rows in enumerate(files):
            (tmp_path / name / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
            q = events.follow(spark, str(tmp_path / name), str(root), s, str(tmp_path / f"check-{name}"))
            q.awaitTermination(120)
            seen.append(s.current())
        told[name] = seen
    for s in stores.values():
        assert {x["name"] for x in s.table("symbols").collect()} == {"a", "b", "d"}
    assert rows_of(stores["straight"].table("symbols")) == rows_of(stores["mixed"].table("symbols"))


def test_last_event(spark, tmp_path):
    """What is told: the last of a burst, once; older events of a deleted path are nothing; its next life is."""
    events.prepare(spark)
    at = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    lots = [[("p", "add", 0, 1), ("p", "change", 1, 2), ("q", "add", 0, 3)], [("p", "unlink", 1, 9), ("", "tick", 30, 0)], [("p", "add", 0, 4), ("", "tick", 31, 0)], [("p", "add", 40, 10), ("", "tick", 90, 0)], [("", "tick", 200, 0)]]
    (tmp_path / "log").mkdir()
    out = []
    for k, lot in enumerate(lots):
        (tmp_path / f"log/{k}.json").write_text("".join(json.dumps({"path": p, "change": c, "at": at(t), "seq": n}) + "\n" for p, c, t, n in lot))
        frame = events.settled(spark.readStream.schema(events.EVENTS).json(str(tmp_path / "log")), "5 seconds", debounce=2000)
        q = frame.writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").foreachBatch(lambda b, _: out.extend(tuple(r)[:2] for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(out) == [("p", "add"), ("p", "unlink"), ("q", "add")]


def test_stale(spark):
    disk = spark.createDataFrame([("a", 100.0), ("b", 103.0)], "path string, mtime double")
    stored = spark.createDataFrame([("a", dt.datetime(1970, 1, 1, 0, 1, 40)), ("b", dt.datetime(1970, 1, 1, 0, 1, 40))], "path string, indexed_at timestamp")
    assert store.stale(disk, stored).first().asDict() == {"stale": 1, "sampled": 2}


def test_tree_source(spark, tmp_path):
    """The tasks' listing gives the rows of the plain one; links and what is ignored stay out, filters reach the listing."""
    root = tmp_path / "root"
    for p, t in {"a.js": "1", "x/b.ts": "2", "x/y/c.md": "3\r\n", "x/y/z/w/d.json": "{}", "node_modules/e.js": "5", "x/dist/f.js": "6", "x/g.txt": "7", "x/y/h.js": "\xff"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t.encode("latin-1"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/o.js").write_text("out")
    os.symlink(tmp_path / "out", root / "x/linked")
    os.symlink(tmp_path / "out/o.js", root / "x/l.js")
    want = {(r["path"], r["content"]) for r in repo.read_files(spark, str(root), [p for p, _, _ in repo.list_files(str(root))]).collect()}
    for depth in (0, 1, 2, 9):
        got = tree.read_tree(spark, str(root), depth=depth)
        assert {(r["path"], r["content"]) for r in got.collect()} == want and len(want) == 5
    assert {r["path"] for r in tree.read_tree(spark, str(root), content=False).where("extension in ('.js', '.md') and path like 'x/%'").collect()} == {"x/y/c.md", "x/y/h.js"}
    assert [r["path"] for r in got.where("path = 'x/b.ts'").collect()] == ["x/b.ts"] and got.where("path = '../out/o.js'").count() == 0
    reader = tree.TreeReader({"root": str(root)})
    left = list(reader.pushFilters([StringStartsWith(("path",), "x/y/"), EqualTo(("size",), 1), In(("extension",), (".md",))]))
    assert left == [EqualTo(("size",), 1)] and [p.folder for p in reader.partitions()] == ["", "x", "x/y"] and reader.wanted == {".md"}
    assert {r["path"] for r in tree.read_tree(spark, str(root), ignore=["y"]).collect()} == {"a.js", "x/b.ts"} and tree.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_digests(spark):
    disk = spark.createDataFrame([(f"p{i}", str(i % 7)) for i in range(500)], "path string, hash string")
    old = disk.where("path not in ('p3', 'p4')").withColumn("hash", F.when(F.col("path") == "p9", "other").otherwise(F.col("hash"))).unionByName(spark.createDataFrame([("gone", "1")], "path string, hash string"))
    got = {(r["path"], r["change"]) for r in store.changes_by_digest(disk, old, 8).collect()}
    assert got == {("p3", "add"), ("p4", "add"), ("p9", "change"), ("gone", "unlink")}
    assert store.differing(store.digests(disk, 8), store.digests(old, 8)).count() <= 4 and store.differing(store.digests(disk, 8), store.digests(disk, 8)).count() == 0
    assert store.changes_by_digest(disk.limit(0), old.limit(0)).count() == 0 and store.changes_by_digest(disk, old.limit(0)).count() == 500


def test_store_by_size(spark, tmp_path, monkeypatch):
    """Buckets from bytes, more of them when the store has grown, and digests that are kept with it."""
    monkeypatch.setattr(store, "BUCKET_BYTES", 200)
    monkeypatch.setattr(store, "LEAST_BUCKETS", 1)
    s = store.Snapshots(spark, str(tmp_path / "s"))
    files = lambda n, text="function f() {}\n": spark.createDataFrame([(f"f{i}.js", text * 4) for i in range(n)], "path string, content string")
    s.upsert(files(3))
    assert s.count() == 1 and s.digests().agg(F.sum("n")).first()[0] == 3
    s.upsert(files(40))
    s.upsert(files(45))
    assert s.count() > 5 and s.table("files").count() == 45 == s.table("symbols").select("path").distinct().count()
    assert s.digests().agg(F.sum("n")).first()[0] == 45
    now = files(45).where("path <> 'f7.js'").withColumn("content", F.when(F.col("path") == "f8.js", "new").otherwise(F.col("content")))
    assert s.reconcile(now) and s.reconcile(now) is None and s.table("files").count() == 44
    assert store.differing(s.digests(), store.digests(s.table("files"), s.count())).count() == 0


def test_store_tells_lost_rows(spark, tmp_path):
    """A part that is gone reads without an error; the digests tell it, and the store is set aside."""
    s = store.Snapshots(spark, str(tmp_path / "s"))
    s.upsert(spark.createDataFrame([(f"f{i}.md", f"# T{i}\n") for i in range(8)], "path string, content string"))
    assert s.healthy()
    place = tmp_path / "s" / next(iter(s.buckets()["files"].values()))
    for f in place.iterdir():
        f.unlink()
    assert not s.healthy() and s.current() is None and s.table("files").count() == 0


def test_vault_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """A commit that breaks off is finished by the next write; tasks that are not committed leave nothing."""
    rows = [(i, f"src/f{i % 3}.js", f"note {i}", "a", ["x"], "t") for i in range(1, 10)]
    n = spark.createDataFrame(rows, notes.SCHEMA)
    top = tmp_path / "v/notes"
    assert note_files.sync_vault(n.where("seq <= 4"), str(tmp_path / "v")) == 4
    w = vault.VaultWriter(str(top), "w1")
    page = {"target": "src/f1.js", "file": "src/f1.js.md", "page": "## src/f1.js\n\nhalf", "last": 9}
    w.abort([w.write(iter([page]))])
    assert "half" not in (top / "src/f1.js.md").read_text() and not os.path.exists(w.aside)
    done, real = [], os.replace

    def breaks(a, b):
        if b.endswith(".md") and done:
            raise OSError("lost")
        done.extend([b] * b.endswith(".md"))
        real(a, b)

    monkeypatch.setattr(vault.os, "replace", breaks)
    w = vault.VaultWriter(str(top), "w2")
    told = w.write(iter([page | {"page": "## src/f1.js\n\nmore 1\n"}, page | {"file": "src/f2.js.md", "page": "## src/f2.js\n\nmore 2\n"}]))
    with pytest.raises(OSError):
        w.commit([told, None])
    monkeypatch.setattr(vault.os, "replace", real)
    assert vault.cursor(str(top)) == 4
    assert note_files.sync_vault(n, str(tmp_path / "v")) == 0 and vault.cursor(str(top)) == 9  # the broken write counts, once
    text = "".join((top / f"src/f{k}.js.md").read_text() for k in (1, 2))
    assert text.count("more 1") == text.count("more 2") == 1 and not os.path.exists(top / vault.JOURNAL)
    both = spark.createDataFrame([(10, "a b", "one", "a", [], "t"), (11, "a_b", "two", "a", [], "t")], notes.SCHEMA)
    assert note_files.sync_vault(both, str(tmp_path / "v")) == 2 and "one" in (page := (top / "a_b.md").read_text()) and "two" in page


# --- git, notes, telemetry ---


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=A", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a.txt").write_text("one\n")
    run("add", ".")
    run("commit", "-m", "start")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    run("commit", "-am", "fix it")
    (tmp_path / "b.txt").write_text("new\n")
    s = git.status(spark, root).first()
    assert (s["branch"], s["untracked"], s["ahead"]) == ("main", ["b.txt"], 0)
    c, f = git.commits(spark, root), git.commit_files(spark, root)
    assert [r["message"] for r in history.log(c).collect()] == ["fix it", "start"]
    assert history.hotspots(c, f, days=3).first().asDict() == {"file": "a.txt", "edit_count": 2, "bug_fix_count": 1, "score": 4}
    b = git.blame(spark, root, "a.txt").orderBy("line").collect()
    assert [(r["line"], r["content"], r["author"]) for r in b] == [(1, "one", "A"), (2, "two", "A")]
    assert [(r["file"], r["line"]) for r in git.changed_lines(spark, root, "HEAD~1").collect()] == [("a.txt", 1), ("a.txt", 2)]


def test_notes(spark, tmp_path):
    path = str(tmp_path / "n" / "notes.jsonl")
    assert note_files.read(spark, path).count() == 0
    note_files.append(path, "../../outside", "hello", "agent", ["lesson"], "2026-05-19T00:00:00.000Z")
    with open(path, "a") as f:
        f.write("not json\n\n")
    n = note_files.read(spark, path)
    assert [(r["seq"], r["author"]) for r in n.collect()] == [(1, "agent")]
    vault = tmp_path / "vault"
    assert note_files.sync_vault(n, str(vault)) == 1
    assert (vault / "notes/_/_/outside.md").read_text().startswith("## ../../outside\n\n### 2026-05-19T00:00:00.000Z - lesson\n\nhello")
    assert note_files.sync_vault(n, str(vault)) == 0
    text = spark.createDataFrame([(1, "## Lessons Learned\n- see src/a/b.js now\n- abc\n## End\n- nothing here\n")], "id int, content string")
    assert [(r["seq"], r["target"]) for r in notes.ingest(text, "w", n, "t").collect()] == [(2, "src/a/b.js")]


def test_empty_telemetry(spark):
    calls = spark.createDataFrame([], "seq long, tool string, file_tokens long, response_tokens long")
    assert telemetry.report(calls).first()["average_tokens_saved"] == 0


def test_snapshots_hold_every_document(spark):
    """Both sides of the change queries have all documents, under some path."""
    from lodestone.plans.corpora import view

    sf = "/root/testdata/sf0.001"
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert any(i % 77 == 0 for i in ids)
    for side in ("disk", "stored"):
        assert {int(r["path"].split("/")[1]) for r in view(spark, sf, side).select("path").collect()} == ids


def test_numbers_of_an_order(spark):
    """Rows are numbered by ranges of an order as row_number() numbers them, without one partition for all rows."""
    from lodestone.plans import corpora

    rows = [(None if i % 50 == 0 else (i * 37) % 11, i) for i in range(1000)]
    t = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = corpora.numbered(t, F.col("a").desc_nulls_last(), F.col("b").asc_nulls_last())
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [(*r, n) for n, r in enumerate(want, 1)]
    assert corpora.numbered(t.limit(0), F.col("a")).count() == 0
    for name in corpora.NUMBERED:
        each = corpora.view(spark, "/root/testdata/sf0.001", name).groupBy(F.spark_partition_id()).count().collect()
        assert len(each) > 1 and max(r["count"] for r in each) < 0.9 * sum(r["count"] for r in each)
