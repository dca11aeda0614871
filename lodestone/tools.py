"""Named tools over an index, one repository or several, each giving JSON; ``python -m lodestone.tools ROOT`` serves them.

A tool reads tables and returns a DataFrame, a text or a plain value. The line protocol is one JSON object a line: {"tool":
name, "arguments": {...}} in, the tool's result out. With the result goes what the query saved against reading the files
that it stands for, and the totals of all queries so far, which last from session to session in a small file.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import subprocess
import sys
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import source_type
from .operators import history, parse_code, search, telemetry
from .operators import notes as noted
from .sources import config, git, repo
from .sources import notes as note_files
from .sources.repo import read_files
from .sources.session import stored

#: Rows of a result that are shown at most; one more is asked for, so that a cut is told.
MOST_ROWS = 1000


class Cut(list):
    """Rows of a result that has more of them."""


def rows_of(value: DataFrame, most: int = MOST_ROWS) -> list:
    rows = [json.loads(x) for x in value.limit(most + 1).toJSON().collect()]
    return rows if len(rows) <= most else Cut(rows[:most])


def to_json(value: Any) -> str:
    """Rows as a JSON list, in their order; text as it is; other values as JSON."""
    if isinstance(value, DataFrame):
        value = rows_of(value)
    return value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)


class Repos:
    """Repositories by name: their files, symbols, imports and tags as tables with a column repo."""

    def __init__(self, spark: SparkSession):
        self.spark, self.roots = spark, {}
        self.tables: dict[str, DataFrame] = {}
        self.pending: dict[str, threading.Thread] = {}

    def add(self, name: str, files: DataFrame, root: str = "") -> dict:
        """Indexes files (path, content) under a name; an error if it is taken."""
        if name in self.roots:
            return {"error": f"Repo '{name}' already exists"}
        new = self._index(name, files)
        self.tables = {key: self.tables[key].unionByName(table) if key in self.tables else table for key, table in new.items()}
        self.roots[name] = root
        own = self.tables["files"].where(F.col("repo") == name).count(), self.tables["symbols"].where(F.col("repo") == name).count()
        return {"added": name, "root": root, "files": own[0], "symbols": own[1]}

    def _index(self, name: str, files: DataFrame) -> dict[str, DataFrame]:
        """The tables of a repository's files, written, for tools read them again and again."""
        symbols, imports, tags = parse_code.parse_tagged(files)
        new = {
            "files": repo.metadata(files).join(files.select("path", "content"), "path"),
            "symbols": symbols.withColumn("source_type", source_type(F.col("path"))),
            "imports": imports,
            "tags": tags,
        }
        return {key: stored(table.withColumn("repo", F.lit(name)), key) for key, table in new.items()}

    def add_root(self, root: str, name: str | None = None) -> dict:
        if not os.path.isdir(root):
            return {"error": f"Path does not exist: {root}"}
        return self.add(name or os.path.basename(os.path.abspath(root)), read_files(self.spark, root), root)

    def begin(self, root: str, name: str | None = None) -> None:
        """Indexes a folder while tools are served already: they answer from what is there, or tell that it is being indexed."""
        name = name or os.path.basename(os.path.abspath(root))

        def run() -> None:
            try:
                self.add_root(root, name)
            finally:
                self.pending.pop(name, None)

        self.pending[name] = threading.Thread(target=run, daemon=True)
        self.pending[name].start()

    def ready(self, timeout: float | None = None) -> bool:
        """Waits for what ``begin`` has begun; whether all of it is done."""
        for thread in list(self.pending.values()):
            thread.join(timeout)
        return not self.pending

    def reindex(self, name: str, path: str | None = None) -> dict:
        """Reads a repository's tree again, or one file of it; an error for links, folders and what is outside."""
        root = self.roots[name]
        if not root:
            return {"error": f"Repo '{name}' has no folder"}
        if path is not None:
            rel = repo.existing(root, path)
            if rel is None:
                return {"error": f"Not a file of the repo: {path}"}
            path = rel
        files = read_files(self.spark, root, None if path is None else [path])
        gone = F.col("repo") == name if path is None else (F.col("repo") == name) & (F.col("path") == path)
        new = self._index(name, files)
        self.tables = {key: table.where(~gone).unionByName(new[key]) for key, table in self.tables.items()}
        return {"reindexed": name if path is None else path}

    def names(self) -> list[str]:
        return sorted(self.roots)

    def listing(self) -> DataFrame:
        """(repo, root, files, symbols)."""
        roots = self.spark.createDataFrame(sorted(self.roots.items()), "repo string, root string")
        return roots.join(search.status_by_repo(self.tables["files"], self.tables["symbols"]).where("repo is not null"), "repo").select("repo", "root", "files", "symbols").orderBy("repo")

    def resolve(self, name: str | None) -> dict | None:
        """An error for an unknown name."""
        if name is None or name in self.roots:
            return None
        return {"error": f"Unknown repo: '{name}'. Available: {', '.join(self.names())}"}

    def only(self, name: str | None) -> str | None:
        """The repository that is named, or the only one there is."""
        return name if name is not None or len(self.roots) != 1 else self.names()[0]

    def table(self, key: str, name: str | None = None) -> DataFrame:
        return search.of_repo(self.tables[key], name)


def tools(repos: Repos, notes_path: str | None = None, vault: str | None = None) -> dict[str, Callable[..., Any]]:
    """Every tool by name. ``repo`` names a repository; searches without one cover all, and tell it with each row.

    Notes stand in ``notes_path``, by default in the first repository's folder; ``vault`` is where pages of them go.
    """
    spark = repos.spark

    def routed(f: Callable[..., Any]) -> Callable[..., Any]:
        def tool(*args, repo: str | None = None, **more):
            wrong = repos.resolve(repo)
            return wrong if wrong else f(lambda key: repos.table(key, repos.only(repo)), *args, **more)

        return tool

    def rooted(f: Callable[..., Any]) -> Callable[..., Any]:
        """Of tools about a folder: they need one repository, and git may refuse."""

        def tool(*args, repo: str | None = None, **more):
            wrong, name = repos.resolve(repo), repos.only(repo)
            if wrong or name is None:
                return wrong or {"error": f"Name one repo of: {', '.join(repos.names())}"}
            try:
                return f(name, *args, **more)
            except subprocess.CalledProcessError as e:
                return {"error": e.stderr.strip()}

        return tool

    def find_symbol(query: str, limit: int = 20, repo: str | None = None, **filters):
        wrong, name = repos.resolve(repo), repos.only(repo)
        if wrong:
            return wrong
        if name is None:
            return search.find_symbols_by_repo(repos.tables["symbols"], query, limit, **filters)
        return search.find_symbols(repos.table("symbols", name), query, limit, **filters)

    def limited(found: DataFrame, limit: int | None) -> DataFrame:
        return found.limit(limit) if limit else found

    def find_by_tag(t, tag: str, limit: int | None = None):
        tags, symbols = t("tags"), t("symbols")
        return search.find_by_tag_by_repo(tags, symbols, tag, limit).drop("place") if "repo" in tags.columns else search.find_by_tag(tags, symbols, tag, limit)

    def notes() -> DataFrame:
        return note_files.read(spark, where())

    def where() -> str:
        roots = [r for r in repos.roots.values() if r]
        return notes_path or os.path.join(roots[0] if roots else ".", ".lodestone", "notes.jsonl")

    def now() -> str:
        return dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def sync_notes(vault_path: str | None = None):
        place = vault_path or vault or os.environ.get("LODESTONE_VAULT")
        return {"synced": note_files.sync_vault(notes(), place)} if place else {"error": "No vault is named"}

    def ingest_handover(markdown: str, worker: str):
        found = noted.ingest(spark.createDataFrame([(0, markdown)], "id int, content string"), worker, notes(), now()).orderBy("seq").collect()  # bullets of one text
        for n in found:
            note_files.append(where(), n["target"], n["note"], n["author"], n["tags"], n["timestamp"])
        return {"ingested": len(found)}

    def spec(*rows) -> DataFrame:
        return spark.createDataFrame(list(rows), "ord int, path string, name string")

    return {
        "list_repos": repos.listing,
        "add_repo": repos.add_root,
        "reindex": rooted(repos.reindex),
        "status": lambda: search.status_by_repo(repos.tables["files"], repos.tables["symbols"]),
        "find_symbol": find_symbol,
        "find_text": routed(lambda t, pattern, limit=None, **kw: limited(search.find_text(t("files"), pattern, **kw), limit)),
        "find_references": routed(lambda t, name, limit=None: limited(search.find_references(t("files"), name), limit)),
        "find_by_tag": routed(find_by_tag),
        "find_importers": routed(lambda t, path: search.find_importers(t("imports"), path)),
        "outline": routed(lambda t, path: search.outline(t("symbols"), path)),
        "read_symbol": routed(lambda t, path, name: search.read_symbols(t("files"), t("symbols"), spec((0, path, name)))),
        "read_symbols": routed(lambda t, specs: search.read_symbols(t("files"), t("symbols"), spec(*((i, *x) for i, x in enumerate(specs)))).orderBy("ord")),
        "read_range": routed(lambda t, path, start=None, end=None: search.read_range(t("files"), path, start, end)),
        "context": routed(lambda t, path, name: search.context(t("files"), t("symbols"), t("imports"), path, name)),
        "tree": routed(lambda t, prefix=None, depth=None: search.tree(t("files"), prefix, depth)),
        "file": routed(lambda t, path: search.file_by_path(t("files"), path).drop("content")),
        "imports": routed(lambda t, path: search.imports_of(t("imports"), path)),
        "tags": routed(lambda t, path: search.tags_of(t("tags"), path)),
        "diagnostic": routed(lambda t: search.diagnostic(t("files"), t("symbols"), t("imports"), t("tags"))),
        "git_status": rooted(lambda name: git.status(spark, repos.roots[name])),
        "git_diff": rooted(lambda name, start=None, end=None, file=None: git.diff(repos.roots[name], start, end, file) or "(no changes)"),
        "git_blame": rooted(lambda name, path: git.blame(spark, repos.roots[name], path).orderBy("line")),
        "git_log": rooted(lambda name, file=None, max_count=None: history.log(git.commits(spark, repos.roots[name], max_count or 20, file), max_count=max_count or 20)),
        "git_hotspots": rooted(lambda name, days=None, limit=None: history.hotspots(git.commits(spark, repos.roots[name]), git.commit_files(spark, repos.roots[name]), days or 30, limit or 20)),
        "annotate": lambda target, note, author=None, tags=None: note_files.append(where(), target, note, author, tags, now()),
        "recall": lambda target: noted.recall(notes(), target),
        "patterns": lambda directory: noted.patterns(notes(), directory),
        "lessons": lambda tag=None: noted.lessons(notes(), tag),
        "sync_notes": sync_notes,
        "ingest_handover": ingest_handover,
        "learning_report": lambda: noted.report(notes()),
        "worker_config": config.worker,
    }


#: Tools that stand for reading one file, which their argument ``path`` names, and tools that stand for reading the files of
#: their rows, each once. The others tell their time only.
ONE_FILE = ("outline", "read_symbol", "read_range", "context")
EACH_FILE = ("read_symbols", "find_symbol", "find_text", "find_references", "find_importers", "find_by_tag")


class Session:
    """Calls of tools, with totals that are read from a file at the start and written to it after each call."""

    def __init__(self, repos: Repos, registry: dict[str, Callable[..., Any]], totals_path: str | None = None):
        self.repos, self.registry, self.totals_path = repos, dict(registry), totals_path
        self.totals = config.read_totals(totals_path) if totals_path else config.read_totals("")
        self.registry["telemetry"] = self.report

    def report(self) -> dict:
        """Totals so far, and tokens saved by a query on the average, half up."""
        n, saved = self.totals["total_queries"], self.totals["total_tokens_saved"]
        return self.totals | {"average_tokens_saved": int(saved / n + 0.5) if n else 0}

    def _file_tokens(self, name: str, value: Any, arguments: dict) -> int | None:
        """What reading the files would take that a tool's result stands for; None for tools that tell their time only."""
        only = self.repos.only(arguments.get("repo"))
        if name in ONE_FILE:
            wanted = {(only, arguments.get("path"))}
        elif name in EACH_FILE and isinstance(value, list):
            wanted = {(r.get("repo", only), r.get("path")) for r in value}
        else:
            return None
        wanted = {w for w in wanted if w[1]}
        if not wanted:
            return 0
        asked = self.repos.spark.createDataFrame([(0, *w) for w in wanted], "call int, repo string, path string")
        files = self.repos.tables["files"].select("repo", "path", "size_bytes")
        every = asked.where("repo is null").drop("repo").join(files.select("repo", "path"), "path").select("call", "repo", "path")
        row = telemetry.baseline(asked.where("repo is not null").unionByName(every), files).first()
        return int(row["file_tokens"] or 0) if row else 0

    def call(self, name: str, /, **arguments) -> str:
        """A tool's result as JSON, with what is told of its query."""
        if name not in self.registry:
            return to_json({"error": f"Unknown tool: '{name}'"})
        if not self.repos.tables and self.repos.pending:
            return to_json({"indexing": sorted(self.repos.pending)})
        start = time.perf_counter()
        value = self.registry[name](**arguments)
        value = rows_of(value) if isinstance(value, DataFrame) else value
        text = to_json(value)
        told: dict[str, Any] = {"timing_ms": round((time.perf_counter() - start) * 1000, 1)}
        if isinstance(value, Cut):
            told["cut_at"] = len(value)
        tokens = self._file_tokens(name, value, arguments)
        self.totals["total_queries"] += 1
        if tokens is not None:
            saved = max(0, tokens - -(-len(text.encode()) // 4))
            costs = {k: telemetry.dollars(saved, p) for k, p in telemetry.PRICES.items()}
            before = self.totals["total_cost_avoided"]
            self.totals["total_tokens_saved"] += saved
            self.totals["total_cost_avoided"] = {k: round(before.get(k, 0) + c, 4) for k, c in costs.items()}
            told |= {"tokens_saved": saved, "total_tokens_saved": self.totals["total_tokens_saved"], "estimate_method": "byte_approx", "cost_avoided": costs, "total_cost_avoided": self.totals["total_cost_avoided"]}
        if self.totals_path:
            config.write_totals(self.totals_path, self.totals)
        return telemetry.inject_meta(text, told)


def call(registry: dict[str, Callable[..., Any]], name: str, /, **arguments) -> str:
    """A tool's result as JSON, with its time; ``Session`` tells more."""
    if name not in registry:
        return to_json({"error": f"Unknown tool: '{name}'"})
    start = time.perf_counter()
    text = to_json(registry[name](**arguments))
    return telemetry.inject_meta(text, {"timing_ms": round((time.perf_counter() - start) * 1000, 1)})


def serve(ask: Callable[..., str] | dict[str, Callable[..., Any]], lines, out) -> None:
    """Answers one request a line until there are no more; a request that cannot be read gets an error."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            given = request.get("arguments", {})
            text = call(ask, request["tool"], **given) if isinstance(ask, dict) else ask(request["tool"], **given)
            answer = json.loads(text) if text[:1] in "{[" else {"text": text}
        except (ValueError, KeyError, TypeError) as e:
            answer = {"error": str(e)}
        out.write(json.dumps(answer, ensure_ascii=False) + "\n")
        out.flush()


if __name__ == "__main__":
    root = config.project_root(sys.argv[1] if len(sys.argv) > 1 else None)
    here = Repos(SparkSession.builder.appName("lodestone").getOrCreate())
    here.begin(root)
    serve(Session(here, tools(here), os.path.join(root, ".lodestone", "telemetry.json")).call, sys.stdin, sys.stdout)
