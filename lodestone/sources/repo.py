"""Files of a source tree: which belong to it, their text and their metadata.

Only regular files inside the root are read; symbolic links and paths that leave the root are refused. Listing is done
where the tree is; reading is done in parallel.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language, lines, source_type
from .session import importable

#: Scanned extensions and ignored directories (fixed values).
EXTENSIONS = [
    ".js", ".jsx", ".cjs", ".mjs", ".ts", ".tsx", ".json", ".yaml", ".yml", ".graphql", ".gql", ".md", ".toml", ".xml", ".html", ".css", ".scss", ".less", ".vue", ".svelte",
]
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".worktrees", ".claude", ".codex", ".agents", ".runs", ".playwright-cli"]


def inside(root: str, path: str) -> str | None:
    """The path relative to root with forward slashes, or None if it leads outside."""
    rel = os.path.relpath(os.path.normpath(os.path.join(root, path)), root)
    if rel.startswith("..") or os.path.isabs(rel):
        return None
    return rel.replace(os.sep, "/")


def existing(root: str, path: str) -> str | None:
    """As inside(), for a regular file whose real place is below the real root; None for links and all else."""
    rel = inside(root, path)
    if rel is None:
        return None
    full = os.path.join(root, rel)
    try:
        if not stat.S_ISREG(os.lstat(full).st_mode):
            return None
    except OSError:
        return None
    real, top = os.path.realpath(full), os.path.realpath(root)
    return rel if os.path.commonpath([real, top]) == top else None


def ignored_names(more: list[str] | None = None) -> list[str]:
    """Directory names to skip; a glob **/X/** stands for X."""
    extra = [m[3:-3] if m.startswith("**/") and m.endswith("/**") else m for m in more or []]
    return list(dict.fromkeys(IGNORED + extra))


def is_ignored(path: Column, more: list[str] | None = None) -> Column:
    return F.arrays_overlap(F.split(path, r"[\\/]+"), F.array(*[F.lit(n) for n in ignored_names(more)]))


def file_extension(path: Column) -> Column:
    """The extension with its dot; none for a name that begins with its only dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def is_supported(path: Column, extensions: list[str] | None = None) -> Column:
    return file_extension(path).isin(*(EXTENSIONS if extensions is None else extensions))


def list_files(root: str, extensions: list[str] | None = None, ignore: list[str] | None = None) -> list[tuple[str, float, int]]:
    """(path, mtime, size) of the tree's files."""
    wanted, skip, out = set(EXTENSIONS if extensions is None else extensions), set(ignored_names(ignore)), []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip and not os.path.islink(os.path.join(top, d)))
        for name in sorted(names):
            if os.path.splitext(name)[1] in wanted and (rel := existing(root, os.path.relpath(os.path.join(top, name), root))):
                s = os.stat(os.path.join(root, rel))
                out.append((rel, s.st_mtime, s.st_size))
    return out


def read_files(spark: SparkSession, root: str, paths: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(path, content) of a tree that all executors can reach, or of some of its paths; invalid bytes become U+FFFD,
    unreadable files are left out. A whole tree is listed by the tasks that read it (``tree``)."""
    if paths is None:
        from .tree import read_tree

        return read_tree(spark, root).select("path", "content")
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    return read_paths(frame.repartition(partitions or max(1, min(len(paths) // 200 + 1, 10_000))), root)


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of paths (path) below root; links and what leads outside are left out, where the reading is done."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in filter(None, (existing(root, x) for x in b["path"])):
                try:
                    with open(os.path.join(root, p), encoding="utf-8", errors="replace", newline="") as f:
                        rows.append((p, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    importable(paths.sparkSession)
    return paths.select("path").mapInPandas(read, "path string, content string")


def metadata(files: DataFrame, indexed_at: str | None = None) -> DataFrame:
    """path, language, source_type, hash, size_bytes, line_count, indexed_at of files (path, content)."""
    content = F.col("content")
    at = F.lit(indexed_at).cast("timestamp") if indexed_at else F.date_trunc("second", F.current_timestamp())
    return files.select(
        "path", language(F.col("path")).alias("language"), source_type(F.col("path")).alias("source_type"), F.md5(content).alias("hash"),
        F.octet_length(content).cast("long").alias("size_bytes"), F.size(lines(content)).cast("long").alias("line_count"), at.alias("indexed_at"),
    )
