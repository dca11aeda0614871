"""Notes as JSON lines, and a Markdown vault that they are written to."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vault import sync_vault  # noqa: F401  notes go to a vault from here

LINE = "target string, note string, author string, tags array<string>, timestamp string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Notes numbered in their order; blank and malformed lines are left out. A missing file has none."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "seq bigint, " + LINE)
    rows = spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path).where("target is not null or note is not null")
    # Places within the parts that the files are read in, and a row for each part to number them through.
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = parts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    seq = (F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return rows.join(base, "_part").select(seq.alias("seq"), *[f.split()[0] for f in LINE.split(", ")])


def append(path: str, target: str, note: str, author: str | None = None, tags: list[str] | None = None, timestamp: str = "") -> dict:
    """Adds one note; author unknown and no tags by default."""
    entry = {"target": target, "note": note, "author": author or "unknown", "tags": tags or [], "timestamp": timestamp}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return entry


def safe_relative(path: str) -> str:
    """A path for a file below a directory, whatever the target is called."""
    parts = [re.sub(r"[^A-Za-z0-9._-]", "_", p) for p in re.split(r"[\\/]+", path)]
    parts = ["_" if p in (".", "..") else p for p in parts if p]
    return "/".join(parts) or "global"


def write_entry(vault: str, entry: dict, folder: str = "notes") -> str:
    """One Markdown file for a note, named by its time and target, with its fields in front; returns its path."""
    stamp = re.sub(r"[:.]", "-", entry["timestamp"])
    name = re.sub(r"-+", "-", re.sub(r"[/:.\\]", "-", entry["target"]))
    path = os.path.join(vault, folder, f"{stamp}-{name}.md")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"---\ntarget: {entry['target']}\nauthor: {entry.get('author') or 'unknown'}\ntags: [{', '.join(entry.get('tags') or [])}]\ndate: {entry['timestamp']}\n---\n\n{entry['note']}\n")
    return path
