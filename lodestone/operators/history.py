"""Analytics of version history: hotspots, log, blame and changed lines, from tables or from git's own output."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOUNDARY, lines, trim
from .nesting import on_lines

#: What begins a commit's line in a log with names: a record separator, which stands in no path or subject.
MARK = "\x1e"


def hotspots(commits: DataFrame, commit_files: DataFrame, days: int = 30, limit: int = 20, as_of: dt.date | None = None) -> DataFrame:
    """file, edit_count, bug_fix_count, score = edits + 2 * fixes; the first ``limit`` by score, then by first mention.

    commits: seq (newest first), hash, message, date; commit_files: hash, file. A fix has the word in its subject.
    """
    day = (as_of or dt.datetime.now(dt.UTC).date()) - dt.timedelta(days=days)
    recent = commits.where(F.col("date") >= F.lit(day)).select("seq", "hash", F.concat_ws(" ", "hash", "message").rlike(f"(?i){BOUNDARY}fix{BOUNDARY}").alias("fix"))
    each = recent.join(commit_files, "hash").groupBy("file").agg(F.count(F.lit(1)).alias("edit_count"), F.count_if("fix").alias("bug_fix_count"), F.min("seq").alias("first_seen"))
    out = each.withColumn("score", F.col("edit_count") + 2 * F.col("bug_fix_count")).orderBy(F.col("score").desc(), "first_seen", "file")
    return out.limit(limit or 20).select("file", "edit_count", "bug_fix_count", "score")


def log(commits: DataFrame, commit_files: DataFrame | None = None, file: str | None = None, max_count: int = 20) -> DataFrame:
    """hash, message, date, author, email of the newest commits, of one file if it is given; 0 means 20."""
    out = commits
    if file is not None:
        out = out.join(commit_files.where(F.col("file") == file).select("hash").distinct(), "hash", "left_semi")
    return out.orderBy("seq").limit(max_count or 20).select("hash", "message", "date", "author", "email")


def numbered(text: DataFrame) -> DataFrame:
    """(id, n, line) of texts (id, content)."""
    return text.select("id", F.posexplode(lines(F.col("content"))).alias("n", "line"))


def blame(text: DataFrame, filled: bool = False) -> DataFrame:
    """(id, line, hash, author, timestamp, summary, content) from porcelain blame output (id, content).

    A header stands only on the first line of a commit's first group, so other lines have nulls; ``filled`` fills them
    from the commit's header.
    """
    rows = numbered(text)
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    rows = rows.withColumn("block", F.sum(F.col("line").rlike(head).cast("long")).over(Window.partitionBy("id").orderBy("n")))

    def pick(pattern: str, group: int = 1):
        return F.max(F.when(F.col("line").rlike(pattern) & ~F.col("line").startswith("\t"), F.regexp_extract("line", pattern, group)))

    out = rows.where("block > 0").groupBy("id", "block").agg(
        pick(head).alias("hash"), pick(head, 2).cast("int").alias("line"), pick(r"^author (.*)").alias("author"),
        pick(r"^author-time (\d+)").cast("long").alias("timestamp"), pick(r"^summary (.*)").alias("summary"),
        F.max(F.when(F.col("line").startswith("\t"), F.expr("substring(line, 2)"))).alias("content"),
    )
    if filled:
        w = Window.partitionBy("id", "hash")
        out = out.withColumns({c: F.max(c).over(w) for c in ("author", "timestamp", "summary")})
    return out.select("id", "line", "hash", "author", "timestamp", "summary", "content")


def diff_lines(text: DataFrame) -> DataFrame:
    """(id, file, line): new-side line numbers of a unified diff's hunks (id, content), context included."""
    rows = numbered(text)
    file = F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("file", F.last(file, ignorenulls=True).over(w))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    found = rows.where(F.col("line").rlike(hunk) & F.col("file").isNotNull())
    count = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")), F.lit("1")).cast("int")
    found = found.select("id", "file", F.regexp_extract("line", hunk, 1).cast("int").alias("start"), count.alias("k")).where("k > 0")
    return found.select("id", "file", F.explode(F.sequence("start", F.col("start") + F.col("k") - 1)).alias("line"))


def changed_symbols(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, ordinal, name) of symbols with a changed line (file, line)."""
    lines = changed.withColumnRenamed("file", "path").select("path", "line")
    return on_lines(lines, symbols).withColumnRenamed("path", "file")


def parse_log(raw: DataFrame) -> DataFrame:
    """(id, seq, hash, message, file) from a log with names: lines of MARK, hash, a blank and the subject, then files."""
    rows = numbered(raw)
    mark = F.when(F.col("line").startswith(MARK), F.struct(F.col("n").alias("seq"), F.regexp_extract("line", rf"^{MARK}(\S+)", 1).alias("hash"), F.regexp_extract("line", rf"^{MARK}\S+ ?(.*)", 1).alias("message")))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("c", F.last(mark, ignorenulls=True).over(w))
    named = rows.where(~F.col("line").startswith(MARK) & (trim(F.col("line")) != "") & F.col("c").isNotNull())
    return named.select("id", "c.seq", "c.hash", "c.message", trim(F.col("line")).alias("file"))
