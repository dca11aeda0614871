"""Annotations and what workers learned: recall, patterns, lessons, hand-over sections, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, trim

SCHEMA = "seq bigint, target string, note string, author string, tags array<string>, timestamp string"
#: The patterns of hand-over texts (fixed values): the heading of lessons, a bullet, a file named in it.
SECTION = r"(?i)^##\s+(Lessons\s+Learned|What\s+We\s+Learned|Key\s+Learnings?)\s*$"
BULLET = r"^[-*]\s+(.+)$"
TARGET = r"(\w+/[\w./]+\.\w+)"


def recall(notes: DataFrame, target: str) -> DataFrame:
    """Notes on a target; of a symbol (file:symbol) also those on its file."""
    wanted = [target, target.split(":", 1)[0]] if ":" in target else [target]
    return notes.where(F.col("target").isin(*wanted)).orderBy("seq")


def patterns(notes: DataFrame, directory: str) -> DataFrame:
    return notes.where(F.col("target").startswith(directory) & F.array_contains("tags", "pattern")).orderBy("seq")


def lessons(notes: DataFrame, tag: str | None = None) -> DataFrame:
    out = notes.where(F.array_contains("tags", "lesson"))
    return (out.where(F.array_contains("tags", tag)) if tag else out).orderBy("seq")


def extract_lessons(texts: DataFrame) -> DataFrame:
    """(id, n, text, target) from hand-over texts (id, content): bullets of the first lessons section, five letters up."""
    rows = texts.select("id", F.posexplode(lines(F.col("content"))).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.sum(F.when(F.col("line").rlike(SECTION), 1).otherwise(0)).over(w))
    first = F.min(F.when(F.col("line").rlike(SECTION), F.col("n"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("first", first)
    after = F.min(F.when(F.col("line").rlike(r"^##\s+") & (F.col("n") > F.col("first")), F.col("n"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("end", after).where("k > 0 and n > first and (end is null or n < end)")
    text = trim(F.regexp_extract("line", BULLET, 1))
    rows = rows.where(F.col("line").rlike(BULLET)).select("id", "n", text.alias("text")).where(F.length("text") >= 5)
    target = F.regexp_extract("text", TARGET, 1)
    return rows.select("id", "n", "text", F.when(target != "", target).otherwise("global").alias("target"))


def ingest(texts: DataFrame, worker: str, notes: DataFrame, timestamp: str) -> DataFrame:
    """New notes from hand-over texts, tagged lesson and handover, numbered after the notes there are."""
    found = extract_lessons(texts)
    # Numbers within each text, after those of the texts before it and of the notes there are: a row for each text is summed over.
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("id", before.alias("base")).crossJoin(notes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return found.withColumn("place", place).join(base, "id").select(
        (F.col("last") + F.col("base") + F.col("place")).cast("long").alias("seq"), "target", F.col("text").alias("note"), F.lit(worker).alias("author"),
        F.array(F.lit("lesson"), F.lit("handover")).alias("tags"), F.lit(timestamp).alias("timestamp"),
    )


def report(notes: DataFrame) -> DataFrame:
    """(group, key, n): totals, and counts by tag, author and target; blanks count as unknown and global."""
    each = notes.select(
        F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")).alias("author"),
        F.coalesce(F.nullif("target", F.lit("")), F.lit("global")).alias("target"),
    )
    keys = F.concat(
        F.array(F.struct(F.lit("total").alias("group"), F.lit("notes").alias("key"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("group"), t.alias("key"))),
        F.array(F.struct(F.lit("author").alias("group"), F.col("author").alias("key")), F.struct(F.lit("target").alias("group"), F.col("target").alias("key"))),
    )
    return each.select(F.explode(keys).alias("k")).groupBy("k.group", "k.key").agg(F.count(F.lit(1)).alias("n"))


def recent_lessons(notes: DataFrame, n: int = 10) -> DataFrame:
    """The last n lessons, oldest first."""
    return lessons(notes).orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def vault_pages(notes: DataFrame, since: int = 0) -> DataFrame:
    """(target, page): Markdown of the notes after a cursor, grouped by target, in their order."""
    section = F.concat(F.lit("### "), "timestamp", F.lit(" - "), F.array_join("tags", ", "), F.lit("\n\n"), "note", F.lit("\n"))
    grouped = notes.where(F.col("seq") > since).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("seq", section.alias("s")))).alias("x"))
    return grouped.select("target", F.concat(F.lit("## "), "target", F.lit("\n\n"), F.array_join("x.s", "\n")).alias("page"))
