"""Chat formatting: cumulative snapshots collapse, then conversations are rendered.

A logged conversation often comes again and again, each time with its next turns. Two 64-bit hashes run over a
conversation's turns (an exclusive-or of each turn's hash with its place), so every prefix has its own pair. A
conversation whose whole hash is a strict prefix's hash of another is left out by an anti-join, equal ones are left but
for the least id, and the maximal ones are rendered.

Only DataFrame functions are used. The order of turns needs the turns of one conversation in one sorted (spilling)
window; hashes of whole conversations and copies are aggregated before they are shuffled.

Defined results: turns go by turn, then role, then text, nulls first; a repeated row is a repeated turn; a null role is
``unknown`` and a null text empty, for the hashes too; rows with a null conv_id are one conversation with a null id; an
empty table gives no rows; other columns are not carried, so no name can clash. A marker inside a text is escaped, so
rendered conversations can be split again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text, p1, p2: each turn with the hashes of the prefix that it ends."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(w).cast("long"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = [F.xxhash64("place", "role", "text", F.lit(salt)) for salt in ("a", "b")]
    return rows.select("conv_id", "place", "role", "text", *[F.bit_xor(m).over(running).alias(f"p{i + 1}") for i, m in enumerate(mark)])


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: conversations that prefix no longer one, one of each; rows: turns()."""
    whole = rows.groupBy("conv_id").agg(F.max_by(F.struct("place", "p1", "p2"), "place").alias("end")).select("conv_id", "end.*")
    ends = whole.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    last = Window.partitionBy("conv_id")
    inside = rows.select("place", "p1", "p2", F.max("place").over(last).alias("n")).where("place < n").select("place", "p1", "p2").distinct()
    return ends.join(inside, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def _rendered() -> Column:
    text = F.replace("text", F.lit("<|"), F.lit("<\\|"))
    role = F.replace("role", F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: one row for each maximal conversation."""
    rows = turns(conversations)
    keep = maximal(rows).withColumnRenamed("conv_id", "kept_id")
    body = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", _rendered().alias("r")))).alias("t"))
    body = body.select("conv_id", F.array_join("t.r", "").alias("rendered"))
    return keep.join(body, F.col("kept_id").eqNullSafe(F.col("conv_id"))).select("conv_id", "n_turns", "n_copies", "rendered")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    mark = r"replace({}, '<|', '<\|')"
    return f"""
with r as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
             count(*) over (partition by conv_id) as n,
             '<|' || {mark.format("role")} || '|>' || chr(10) || {mark.format("text")} || '<|end|>' || chr(10) as piece from r),
p as (select conv_id, place, n, string_agg(piece, '') over (partition by conv_id order by place rows between unbounded preceding and current row) as prefix from o),
e as (select place as n_turns, prefix as rendered, min(conv_id) as conv_id, count(*) as n_copies from p where place = n group by place, prefix)
select conv_id, cast(n_turns as bigint) as n_turns, cast(n_copies as bigint) as n_copies, rendered from e
where not exists (select 1 from p where p.place < p.n and p.place = e.n_turns and p.prefix = e.rendered)"""
