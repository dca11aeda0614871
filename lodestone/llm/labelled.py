"""Labelled samples for the classifiers: bounded, deterministic, and never from held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, mod folds; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def sample_ids(labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows of either class that are not held out, those of the least hashes.

    A document labelled more than once counts once, with its largest label; null ids and labels are left out.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    each = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return each[0].unionByName(each[1])


#: Bytes of text of either class that one sample holds at most.
MAX_BYTES = 32 << 20


def sample_docs(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, y) of the sample: one row for each id (of several the least text), whole texts.

    Of either class those of the least hashes whose texts together have at most max_bytes; a text that no longer fits
    is left out. The ids broadcast, and the rows that the running sum sorts, are 2 * most at the very most.
    """
    ids = sample_ids(labels, label, folds, held, most)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    size = F.octet_length("text").cast("long")
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = one.select("doc_id", "text", "y", F.sum(F.when(size <= max_bytes, size)).over(upto).alias("__upto"), size.alias("__size"))
    return fits.where((F.col("__upto") <= max_bytes) & (F.col("__size") <= max_bytes)).select("doc_id", "text", "y")
