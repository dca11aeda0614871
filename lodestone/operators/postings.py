"""Gram postings: which blocks of a table hold a short string, in shards, so that a search opens few rows.

A table is cut into shards; in a shard its rows stand in numbered blocks, of a row or of many small ones. Postings tell, for
each gram (a few characters) and shard, the numbers of the blocks that hold it. A search reads the postings of its string's
grams, takes the blocks that hold all of them, and opens those. What it opens may hold no match, so the exact test comes
after; what holds a match is opened. A gram is a number of 63 bits, 21 for each character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.files import Folder
from ..sources.session import importable

#: Blocks up to which those that a search opens are named to the scan, which then skips other row groups; then blocks up to
#: which a list of them is broadcast (12 bytes each); beyond, the join shuffles.
FEW, BROADCAST_BLOCKS = 2000, 500_000
#: Parquet bytes of a row group of rows and of postings: what a search reads at least.
ROW_GROUP = 1 << 20
#: Grams of a string that are looked up; more cannot add rows.
MOST_GRAMS = 64
#: Stands for the last character of a gram of two, and is none itself. Characters that are looked at together.
_NONE, AT_ONCE = (1 << 21) - 1, 1 << 20


def grams_of(text: str, size: int) -> list[int]:
    """The distinct grams of two or three characters of a text, MOST_GRAMS of them at most."""
    chars = [ord(c) for c in text]
    each = ((chars[i] << 42) | (chars[i + 1] << 21) | (chars[i + 2] if size == 3 else _NONE) for i in range(len(chars) - size + 1))
    return list(dict.fromkeys(each))[:MOST_GRAMS]


def pairs(texts: list[str], numbers: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number) of the grams of these texts, each pair once, in order."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sizes:
        n = max(0, len(chars) - size + 1)
        whole = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
        last = chars[2:][:n] if size == 3 else np.full(n, _NONE, np.int64)
        grams.append(((chars[:n] << 42) | (chars[1:][:n] << 21) | last)[whole])
        of.append(numbers[row[:n][whole]])
    gram, number = np.concatenate(grams), np.concatenate(of)
    order = np.lexsort((number, gram))
    gram, number = gram[order], number[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (number[1:] != number[:-1])
    return gram[new], number[new]


def numbered(rows: DataFrame, shards: int, *order: str, block_bytes: Column | None = None, size: int = 1) -> DataFrame:
    """rows with shard, by a hash of the first of ``order``, and number, in this order within the shard: of each row, or of as
    many as ``block_bytes`` of them reach ``size``."""
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(order[0]), F.lit(shards)).cast("int"))
    w = Window.partitionBy("shard").orderBy(*order)
    number = F.row_number().over(w) if block_bytes is None else F.floor(F.sum(block_bytes).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / size).cast("int")
    return rows.withColumn("number", number)


def lists(rows: DataFrame, text: Column, *sizes: int) -> DataFrame:
    """(shard, gram, numbers): the postings of rows (with shard and number) by the grams of a text.

    A task turns the rows that it reads into lists, and those of one gram and shard are joined: what moves are lists, not
    pairs of grams and rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            shard, number, texts = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_pylist()
            upto = np.cumsum([len(t) for t in texts])
            cuts = np.append(np.flatnonzero((shard[1:] != shard[:-1]) | (upto[1:] // AT_ONCE != upto[:-1] // AT_ONCE)) + 1, len(texts)) if len(texts) else []
            lo = 0
            for hi in cuts:
                held.setdefault(int(shard[lo]), []).append(pairs(texts[lo:hi], number[lo:hi], sizes))
                lo = int(hi)
        for key, found in held.items():
            gram, number = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((number, gram))
            gram, number = gram[order], number[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
            each = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(number, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), key), pa.int32()), pa.array(gram[first]), each], names=["shard", "gram", "numbers"])

    importable(rows.sparkSession)
    some = rows.select("shard", "number", text.alias("text")).where("text is not null").mapInArrow(run, LISTS)
    return some.groupBy("shard", "gram").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))


def save(table: DataFrame, path: str, *order: str) -> None:
    """Writes a folder for each shard, sorted, in row groups that a search can skip."""
    table = table.withColumn("part", F.col("shard"))
    table.repartition("part").sortWithinPartitions("part", *order).write.option("parquet.block.size", ROW_GROUP).partitionBy("part").parquet(path)


def write(rows: DataFrame, path: str, text: Column, *sizes: int) -> None:
    """Writes rows (with shard and number) and the postings of a text's grams below path."""
    spark = rows.sparkSession
    Folder(spark, path).write("schema.json", rows.schema.json())  # an empty table writes no file that tells it
    save(rows, f"{path}/rows", "number")
    save(lists(spark.read.schema(rows.schema).parquet(f"{path}/rows"), text, *sizes), f"{path}/postings", "gram")


LISTS = "shard int, gram bigint, numbers array<int>"


class Postings:
    """Rows (with shard and number) and the postings of their grams."""

    def __init__(self, rows: DataFrame, lists: DataFrame):
        self.rows, self.lists = rows, lists

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Postings:
        """What ``write`` has written below path."""
        schema = StructType.fromJson(json.loads(Folder(spark, path).read("schema.json")))
        read = lambda kind, name: spark.read.schema(StructType([*kind.fields, StructField("part", IntegerType())])).parquet(f"{path}/{name}")
        return cls(read(schema, "rows"), read(StructType.fromDDL(LISTS), "postings"))

    def holding(self, wanted: list[int]) -> DataFrame:
        """(shard, number) of the blocks that hold all of these grams."""
        found = self.lists.where(F.col("gram").isin(wanted)).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.collect_list("numbers").alias("lists"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
        return found.where(F.col("n") == len(wanted)).select("shard", F.explode(both).alias("number"))

    def opened(self, which: DataFrame) -> DataFrame:
        """The rows of the blocks that (shard, number) name; few are named to the scan."""
        few = which.select("shard", "number").limit(FEW + 1).collect()
        if len(few) > FEW:
            shard = "part" if "part" in self.rows.columns else "shard"  # folders without such a block are not opened
            which = which.select(F.col("shard").alias(shard), "number").distinct()
            small = which.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
            return self.rows.join(F.broadcast(which) if small else which, [shard, "number"], "left_semi")
        if not few:
            return self.rows.where(F.lit(False))
        by_shard: dict[int, list[int]] = {}
        for r in few:
            by_shard.setdefault(r["shard"], []).append(r["number"])
        each = [(F.col("shard") == s) & F.col("number").isin(n) for s, n in by_shard.items()]
        some = self.rows.where(F.col("part").isin(list(by_shard))) if "part" in self.rows.columns else self.rows  # folders that are not opened
        return some.where(F.col("shard").isin(list(by_shard)) & F.col("number").isin(sorted({r["number"] for r in few}))).where(reduce(lambda a, b: a | b, each))
