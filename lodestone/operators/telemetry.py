"""Token savings and costs of queries, from a log of calls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a million input tokens, dearest first (fixed values).
PRICES = {"large": 15.0, "medium": 3.0, "small": 0.8}


def cost(tokens: Column, price: float) -> Column:
    """Dollars, rounded half up to four places. In ten-thousandths it is a whole number, so sums are exact."""
    return units(tokens, price) / 10_000


def units(tokens: Column, price: float) -> Column:
    """Ten-thousandths of a dollar; prices have one place at most."""
    return F.floor((tokens * round(price * 10) + 500) / 1000)


def saved(file_tokens: Column, response_tokens: Column) -> Column:
    return F.greatest(F.lit(0), file_tokens - response_tokens)


def dollars(tokens: int, price: float) -> float:
    """``cost`` of a plain number."""
    return (tokens * round(price * 10) + 500) // 1000 / 10_000


def baseline(results: DataFrame, files: DataFrame) -> DataFrame:
    """(call, file_tokens): what reading the distinct files of each call's results would take; unknown files count 0.

    results: call, path; files: path, size_bytes; both with repo, if there are several repositories.
    """
    keys = [c for c in ("repo", "path") if c in results.columns and c in files.columns]
    tokens = files.select(*keys, F.ceil(F.col("size_bytes") / 4).cast("long").alias("t"))
    return results.select("call", *keys).distinct().join(tokens, keys, "left").groupBy("call").agg(F.sum(F.coalesce("t", F.lit(0))).alias("file_tokens"))


def savings(calls: DataFrame) -> DataFrame:
    """calls (seq, tool, file_tokens, response_tokens, ...) with tokens_saved and a cost for each price."""
    out = calls.withColumn("tokens_saved", saved(F.col("file_tokens"), F.col("response_tokens")))
    return out.withColumns({f"cost_{k}": cost(F.col("tokens_saved"), p) for k, p in PRICES.items()})


def report(calls: DataFrame) -> DataFrame:
    """One row: total_queries, total_tokens_saved, average_tokens_saved (half up) and a total cost for each price.

    A total adds costs that are each rounded, so the order does not matter and partial sums meet on the way.
    """
    s = savings(calls)
    total = s.agg(
        F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("total_tokens_saved"),
        *[(F.coalesce(F.sum(units(F.col("tokens_saved"), p)), F.lit(0)) / 10_000).alias(f"total_cost_{k}") for k, p in PRICES.items()],
    )
    average = F.when(F.col("total_queries") > 0, F.floor(F.col("total_tokens_saved") / F.col("total_queries") + 0.5)).otherwise(0)
    return total.select("total_queries", "total_tokens_saved", average.cast("long").alias("average_tokens_saved"), *[f"total_cost_{k}" for k in PRICES])


def by_tool(calls: DataFrame) -> DataFrame:
    return savings(calls).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_saved").alias("tokens_saved"))


#: Calls of one part of a log, whose running totals one task adds up.
PART_CALLS = 100_000


def meta(calls: DataFrame) -> DataFrame:
    """calls (seq, timing_ms, file_tokens, response_tokens) with what a result tells of its query.

    tokens_saved, a cost for each price, and totals up to and with this call in the order of seq: total_queries,
    total_tokens_saved and total costs. Calls without tokens count as queries and save nothing (timing only: the other
    columns are null). A log is added up in parts of PART_CALLS numbers; only a row for each part is gathered.
    """
    some = F.col("file_tokens").isNotNull() & F.col("response_tokens").isNotNull()
    amount = F.when(some, saved(F.col("file_tokens"), F.col("response_tokens")))
    rows = calls.withColumns({"tokens_saved": amount, "_part": F.floor(F.col("seq") / PART_CALLS)})
    adds = {"queries": F.lit(1), "tokens_saved": F.coalesce("tokens_saved", F.lit(0)), **{f"cost_{k}": F.coalesce(units(F.col("tokens_saved"), p), F.lit(0)) for k, p in PRICES.items()}}
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in adds.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in adds])
    inside = Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(base, "_part").select("*", *[(F.col(f"_{k}") + F.sum(c).over(inside)).alias(f"t_{k}") for k, c in adds.items()])
    told = lambda c: F.when(some, c)
    return out.select(
        *calls.columns, "tokens_saved", F.col("t_queries").alias("total_queries"), told(F.col("t_tokens_saved")).alias("total_tokens_saved"), told(F.lit("byte_approx")).alias("estimate_method"),
        *[cost(F.col("tokens_saved"), p).alias(f"cost_{k}") for k, p in PRICES.items()], *[told(F.col(f"t_cost_{k}") / 10_000).alias(f"total_cost_{k}") for k in PRICES],
    )


PARTS = "part bigint, queries bigint, tokens_saved bigint, " + ", ".join(f"units_{k} bigint" for k in PRICES)


def added(calls: DataFrame, part_calls: int = PART_CALLS) -> DataFrame:
    """The totals of new calls by part of the log (PARTS): what ``advance`` merges."""
    rows = savings(calls)
    amount = F.coalesce("tokens_saved", F.lit(0))
    return rows.groupBy(F.floor(F.col("seq") / part_calls).cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("queries"), F.sum(amount).cast("long").alias("tokens_saved"), *[F.sum(units(amount, p)).cast("long").alias(f"units_{k}") for k, p in PRICES.items()]
    )


def advance(parts: DataFrame | None, calls: DataFrame, part_calls: int = PART_CALLS) -> DataFrame:
    """Totals by part (PARTS) with new calls added: the calls that are in them already are not read again."""
    new = added(calls, part_calls)
    if parts is None:
        return new
    both = parts.unionByName(new)
    return both.groupBy("part").agg(*[F.sum(c).cast("long").alias(c) for c in both.columns if c != "part"])


def report_of(parts: DataFrame) -> DataFrame:
    """As ``report``, from totals by part."""
    total = parts.agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("q"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("t"), *[(F.coalesce(F.sum(f"units_{k}"), F.lit(0)) / 10_000).alias(f"total_cost_{k}") for k in PRICES])
    average = F.when(F.col("q") > 0, F.floor(F.col("t") / F.col("q") + 0.5)).otherwise(0)
    return total.select(F.col("q").alias("total_queries"), F.col("t").alias("total_tokens_saved"), average.cast("long").alias("average_tokens_saved"), *[f"total_cost_{k}" for k in PRICES])


def inject_meta(text: str, told: dict) -> str:
    """A result's text with what is told of its query: in an object, beside a list, or after other text."""
    try:
        value = json.loads(text)
    except ValueError:
        return text + "\n" + json.dumps({"_meta": told}, indent=2, ensure_ascii=False)
    if isinstance(value, dict):
        return json.dumps(value | {"_meta": told}, indent=2, ensure_ascii=False)
    return json.dumps({"data": value, "_meta": told} if isinstance(value, list) else value, indent=2, ensure_ascii=False)
