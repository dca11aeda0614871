"""URL filters: given host and path rules first, association rules mined from labels for the rest.

A URL is a set of tokens: scheme, host, the host's parent domains, path segments with their places, an extension, query
keys and values. Of tokens that stand on the same labelled pages the longest stands for all, so that a host and its
parents do not multiply the sets. FP-growth mines sets of the others together with a mark on the bad pages; rules that
end in the mark and have enough support and confidence are kept, without those that a kept shorter rule implies. The
inverted index lists a rule under its rarest token; a page fires a rule found there if it has all its tokens.

Mining runs on the cluster over all labelled pages; rules are few by their support (each holds for at least
MIN_COUNT labelled pages), and stay a table. It is broadcast if its size is below Spark's threshold, else it shuffles.
Equal sets of pages are told by their size and a sum of 62 bits.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no given rule and is allowed, for
it has no tokens; repeated rows give repeated rows; of given rules that fit equally long ones cannot differ in verdict
unless they are equal, and then the first wins; without labels no rules are mined and the method allows; an empty table
gives no rows; only page_id and url are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 20, 0.7
BAD = "!bad"
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns, empty where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; the rules are a parameter of fixed size."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s, i: F.concat(F.lit("s"), i.cast("string"), F.lit(":"), s))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda q: q != "")
    keys = F.transform(pairs, lambda q: F.concat(F.lit("k:"), F.split(q, "=")[0]))
    whole = F.transform(pairs, lambda q: F.concat(F.lit("q:"), q))
    scheme = F.array(F.concat(F.lit("p:"), F.lower(F.substring_index(url, "://", 1))))
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    end = F.when(ext != "", F.array(F.concat(F.lit("x:"), F.lower(ext)))).otherwise(F.array().cast("array<string>"))
    all_of = F.array_distinct(F.concat(scheme, domains, segments, keys, whole, end))
    return F.when(host != "", all_of).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, anchor, confidence, support): token sets of which labelled pages are bad. pages: page_id, tokens.

    A page is bad if any of its labels says low quality or toxic; pages without a label take no part. anchor is the
    token of the rule that the fewest labelled pages have.
    """
    marks = (
        labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"))
        .where("page_id is not null")
        .groupBy("page_id")
        .agg(F.max("bad").alias("bad"))
    )
    bag = pages.where(F.size("tokens") > 0).join(marks, "page_id")
    bag = materialize(bag.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-tokens")
    n = bag.count()
    need = max(min_count, math.ceil(min_support * n))
    if n < need:
        return pages.sparkSession.createDataFrame([], "rule_id bigint, tokens array<string>, anchor string, confidence double, support double")
    each = bag.select("row", "bad", F.explode("tokens").alias("token"))
    h = F.xxhash64("row")
    low, high = F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high")).where(F.col("n") >= need)
    chosen = seen.groupBy("n", "low", "high").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token"))
    chosen = materialize(chosen.select("token", "n"), "url-chosen")
    items = each.join(chosen, "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.max("bad").alias("bad"))
    items = materialize(items.select(F.when(F.col("bad") == 1, F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")), "url-items")
    # Half a page less, for the product of a share and a count may round up to the next page.
    sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / max(need, items.count())).fit(items).freqItemsets
    sets = materialize(sets.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq"), "url-sets")
    bad, all_of = sets.where("bad").select("tokens", F.col("freq").alias("hits")), sets.where("not bad").select("tokens", "freq")
    sure = bad.join(all_of, "tokens").where(F.col("hits") / F.col("freq") >= min_confidence)
    anchors = sure.select("tokens", F.explode("tokens").alias("token")).join(chosen, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    rules = sure.join(anchors, "tokens").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "anchor", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"))
    rules = materialize(rules, "url-rules")
    # A rule goes if another one's tokens are among its own: it would block nothing more.
    implied = fired(rules.select(F.col("rule_id").alias("key"), "tokens"), rules).where("key <> rule_id").select(F.col("key").alias("rule_id")).distinct()
    return materialize(rules.join(implied, "rule_id", "left_anti"), "url-rules")


def fired(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id, confidence): the rules whose tokens a row all holds. pages: key (each once), tokens."""
    index = rules.select("rule_id", "confidence", F.col("tokens").alias("asked"), F.col("anchor").alias("token"))
    found = pages.select("key", F.explode("tokens").alias("token")).join(index, "token").drop("token")
    return found.join(pages, "key").where(F.size(F.array_except("asked", "tokens")) == 0).select("key", "rule_id", "confidence")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence): rows that fire a rule, with the most certain one's confidence. pages: key (each once), tokens."""
    return fired(pages, rules).groupBy("key").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, given: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that fired, else null)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.xxhash64("url").alias("key"), "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    rules = mine(rows.select("page_id", "tokens"), labels)
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    urls = rows.where("given is null").select("key", "tokens").dropDuplicates(["key"])
    out = rows.join(matches(urls, rules), "key", "left")
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
