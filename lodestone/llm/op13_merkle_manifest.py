"""Merkle dataset manifest: parent-preimage paths.

A row's leaf is the digest of its fields. The leaves of a group (a language) stand in the order of their ids; each run of
ARITY of them, the last one shorter, becomes a parent, and so on until one node is left, the group's subroot. Subroots,
in the order of their groups, become the root in the same way.

The manifest stores, for each parent, its preimage: the hex digests of its children, one after the other. So a proof
needs no list of siblings. Parents take their ancestors' preimages from the parent above, level by level downwards, and
each leaf joins its own parent once, with all that is above it. In a preimage a node's own digest is the 64 characters at
its place: cut out, what is left are its siblings (``siblings``); overwritten by another digest, it is the preimage as it
would be with that digest (``fold``).

Places come from a range partitioning over group and id, so a group of any size is spread over tasks: each task numbers
its sorted rows, and only a row for each task and group is summed over. Preimages are built and joined by (group, place),
of which no key has more than ARITY rows.

Defined results: a null field is ``-``; the null group is the first; rows with a null id stand before the others of their
group; rows of equal group and id are ordered by their digests, so repeated rows give the same tree in any order; a lone
row is its group's subroot and a lone subroot the root; an empty table has no root and gives no rows; columns beyond the
fields are not carried, so no name can clash; texts are hashed whole.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import discard, materialize, partitions_for

ARITY = 8
#: Hex characters of a digest.
WIDTH = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Bytes of leaf rows that one task sorts, about.
PART_BYTES = 16 << 20
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = "array<struct<pre: string, slot: int>>"


def digest(fields: list[Column]) -> Column:
    """sha256 in hex of the fields: ``-`` for a null, else byte count, colon, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the groups do, the null one first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with g) and of each its place ``pos`` in its group's order, from 0, and the group's size ``size``; written once."""
    n = partitions_for(rows, PART_BYTES)
    keys = ["g", *order, "_tie"]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    # The upper bits of the number are the task's, the lower ones count its rows.
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_at", 33).alias("_task")
    runs = rows.groupBy("g", task).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("g")
    before = F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    runs = runs.select("g", "_task", (F.col("_first") - before).alias("_shift"), F.sum("_n").over(group).alias("size"))
    rows = rows.withColumn("_task", task).join(runs, ["g", "_task"])
    return rows.withColumn("pos", F.col("_at") - F.col("_shift")).drop("_at", "_task", "_shift")


def _above(n: Column) -> Column:
    return F.floor((n + (ARITY - 1)) / ARITY).cast("long")


def parents(nodes: DataFrame) -> DataFrame:
    """(g, pos, size, pre) of the parents of nodes (g, pos, size, h), where a group has more than one."""
    run = F.sort_array(F.collect_list(F.struct("pos", "h")))
    rows = nodes.where("size > 1").groupBy("g", F.expr(f"pos div {ARITY}").alias("up")).agg(F.first("size").alias("size"), F.array_join(F.transform(run, lambda x: x["h"]), "").alias("pre"))
    return rows.select("g", F.col("up").alias("pos"), _above(F.col("size")).alias("size"), "pre")


def tree(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(the parents of each level, (g, h) of what remains of each group). leaves: g, pos, size, h."""
    most = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    levels, tops, nodes = [], [leaves.where("size = 1").select("g", "h")], leaves
    while most > 1:
        level = materialize(parents(nodes), f"level{len(levels) + 1}")
        nodes = level.select("g", "pos", "size", F.sha2("pre", 256).alias("h"))
        tops.append(nodes.where("size = 1").select("g", "h"))
        levels.append(level)
        most = -(-most // ARITY)
    return levels, functools.reduce(DataFrame.unionByName, tops)


def _step(pre: str, pos: str) -> Column:
    return F.struct(F.col(pre).alias("pre"), (F.col(pos) % ARITY).cast("int").alias("slot"))


def _joined(nodes: DataFrame, upper: DataFrame | None, ends: DataFrame) -> DataFrame:
    """nodes (g, pos, size and more) with ``path``: the preimages of all their ancestors, lowest first, and the place in each.

    upper: the parents (g, pos, pre, path); ends: (g, path) of the groups, above their last node.
    """
    out = nodes.where("size = 1").join(ends, "g")
    if upper is not None:
        up = upper.select("g", F.col("pos").alias("_up"), F.col("pre").alias("_pre"), F.col("path").alias("_path"))
        mine = nodes.where("size > 1").withColumn("_up", F.expr(f"pos div {ARITY}")).join(up, ["g", "_up"])
        mine = mine.withColumn("path", F.concat(F.array(_step("_pre", "pos")), "_path")).drop("_up", "_pre", "_path")
        out = mine.unionByName(out)
    return out


def _paths(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    upper = None
    for level in reversed(levels):
        upper = _joined(level, upper, ends)
    return _joined(leaves, upper, ends)


def siblings(path: str = "path") -> Column:
    """The digests beside a node and its ancestors, lowest level first, left to right, as one string."""
    return F.array_join(F.transform(path, lambda x: F.overlay(x["pre"], F.lit(""), x["slot"] * WIDTH + 1, F.lit(WIDTH))), "")


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf's digest gives with its original siblings."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.overlay(x["pre"], h, x["slot"] * WIDTH + 1, F.lit(WIDTH)), 256))


@dataclasses.dataclass
class Manifest:
    """leaves: the ids, g, pos, size, h and what was carried; levels: preimages of each level in the groups; subroots: g,
    pos, size, h; top: preimages above the subroots; root: None of an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None

    def paths(self) -> DataFrame:
        """The leaves with ``path`` (for ``siblings`` and ``fold``), ``subroot`` and ``root``."""
        tops = self.subroots.select(F.lit("").alias("g"), F.col("g").alias("_g"), "pos", "size", F.col("h").alias("subroot"))
        above = tops.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(PATH).alias("path"))  # of the root: nothing
        ends = _paths(tops, self.top, above)
        ends = materialize(ends.select(F.col("_g").alias("g"), "path", "subroot"), "ends")
        rows = _paths(self.leaves, self.levels, ends.select("g", "path"))
        return rows.join(ends.select("g", "subroot"), "g").withColumn("root", F.lit(self.root))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", **carried: Column) -> Manifest:
    """The manifest of docs; ``carried`` are further columns of the leaves, by name."""
    rows = docs.select(F.col(id_col), group_key(F.col(group_col)).alias("g"), digest([F.col(f) for f in fields]).alias("h"), *[c.alias(k) for k, c in carried.items()])
    rows = materialize(rows, "leaves")  # texts are read and hashed once; what follows sorts small rows
    leaves = materialize(placed(rows, id_col, "h"), "placed")
    discard(rows)
    levels, tops = tree(leaves.select("g", "pos", "size", "h"))
    subroots = placed(tops.select(F.lit("").alias("g"), F.col("g").alias("_g"), "h"), "_g")
    top, root = tree(subroots.select("g", "pos", "size", "h"))
    last = root.first()
    return Manifest(leaves, levels, subroots.select(F.col("_g").alias("g"), "pos", "size", "h"), top, last["h"] if last else None)


def differing(docs: DataFrame, of: Manifest, fields: list[str] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """(id, h, found): rows of docs whose digest, put in the place of the one in the manifest, does not give its root.

    Ids are unique in docs; those of only one side are not told (a join of ids tells them).
    """
    now = docs.select(F.col(id_col), digest([F.col(f) for f in fields]).alias("found"))
    rows = of.paths().join(now, id_col)
    return rows.where(fold(F.col("found")) != F.col("root")).select(id_col, "h", "found")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, digest([F.translate("text", *LOWER) if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, tampered=tampered).paths()
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "h")))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 8, top: int = 4) -> str:
    """The same by DuckDB: trees of up to ARITY to the power of ``levels`` rows a language, and so many of ``top`` languages."""

    def h(text: str) -> str:
        return f"sha256({' || '.join(f"coalesce(cast(strlen(v{i}) as varchar) || ':' || v{i}, '-')" for i in range(4))} || coalesce(cast(strlen({text}) as varchar) || ':' || {text}, '-'))"

    def level(k: int, of: str, name: str) -> str:
        left, right = "unbounded preceding and 1 preceding", "1 following and unbounded following"
        beside = [f"coalesce(string_agg(h, '') over (partition by g, p // {ARITY} order by p rows between {x}), '')" for x in (left, right)]
        return f"""{name}{k} as materialized (select g, p, h, n, case when n > 1 then {beside[0]} else '' end as l, case when n > 1 then {beside[1]} else '' end as r
  from (select *, count(*) over (partition by g) as n from ({of})))"""

    def up(k: int, name: str) -> str:
        return f"select g, p // {ARITY} as p, case when max(n) > 1 then sha256(string_agg(h, '' order by p)) else max(h) end as h from {name}{k} group by g, p // {ARITY}"

    parts = [level(0, "select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, leaf as h from leaves", "a")]
    parts += [level(k, up(k - 1, "a"), "a") for k in range(1, levels + 1)]
    parts += [level(0, f"select '' as g, row_number() over (order by g) - 1 as p, h from a{levels}", "b")]
    parts += [level(k, up(k - 1, "b"), "b") for k in range(1, top + 1)]
    steps = [(f"x{k}", f"join a{k} x{k} on x{k}.g = q.g and x{k}.p = q.p // {ARITY**k}") for k in range(levels)]
    steps += [(f"y{k}", f"join b{k} y{k} on y{k}.p = q.gp // {ARITY**k}") for k in range(top)]
    beside = " || ".join(f"{x}.l || {x}.r" for x, _ in steps)
    folds = ["select *, coalesce(tampered, leaf) as f0 from walk"]
    for k, (x, _) in enumerate(steps):
        folds.append(f"select *, case when n_{x} > 1 then sha256(l_{x} || f{k} || r_{x}) else f{k} end as f{k + 1} from ({folds[-1]})")
    codes = "list_transform(string_split(cast(doc_id as varchar), ''), lambda c: unicode(c)::bigint)"
    crc = f"list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"
    table = "select i, i::bigint as c from range(256) t(i)"
    for _ in range(8):
        table = f"select i, {step} as c from ({table})"
    return f"""
with tab as (select list(c order by i) as tab from ({table})),
d as (select doc_id, text, lang, cast(doc_id as varchar) as v0, source as v1, lang as v2, cast(n_chars as varchar) as v3 from documents),
leaves as materialized (select doc_id, coalesce('+' || lang, '') as g, {h("text")} as leaf,
  case when doc_id is not null and xor({crc}, 4294967295::bigint) % 3 = 0 then {h(f"translate(text, '{LOWER[0]}', '{LOWER[1]}')")} end as tampered from d, tab),
{", ".join(parts)},
q as materialized (select l.*, o.p as gp from (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p from leaves) l
  join (select g, row_number() over (order by g) - 1 as p from a{levels}) o on o.g = l.g),
root as (select h as root from b{top}),
walk as materialized (select q.*, s.h as subroot, root.root, sha256({beside}) as proof_sha256, {", ".join(f"{x}.l as l_{x}, {x}.r as r_{x}, {x}.n as n_{x}" for x, _ in steps)}
  from q {" ".join(j for _, j in steps)} join a{levels} s on s.g = q.g, root)
select doc_id, leaf, subroot, root, proof_sha256, f{len(steps)} as folded_root, f{len(steps)} = root as verified from ({folds[-1]})"""
