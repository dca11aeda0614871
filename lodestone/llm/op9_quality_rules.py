"""Quality rules: a ledger of rule failures as bits.

Every rule is evaluated once and its failure goes into one bit of ``fail_bits`` beside the measurements that it was
judged on. Policies are versioned sets of rules, that is, bit masks, applied to the ledger afterwards without reading a
text again; ``ablation`` shows by bitwise aggregation what each rule of a policy removes, alone and at all.

Only DataFrame functions are used: there is no shuffle up to the verdict, and no Python on the executors.

Defined results: a null text counts as an empty one (no words, fails ``min_words``); repeated rows give repeated rows;
ties cannot occur; an empty table gives an empty ledger; columns of the input beyond ``id_col`` and ``text_col`` are not
carried, so no name can clash; very long texts cost n log n of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Fixed order: a rule's place is its bit. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("min_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
]

POLICIES: dict[str, list[str]] = {
    "base": ["min_words", "repeat_words"],
    "v1": ["min_words", "repeat_words", "symbol_ratio", "dup_lines", "short_words", "long_words"],
    "v2": ["min_words", "repeat_words", "symbol_ratio", "dup_lines", "short_words", "long_words", "capitals"],
}
CURRENT = "v2"


def mask(policy: str) -> int:
    """The bits of a policy's rules; an unknown policy or rule raises KeyError."""
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in POLICIES[policy])


def _without(col: str, chars: str) -> Column:
    out = F.col(col)
    for c in chars:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each text, one row for each input row."""
    df = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_b", F.btrim("_t", F.lit(WS)))
    df = df.select(
        id_col,
        F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", r"[ \t-\r]+")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("_l"),
        F.char_length(_without("_t", WS)).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(_without("_t", SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    # A place needs _p bits; the window's hash fills the rest, so that one sort of longs brings equal windows together.
    df = df.withColumn("_p", F.expr("cast(length(bin(size(_w))) as int)"))
    df = df.withColumn(
        "_s",
        F.expr(
            """if(size(_w) >= 3, sort_array(transform(sequence(0, size(_w) - 3),
               i -> shiftleft(shiftrightunsigned(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _p), _p) | cast(i as bigint))), array())"""
        ),
    )
    # Equal hashes are confirmed on the words themselves.
    same = """(shiftrightunsigned(x, _p) = shiftrightunsigned({y}, _p)
               and _w[int(x & (shiftleft(1L, _p) - 1))] = _w[int({y} & (shiftleft(1L, _p) - 1))]
               and _w[int(x & (shiftleft(1L, _p) - 1)) + 1] = _w[int({y} & (shiftleft(1L, _p) - 1)) + 1]
               and _w[int(x & (shiftleft(1L, _p) - 1)) + 2] = _w[int({y} & (shiftleft(1L, _p) - 1)) + 2])"""
    df = df.withColumn(
        "_r",
        F.expr(f"filter(_s, (x, k) -> (k > 0 and {same.format(y='_s[k - 1]')}) or (k < size(_s) - 1 and {same.format(y='_s[k + 1]')}))"),
    )
    # The zero keeps the optimizer from pushing a filter on a measurement below this point, where it would copy the sorted
    # windows into the filter's lambda and compute them again for every window.
    return df.select(
        id_col,
        (F.size("_w").cast("long") + F.spark_partition_id() * 0).alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            """aggregate(sort_array(transform(_r, x -> x & (shiftleft(1L, _p) - 1))), named_struct('e', 0L, 't', 0L),
               (a, p) -> named_struct('e', p + 3L, 't', a.t + p + 3L - greatest(p, a.e)), a -> a.t)"""
        ).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        "n_capitals",
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i of RULES fails."""
    bits = " | ".join(f"if({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES))
    return measure(df, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, and those that fail it alone (kept if it went)."""
    m = mask(policy)
    rules = [(i, n) for i, (n, _) in enumerate(RULES) if m >> i & 1]
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("n", "b", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in rules])).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.lit(mask("base")).cast("long")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"),
        "kept", "fail_bits",
    )


def oracle() -> str:
    bits = " + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))
    return rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from t),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
rep as (select doc_id, count(*) as n from (select distinct doc_id, unnest([i, i + 1, i + 2]) as p from dup) group by doc_id),
li as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
       from (select doc_id, unnest(string_split(t, chr(10))) as l from t)
       where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
             cast(coalesce(li.n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(li.n_lines, 0) as bigint) as n_lines,
             cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
      from w left join li using (doc_id) left join rep using (doc_id)),
f as (select *, cast({bits} as bigint) as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask("base")}) <> 0 as base_failed, (fail_bits & {mask(CURRENT)}) = 0 as kept, fail_bits
from f"""
