"""Spelling variants: words that differ by one edit, grouped under the form that is written most.

Words are counted by Spark's own functions. Near words come from a positional q-gram index with a count filter: a word of
L code points has L + 2 grams of three (two blanks pad each end), and of two words that differ by one edit the longer, of L
code points, shares at least L - 1 of its grams with the other, at the same place or, where it is longer, at most one
place on (the bound of ``overlaps``).

Routing. At most three grams of a word are lost by an edit, so near words share one of each other's four rarest grams.
A word is listed under those of its own, by gram, place and length, and looks up the same list and, for words longer by
one, the two lists that an insertion leads to. Lists of more than BLOCK words are cut into blocks, which all that look
them up visit; so no task holds more than a block of a list, however common its gram.

Merging. A task indexes the words of its lists by their other grams too. Of a word it merges the six shortest of these
postings, sorted, and keeps whoever occurs in three; those are held against the bound over all grams and then compared
letter by letter. One sort merges the postings of many words at once.

Forms are pointers to more frequent words (twice as frequent at least, so chains are short); roots follow by doubling the
pointers until none changes.

Defined results: null texts have no words; a row with a null id keeps its words undamaged; repeated rows count again;
ties are broken as stated; an empty table gives no rows; only the id and the text are carried, so other columns cannot
clash; texts and words of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import discard, materialize, tidy

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT = 5, 3
DAMAGE = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Grams that an edit changes at most, shortest postings that are merged.
LOST, MERGED = 3, 6
#: Words of a list that one task holds; routed rows in a task, about; postings merged at once.
BLOCK, PART_ROWS, POSTINGS = 20_000, 100_000, 4_000_000
#: Letters are numbered from 1: a to z, then U+00C0 to U+00FF; 0 pads. So there are at most 91 to the power of 3 grams.
_CODES = 91
_NUMBER = np.zeros(256, np.int64)
_NUMBER[97:123] = np.arange(1, 27)
_NUMBER[192:256] = np.arange(27, 91)
_U = np.uint64


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """One row ``word`` for each run of MIN_LENGTH letters or more. ``damage``: of runs whose checksum it divides, one letter goes."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{MIN_LENGTH},}}"), F.lit(0))).alias("word"))
    rows = rows.select("id", F.translate("word", UPPER, LOWER).alias("word"))
    if damage:
        rows = rows.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.expr("substring(word, cast(h % char_length(word) as int) + 2)"))
        rows = rows.select(F.when(F.col("h") % damage == 0, short).otherwise(F.col("word")).alias("word"))
    return rows.select("word").where(F.char_length("word") >= MIN_LENGTH)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of the words that occur MIN_COUNT times or more."""
    return runs_of_letters(docs, id_col, text_col, damage).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


class Grams:
    """The grams of the words of an Arrow column: code and place, words one after the other."""

    def __init__(self, words: pa.Array):
        text = "".join(words.to_pylist())
        letters = _NUMBER[np.frombuffer(text.encode("latin-1"), np.uint8)]
        self.length = np.asarray(pc.utf8_length(words), np.int64)
        self.count = self.length + 2
        self.first = np.cumsum(self.count) - self.count
        start = np.cumsum(self.length) - self.length
        self.letters, self.start = letters, start
        padded = np.zeros(int((self.length + 4).sum()), np.int64)
        word = np.repeat(np.arange(len(words)), self.length)
        padded[np.arange(len(letters)) + 4 * word + 2] = letters
        self.word = np.repeat(np.arange(len(words)), self.count)
        self.place = np.arange(len(self.word)) - self.first[self.word]
        at = np.arange(len(self.word)) + 2 * self.word
        self.code = (padded[at] * _CODES + padded[at + 1]) * _CODES + padded[at + 2]


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many words hold each gram, by code. At most 91 to the power of 3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)
        for b in batches:
            total += np.bincount(Grams(b.column(0)).code, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    out = np.zeros(_CODES**3, np.int64)
    table = words.select("word").mapInArrow(tidy(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[table["code"].to_numpy()] = table["n"].to_numpy()
    return out


#: key: a list's gram, place and length; role 0: listed there, looking for equal lengths; role 1: looking for longer words.
ROUTE = "key bigint, role int, word string, n bigint"


def routes(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """The lists under which each word stands and those which it looks up."""
    held = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = Grams(b.column(0))
            order = np.lexsort((g.code, held.value[g.code], g.word))
            word, code, place = g.word[order], g.code[order], g.place[order]
            new = np.ones(len(order), bool)
            new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))  # equal grams stand together
            pick = first - g.first[word] <= LOST
            word, code, place = word[pick], code[pick], place[pick]
            length = g.length[word]
            key = [_list(code, place, length), _list(code, place, length + 1), _list(code, place + 1, length + 1)]
            take = pa.array(np.tile(word, 3))
            role = np.repeat([0, 1, 1], len(word)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(role), b.column(0).take(take), b.column(1).take(take)], names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(tidy(run), ROUTE)


def _list(code: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    x = tv.mix64(code.astype(_U) ^ tv.mix64((place.astype(_U) << _U(32)) ^ length.astype(_U)))
    return x.view(np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, count numbers."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def merged(key: np.ndarray, listed: np.ndarray, role: np.ndarray, g: Grams, bound: int = POSTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (asking, listed) of one key whose shared grams reach the bound. Words of role 1 ask for one letter more."""
    at = np.flatnonzero(listed)
    posting = np.repeat(key, g.count)
    gram = tv.mix64(posting.astype(_U) ^ tv.mix64((g.place.astype(_U) << _U(32)) ^ g.code.astype(_U)))
    mine = _ranges(g.first[at], g.count[at])
    order = np.argsort(gram[mine], kind="stable")  # postings stay in the order of their rows
    index, holder = gram[mine][order], g.word[mine][order]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for longer in (False, True):
        ask = np.flatnonzero(role == int(longer))
        if not len(ask) or not len(index):
            continue
        q = _ranges(g.first[ask], g.count[ask])
        wanted = [gram[q]]
        if longer:
            moved = (g.place[q] + 1).astype(_U) << _U(32)
            wanted.append(tv.mix64(posting[q].astype(_U) ^ tv.mix64(moved ^ g.code[q].astype(_U))))
        low = [np.searchsorted(index, w, "left") for w in wanted]
        size = [np.searchsorted(index, w, "right") - a for w, a in zip(wanted, low, strict=True)]
        total = sum(size)
        # The shortest postings of each word: whoever lacks more than LOST of them is not near.
        by = np.lexsort((total, g.word[q]))
        new = np.ones(len(by), bool)
        new[1:] = g.word[q][by][1:] != g.word[q][by][:-1]
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        short = by[nth < MERGED]
        short = short[np.argsort(g.word[q][short], kind="stable")].reshape(-1, MERGED)  # every word has as many grams
        upto, begin = np.cumsum(total[short].sum(1)), 0
        while begin < len(short):  # some words at a time
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + bound, "right")))
            part = short[begin:end].ravel()
            begin = end
            who = np.concatenate([np.repeat(g.word[q[part]], s[part]) for s in size])
            whom = holder[np.concatenate([_ranges(a[part], s[part]) for a, s in zip(low, size, strict=True)])]
            code = np.sort((who.astype(_U) << _U(32)) | whom.astype(_U))
            need = MERGED - LOST
            far = code[need - 1 :] == code[: len(code) - need + 1] if len(code) >= need else np.zeros(0, bool)
            pairs = np.unique(code[: len(far)][far])
            a, b = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
            good = (a != b) & (overlaps(a, b, g) >= g.length[b] - 1)
            out.append((a[good], b[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def overlaps(a: np.ndarray, b: np.ndarray, g: Grams) -> np.ndarray:
    """Grams of a that b has too: at the same place, or one place on where b is the longer one."""
    count = g.count[a]
    pair = np.repeat(np.arange(len(a)), count)
    x, y = _ranges(g.first[a], count), _ranges(g.first[b], count)
    same = g.code[x] == g.code[y]
    longer = (g.count[b] > count)[pair]
    same |= longer & (g.code[x] == g.code[np.minimum(y + 1, len(g.code) - 1)])
    return np.bincount(pair, same, len(a)).astype(np.int64)


def one_edit(a: np.ndarray, b: np.ndarray, g: Grams) -> np.ndarray:
    """True where exactly one letter of a is replaced in b, or one is inserted."""
    length = g.length[a]
    pair = np.repeat(np.arange(len(a)), length)
    x, y = g.letters[_ranges(g.start[a], length)], _ranges(g.start[b], length)
    longer = g.length[b] == length + 1
    differ = x != g.letters[y]
    n = np.bincount(pair, differ, len(a))
    # Letters before the first difference agree in place; with an insertion all others agree one place on.
    place = np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length)
    first = length.copy()
    np.minimum.at(first, pair[differ], place[differ])
    moved = x != g.letters[np.minimum(y + 1, len(g.letters) - 1)]
    wrong = np.bincount(pair, moved & (place >= first[pair]), len(a))
    return np.where(longer, wrong == 0, (g.length[b] == length) & (n == 1))


PAIR = "a string, an bigint, b string, bn bigint"
_PAIR = pa.schema([("a", pa.string()), ("an", pa.int64()), ("b", pa.string()), ("bn", pa.int64())])


def _near(table: pa.Table) -> pa.Table:
    """Of a part's lists (key, block, role, listed, word, n): the pairs of near words, each with a before b."""
    key = np.asarray(table["key"]).astype(_U) ^ tv.mix64(np.asarray(table["block"]).astype(_U))
    _, key, size = np.unique(key, return_inverse=True, return_counts=True)
    table = table.append_column("k", pa.array(key)).filter(pa.array((size > 1)[key]))
    if not len(table):
        return _PAIR.empty_table()
    table = table.combine_chunks()
    word, n, key = table["word"].combine_chunks(), table["n"].combine_chunks(), np.asarray(table["k"])
    g = Grams(word)
    a, b = merged(key, np.asarray(table["listed"]), np.asarray(table["role"]), g)
    good = one_edit(a, b, g)
    a, b = a[good], b[good]
    cols = [word.take(pa.array(a)), n.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))]
    swap = pc.greater(cols[0], cols[2])
    cols = [pc.if_else(swap, cols[(i + 2) % 4], c) for i, c in enumerate(cols)]
    return pa.Table.from_arrays(cols, schema=_PAIR).group_by(["a", "an", "b", "bn"]).aggregate([])


def near_pairs(words: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, an, b, bn): each pair of words (word, n; each word once) that differ by one edit, a before b, with their counts."""
    rows = materialize(routes(words, _gram_counts(words)), "routes")
    blocks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block).select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    rows = rows.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.select("*", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.withColumn("listed", (F.col("role") == 0) & (F.col("home") == F.col("block"))).drop("blocks", "home")
    least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.select("block").count()
    parts = max(least, total // part_rows + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "block"), F.lit(parts)).cast("int"))
    out = materialize(rows.repartition(parts, "part").groupBy("part").applyInArrow(_near, PAIR), "near")
    discard(blocks)
    return out.distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    has = -F.col("best.less") >= 2 * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    to = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = new.where("moved").limit(1).count()
        discard(to)
        to = new.drop("moved")
        to.__dict__["_scratch"] = new.__dict__["_scratch"]
        if not more:
            break
    return rows.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return forms(words, near_pairs(words)).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The same by DuckDB: near words by equal remains after one deletion, then by counting unequal letters."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"
    table = "select i, i::bigint as c from range(256) t(i)"
    for _ in range(8):
        table = f"select i, {step} as c from ({table})"
    utf8 = "flatten(list_transform(string_split(s, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 | (unicode(c) >> 6))::bigint, (128 | (unicode(c) & 63))::bigint] end))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {utf8}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)"
    return f"""
with recursive tab as (select list(c order by i) as tab from ({table})),
run as (select doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}+')), '{UPPER}', '{LOWER}') as w from documents),
each as (select doc_id, w, count(*) as c, cast(doc_id as varchar) || ':' || w as s from run where length(w) >= {MIN_LENGTH} group by doc_id, w),
sums as (select w, c, {crc} as h from each, tab),
word as (select case when h % {DAMAGE} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, sum(c)::bigint as n from sums group by 1),
v as materialized (select word, n from word where length(word) >= {MIN_LENGTH} and n >= {MIN_COUNT}),
del as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from v)),
near as materialized (
  select a.word, b.word as near, b.n as near_n from del a join del b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from del a join v b on a.rest = b.word
  union select b.word, a.word, a.n from del a join v b on a.rest = b.word),
best as (select word, count(*) as n_near, min(struct_pack(less := -near_n, near := near)) as best from near group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.less >= 2 * v.n then best.near end as form, case when -best.less >= 2 * v.n then -best.less end as form_n from v left join best using (word)),
walk(word, place) as (select word, word from f union all select walk.word, f.form from walk join f on f.word = walk.place where f.form is not null),
root as (select walk.word, walk.place as root from walk join f on f.word = walk.place where f.form is null)
select word, form, root, n, n_near, form_n from f join root using (word)"""
