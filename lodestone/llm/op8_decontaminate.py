"""Benchmark decontamination: BM25 over test items, block-max WAND, and a check of question and answer.

The test items are the indexed side; every passage of every training text is a query. A passage is a window of words,
windows overlap by half, and their length follows from the longest item, so that some window holds at least three
quarters of any item that a text contains. A term's weight for an item is its BM25 impact over the sum of the item's
impacts, so an item scores 1 in a passage with all its terms; items of at least THRESHOLD are retrieved.

Block-max WAND. Each term has a posting list by item, cut into blocks at every BLOCK items, each with its largest weight;
a term's largest weight bounds them all. The bar is fixed, so all passages of a batch walk the lists together. Lists in
more than HEAVY blocks stand before the pivot: where their largest weights alone do not reach the bar, an item must also
stand in another list, so these are not walked. The others are walked block by block: a (passage, block) pair goes on
if the block maxima in it, with the bound of the lists before the pivot, reach the bar; then if the block maxima of all
its different terms do; then the block's postings are added up. Blocks in which no term of a passage stands are never
looked at, and all items that reach the threshold are retrieved. The index takes space in proportion to its postings.

A retrieved item counts as leaked if at least OVERLAP of the question's word n-grams and of the answer's are in the
text. An item's first half is its question and the rest its answer; GRAM-grams, or the part itself where it is shorter.

With edited=True, as the query and the pipeline have it, edited copies count too: words are compared without punctuation
(one of nothing else stays as it is, and counts in an item only where the item has no other), windows are half as long
again, so that one holds all of an item, and a half is there as well if at least ALIGNED of its words stand in their
order in one passage near such a window. An overlap is then the larger share, of n-grams or of words.

The index is built from items of at most INDEX_BYTES at a time; a larger benchmark takes several passes over the texts.
The number of items, their mean length, the longest and the terms' frequencies are always counted over all items first,
so scores and leaks do not depend on the number of passes.

Defined results: a null or empty text, and an item without words, leak nothing; repeated items are reported each, under
their ids, and repeated rows of documents each give their rows; ties cannot occur, for all above the threshold are
reported; an empty table on either side gives no rows; other columns are not read, so none can clash; texts are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import drop_ids, materialize, tidy

THRESHOLD, OVERLAP = 0.5, 0.6
K1, B = 1.2, 0.75
GRAM = 5
#: The share of a half's words that must stand in order: a half of seven words bears three edits.
ALIGNED = 0.55
BLOCK = 64
#: Blocks of a posting list above which it does not lead a walk.
HEAVY = 16
LEAST_STRIDE = 24
#: Text bytes of the items in one index, and the most that such an index can take: a word has two bytes of text at
#: least, and one posting, block, term, n-gram and place of a half at most.
INDEX_BYTES = 4 << 20
INDEX_LIMIT = 40 * INDEX_BYTES
_U = np.uint64
_ODDS = tv.mix64(np.arange(101, 165, dtype=_U)) | _U(1)


_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN = np.isin(np.arange(256), [0xA1, 0xAB, 0xB7, 0xBB, 0xBF])  # after C2: inverted marks, guillemets, middle dot


def _plain_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII, Latin and general punctuation, or whole where nothing else is left; and which have more."""
    drop = np.concatenate([_PUNCT[buf], [False, False]])
    at = np.flatnonzero(buf[:-1] == 0xC2)
    at = at[_LATIN[buf[at + 1]]]
    drop[at] = drop[at + 1] = True
    at = np.flatnonzero(buf[:-2] == 0xE2)
    at = at[((buf[at + 1] == 0x80) & (buf[at + 2] >= 0x90)) | ((buf[at + 1] == 0x81) & (buf[at + 2] <= 0x9E))]
    drop[at] = drop[at + 1] = drop[at + 2] = True
    keep = ~drop[: len(buf)]
    upto = np.concatenate([[0], np.cumsum(keep)])
    first, last = upto[s], upto[e]
    some = last > first
    out = np.empty(len(s), _U)
    out[some] = tv.word_hashes(buf[keep], first[some], last[some])
    out[~some] = tv.word_hashes(buf, s[~some], e[~some])
    return out, some


def _item_words(text: str, edited: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's words, as they are and as they are looked for."""
    (_, _, buf, offs) = next(tv.chunks(pa.array([text or ""])))
    buf = tv.lower(buf)
    s, e, _ = tv.words(buf, offs)
    h = tv.word_hashes(buf, s, e)
    if not edited or not len(h):
        return h, h
    plain, some = _plain_hashes(buf, s, e)
    return h, plain[some] if some.any() else plain


def _in_order(part: np.ndarray, terms: np.ndarray, least: float, none: int) -> float:
    """The largest share of part's words that stand in their order in one passage of terms; 0 if below least."""
    m = len(part)
    step = max(1, m // 8)
    width = m + max(4, m // 2) + step
    known = np.concatenate([[0], np.cumsum(np.isin(terms, part))])
    first = np.arange(0, max(1, len(terms) - width + step), step)
    first = first[known[np.minimum(first + width, len(terms))] - known[first] >= least * m]
    padded = np.concatenate([terms, np.full(width, none, terms.dtype)])
    best = 0
    for i in range(0, len(first), 1024):
        t = padded[first[i : i + 1024, None] + np.arange(width)]
        run = np.zeros((len(t), width + 1), np.int32)
        for w in part:
            run[:, 1:] = np.maximum(run[:, 1:], run[:, :-1] + (t == w))
            np.maximum.accumulate(run, axis=1, out=run)
        best = max(best, int(run.max()))
    return best / m if best >= least * m else 0.0


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = h[: len(h) - n + 1] * _ODDS[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * _ODDS[k]
    return tv.mix64(out + _U(n))


class Counts(NamedTuple):
    """What the scores of an index take from all items of the benchmark: terms in order, and each one's number of items."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """An inverted index of items: posting lists in blocks with their largest weights."""

    def __init__(self, ids: list, texts: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP, gram: int = GRAM, edited: bool = False, of_all: Counts | None = None, heavy: int = HEAVY):
        self.threshold, self.overlap, self.edited = threshold, overlap, edited
        keep, whole, seqs = [], [], []
        for i, t in zip(ids, texts, strict=True):
            h, sought = _item_words(t, edited)
            if len(h):
                keep.append(i)
                whole.append(h)
                seqs.append(sought)
        self.ids, n = keep, len(keep)
        self.terms = np.unique(np.concatenate(seqs)) if n else np.zeros(0, _U)
        lens = np.array([len(s) for s in seqs], float)
        self.longest = of_all.longest if of_all else max((len(h) for h in whole), default=0)
        rows, items, counts = [], [], []
        for j, s in enumerate(seqs):
            u, c = np.unique(np.searchsorted(self.terms, s), return_counts=True)
            rows.append(u)
            items.append(np.full(len(u), j))
            counts.append(c)
        row, item, tf = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (rows, items, counts))
        df = of_all.df[np.searchsorted(of_all.terms, self.terms)] if of_all else np.bincount(row, minlength=len(self.terms))
        idf = np.log1p(((of_all.items if of_all else n) - df + 0.5) / (df + 0.5))
        mean = (of_all.words / of_all.items if of_all else lens.sum() / n) if n else 1.0
        impact = idf[row] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[item] / mean)) if n else np.zeros(0)
        weight = impact / np.bincount(item, impact, n)[item] if n else impact
        order = np.lexsort((item, row))
        row, self.item, self.weight = row[order], item[order].astype(np.int32), weight[order].astype(np.float32)
        self.blocks = -(-n // BLOCK)
        self.block_key, at = np.unique(row * max(1, self.blocks) + self.item // BLOCK, return_index=True)  # term and block, in order
        self.block_at = np.append(at, len(row))  # where a block's postings begin
        self.block_max = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0, np.float32)
        self.term_at = np.searchsorted(self.block_key, np.arange(len(self.terms) + 2) * max(1, self.blocks))  # the last: words of no item
        self.term_max = np.append(np.maximum.reduceat(self.block_max, self.term_at[:-2]), np.float32(0)) if n else np.zeros(1, np.float32)
        self.heavy = np.diff(self.term_at) > heavy
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & _U(0xFFFF)).astype(np.int64)] = True
        self.stride = max(LEAST_STRIDE, -(-self.longest // 2))
        self.width = (3 if edited else 2) * self.stride
        self.gram, grams, halves = gram, [], []
        for h, s in zip(whole, seqs, strict=True):
            half = -(-len(h) // 2)
            grams += [np.unique(_grams(p, min(gram, len(p)))) if len(p) else np.zeros(0, _U) for p in (h[:half], h[half:])]
            half = -(-len(s) // 2)
            halves += [self.number(p) for p in (s[:half], s[half:])]
        self.part_words = np.array([x for h in whole for x in (-(-len(h) // 2), len(h) // 2)], np.int32)
        self.grams, self.gram_at = np.concatenate([np.zeros(0, _U), *grams]), np.cumsum([0, *map(len, grams)])
        self.halves, self.half_at = np.concatenate([np.zeros(0, np.int32), *halves]), np.cumsum([0, *map(len, halves)])

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.__dict__.values() if isinstance(v, np.ndarray)) + 8 * len(self.ids)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's term, or len(terms)."""
        out = np.full(len(hashes), len(self.terms), np.int32)
        at = np.flatnonzero(self.maybe[(hashes & _U(0xFFFF)).astype(np.int64)])
        if len(at) and len(self.terms):
            p = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
            hit = self.terms[p] == hashes[at]
            out[at[hit]] = p[hit]
        return out

    def _walk(self, terms: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima, of the words at these places, reach the bar with what stands before the pivot."""
        count = self.term_at[terms[place] + 1] - self.term_at[terms[place]]
        entry = np.arange(count.sum()) + np.repeat(self.term_at[terms[place]] - (np.cumsum(count) - count), count)
        block = (self.block_key[entry] % self.blocks).astype(np.int32 if self.blocks > 1 << 15 else np.int16)
        order = np.argsort(block, kind="stable")
        block, at, weight = block[order], np.repeat(place, count)[order], self.block_max[entry[order]].astype(float)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]), len(block))
        out_p, out_b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, upto = at[lo:hi], np.concatenate([[0.0], np.cumsum(weight[lo:hi])])
            if 8 * len(x) < len(first):  # passages that hold one of these words: first <= x < last, both in order
                a, b = np.searchsorted(last, x, "right"), np.searchsorted(first, x, "right")
                depth = np.bincount(a, minlength=len(first) + 1) - np.bincount(np.maximum(a, b), minlength=len(first) + 1)
                p = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
            else:
                p = np.arange(len(first))
            p = p[upto[np.searchsorted(x, last[p])] - upto[np.searchsorted(x, first[p])] + before[p] >= bar]
            out_p.append(p)
            out_b.append(np.full(len(p), block[lo], np.int64))
        cat = lambda c: np.concatenate([np.zeros(0, np.int64), *c])
        return cat(out_p), cat(out_b)

    def retrieve(self, terms: np.ndarray, rows: np.ndarray, n: int) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], list[int]]]:
        """(row, item) to the best passage's score and to the passages' first words, for all that reach the threshold."""
        best: dict[tuple[int, int], float] = {}
        places: dict[tuple[int, int], list[int]] = {}
        count = tv.row_counts(rows, n)
        many = np.where(count > 0, np.maximum(1, -(-(count - self.width) // self.stride) + 1), 0)
        row = np.repeat(np.arange(n), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        first = (np.cumsum(count) - count)[row] + k * self.stride
        last = np.minimum(first + self.width, np.cumsum(count)[row])
        bar = self.threshold - 1e-4
        if not self.blocks:
            return best, places
        upto = np.concatenate([[0.0], np.cumsum(self.term_max[terms], dtype=float)])
        live = upto[last] - upto[first] >= bar
        row, first, last = row[live], first[live], last[live]
        known = np.flatnonzero(terms < len(self.terms))
        heavy = self.heavy[terms[known]]
        upto = np.concatenate([[0.0], np.cumsum(np.where(self.heavy, self.term_max, 0)[terms], dtype=float)])
        before = upto[last] - upto[first]
        pairs = []
        for led, lead in ((before < bar, known[~heavy]), (before >= bar, known)):  # the pivot is the first list if the heavy ones reach the bar
            some = np.flatnonzero(led)
            if len(some) and len(lead):
                p, b = self._walk(terms, lead, first[some], last[some], np.where(lead is known, 0.0, before[some]), bar)
                pairs.append((some[p], b))
        if not pairs:
            return best, places
        passage, block = (np.concatenate(x) for x in zip(*pairs, strict=True))
        for i in range(0, len(passage), 512):
            w, b = passage[i : i + 512], block[i : i + 512]
            at = first[w][:, None] + np.arange(self.width)
            t = np.where(at < last[w][:, None], terms[np.minimum(at, len(terms) - 1)], len(self.terms))
            t = np.sort(t, axis=1)
            fresh = t < len(self.terms)
            fresh[:, 1:] &= t[:, 1:] != t[:, :-1]  # a term counts once
            x, y = np.nonzero(fresh)
            key = t[x, y].astype(np.int64) * self.blocks + b[x]
            e = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            there = self.block_key[e] == key
            x, e = x[there], e[there]
            reach = np.bincount(x, self.block_max[e], len(w)) >= bar
            x, e = x[reach[x]], e[reach[x]]
            size = self.block_at[e + 1] - self.block_at[e]
            post = np.arange(size.sum()) + np.repeat(self.block_at[e] - (np.cumsum(size) - size), size)
            score = np.bincount(np.repeat(x, size) * BLOCK + self.item[post] % BLOCK, self.weight[post], len(w) * BLOCK)
            for z in np.flatnonzero(score >= self.threshold - 1e-6).tolist():
                q = w[z // BLOCK]
                pair = (int(row[q]), int(b[z // BLOCK]) * BLOCK + z % BLOCK)
                best[pair] = max(best.get(pair, 0.0), float(score[z]))
                places.setdefault(pair, []).append(int(first[q]))
        return best, places

    def aligned(self, item: int, terms: np.ndarray, places: list[int]) -> list[float]:
        """The share of the question's words and of the answer's that stand in order in a passage at most a stride from these windows."""
        near: list[list[int]] = []
        for p in sorted(places):
            lo, hi = max(0, p - self.stride), p + self.width + self.stride
            if near and lo <= near[-1][1]:
                near[-1][1] = hi
            else:
                near.append([lo, hi])
        return [max(_in_order(part, terms[lo:hi], ALIGNED, len(self.terms)) for lo, hi in near) if len(part) else 1.0 for part in (self.halves[self.half_at[j] : self.half_at[j + 1]] for j in (2 * item, 2 * item + 1))]

    def overlaps(self, item: int, h: np.ndarray, cache: dict[int, np.ndarray]) -> list[float]:
        """The share of the question's and of the answer's n-grams that are in the text; an empty answer has all."""
        out = []
        for j in (2 * item, 2 * item + 1):
            grams, n = self.grams[self.gram_at[j] : self.gram_at[j + 1]], min(self.gram, int(self.part_words[j]))
            if not n:
                out.append(1.0)
                continue
            if n not in cache:
                cache[n] = np.unique(_grams(h, n)) if len(h) >= n else np.zeros(0, _U)
            out.append(float(np.isin(grams, cache[n]).mean()))
        return out


OUT = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def _leaks(docs: DataFrame, index: Index) -> DataFrame:
    if index.nbytes > INDEX_LIMIT:  # one item alone is larger than an index may be
        raise ValueError(f"an index of {index.nbytes} bytes; items are to be of {INDEX_BYTES} bytes together at most")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for lo, hi, buf, offs in tv.chunks(b.column(1)):
                buf = tv.lower(buf)
                s, e, rows = tv.words(buf, offs)
                if not len(s):
                    continue
                h = _plain_hashes(buf, s, e)[0] if ix.edited else tv.word_hashes(buf, s, e)
                terms = ix.number(h)
                found, places = ix.retrieve(terms, rows, hi - lo)
                upto = np.searchsorted(rows, np.arange(hi - lo + 1))
                caches: dict[int, dict] = {}
                whole: dict[int, np.ndarray] = {}
                for (r, j), score in sorted(found.items()):
                    mine = slice(upto[r], upto[r + 1])
                    if r not in whole:
                        whole[r] = tv.word_hashes(buf, s[mine], e[mine]) if ix.edited else h[mine]
                    q, a = grams = ix.overlaps(j, whole[r], caches.setdefault(r, {}))
                    there = [x >= ix.overlap for x in grams]
                    if ix.edited and min(grams) < 1:
                        words = ix.aligned(j, terms[mine], [p - upto[r] for p in places[r, j]])
                        there = [x or y >= ALIGNED for x, y in zip(there, words, strict=True)]
                        q, a = (max(x) for x in zip(grams, words, strict=True))
                    if all(there):
                        for c, v in zip(cols, (b.column(0)[lo + r].as_py(), ix.ids[j], round(score, 5), q, a), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return docs.mapInArrow(tidy(run), OUT)


def _counted(items: DataFrame, edited: bool) -> Callable[[int], Counts]:
    """Counts over all items, with the frequencies of one turn's terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for turn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, sought = _item_words(text, edited)
                if len(h):
                    terms = np.unique(sought).view(np.int64)
                    none = pa.nulls(len(terms), pa.int64())
                    yield pa.RecordBatch.from_pydict({"turn": pa.array([turn], pa.int32()), "term": pa.nulls(1, pa.int64()), "words": pa.array([len(sought)]), "longest": pa.array([len(h)])})
                    yield pa.RecordBatch.from_pydict({"turn": pa.array(np.full(len(terms), turn, np.int32)), "term": pa.array(terms), "words": none, "longest": none})

    rows = materialize(items.select("turn", "text").mapInArrow(tidy(run), "turn int, term bigint, words bigint, longest bigint"), "terms")
    n = rows.where("term is null").agg(F.count("words").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    df = materialize(rows.where("term is not null").groupBy("term").agg(F.count("*").alias("df")), "frequencies")

    def of(turn: int) -> Counts:
        table = rows.where((F.col("turn") == turn) & F.col("term").isNotNull()).select("term").distinct().join(df, "term").toArrow()
        terms = table["term"].to_numpy().view(_U)
        order = np.argsort(terms)
        return Counts(n["items"], n["words"] or 0, n["longest"] or 0, terms[order], table["df"].to_numpy()[order])

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each leaked item of a document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    turns = int(total // index_bytes) + 1
    out = None
    items = items.withColumn("turn", F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)).cast("int"))
    counts = _counted(items, edited) if turns > 1 else None
    for turn in range(turns):
        mine = items if turns == 1 else items.where(F.col("turn") == turn)
        table = mine.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        found = _leaks(docs, Index(table["item_id"].to_pylist(), table["text"].to_pylist(), edited=edited, of_all=counts and counts(turn)))
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edited: bool = False) -> DataFrame:
    """The documents that leak no item, with all their columns; a row with a null id stays."""
    return drop_ids(docs, leaks(docs, benchmark, edited=edited).select("doc_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), edited=True)
