"""N-gram Jaccard join by universe partitioning.

A document is its set of distinct word n-grams. Sets fall into size bands so wide that partners lie in the same band or
the next. In each band the universe of n-grams is hashed into segments; two linked sets differ in at most H n-grams, so
of a set's segments that hold something, all but H agree with those of any partner. A set with more than H of them is
sure to share the exact content of one: those contents are indexed (one signature each), for the set's own band and for
the band below.

Allocation by cost: a band's number of segments is the least one with which sets of its sizes have more than H full
segments by four standard deviations; small bands index single n-grams. Where a set still falls short, the band's first
segments are indexed again with their one-deletion neighbourhoods, which count twice; how many segments follows from the
worst set of the band, and if all are too few, the band's single n-grams are indexed.

Signatures shared by more than HOT sets make no pairs. A set has signatures to spare; only sets that lose more than
those to hot ones need them, and of these only the rarest. The least set of each hot
signature is its hub, and each set is first compared with the least of its hubs: a row for each set. A group of near
copies is one component after that, and none of its pairs is tried. Only where a signature's sets are still in several
components, the sets of different ones are compared, block by block inside tasks that count all intersections at once
and return forests. Counts also rule out chance pairs: links share more signatures than two
sets can differ in. The other candidate pairs are verified on the whole sets: first each set's pair with its least partner, then only pairs
that would still join two components.

Equal sets are collapsed first and expanded last. N-grams are 54-bit hashes within a document, sets 128-bit ones.

Defined results: a text without words (also null or empty) has size 0, its own id as component, and no links; a text
with fewer than n words has one n-gram, the whole sequence; a row with a null id keeps its size and gets a null
component; rows of one id count as one document; an empty table gives no rows; only the id and the text are carried, so
other columns cannot clash; long texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .runtime import drop_ids, materialize, partitions_for, tidy

N = 5
NUM, DEN = 75, 100
HOT = 32
#: Parquet bytes of documents whose signatures one task groups, about.
PART_BYTES = 6 << 20
#: Ids up to which a set of documents is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
BITS = np.uint64(54)
LOW = np.uint64((1 << 54) - 1)
_U = np.uint64
_ODDS = tv.mix64(np.arange(1, 65, dtype=_U)) | _U(1)


class Bands:
    """Size bands and their segments for a threshold num / den."""

    def __init__(self, num: int = NUM, den: int = DEN, deletions: dict[int, int] | None = None, sizes: int = 1 << 40):
        self.num, self.den = num, den
        self.deletions = deletions  # None: the whole index; else only these bands' first segments, -1 for single n-grams
        lows = [1]
        while lows[-1] < sizes:
            lows.append(lows[-1] * den // num + 1)
        self.lows = np.array(lows, np.int64)
        self.segments = np.array([self._segments(int(a), int(b) - 1) for a, b in zip(lows[:-1], lows[1:], strict=True)], np.int64)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """n-grams in which linked sets of these sizes differ at most."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def _segments(self, low: int, high: int) -> int:
        """0: single n-grams."""
        if high < 24:
            return 0
        most = high * self.den // self.num
        need = [(z, int(self.differ(np.int64(z), np.int64(p)))) for z, p in ((low, low * self.den // self.num), (high, most), (most, high))]
        m = high // 4
        while m < 2 * high:
            if all(self._full(m, z) > h + 1 for z, h in need):
                return m
            m += max(1, m // 100)
        return 0

    @staticmethod
    def _full(m: int, z: int) -> float:
        """Segments that hold something, less four standard deviations."""
        lam = z / m
        e = math.exp(-lam)
        return m * (1 - e) - 4 * math.sqrt(m * e * max(0.0, 1 - (1 + lam) * e))

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, size, "right") - 1


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of the distinct n-grams of each text, in order."""
    buf = tv.lower(buf)
    starts, ends, rows = tv.words(buf, offs)
    h = tv.word_hashes(buf, starts, ends)
    count = tv.row_counts(rows, len(offs) - 1)
    first = np.cumsum(count) - count
    gram, of = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(h) >= n:
        gram = h[: len(h) - n + 1] * _ODDS[0]
        for k in range(1, n):
            gram = gram + h[k : len(h) - n + 1 + k] * _ODDS[k]
        inside = rows[: len(h) - n + 1] == rows[n - 1 :]
        gram, of = tv.mix64(gram[inside]), rows[: len(h) - n + 1][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = count[short].astype(_U) * _ODDS[63]
        for k in range(n - 1):
            have = count[short] > k
            whole[have] += h[first[short[have]] + k] * _ODDS[k + 32]
        gram, of = np.concatenate([gram, tv.mix64(whole)]), np.concatenate([of, short])
    key = np.sort((of.astype(_U) << BITS) | (gram >> _U(64 - 54)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> BITS).astype(np.int64), key & LOW


def set_ids(rows: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, 64-bit id, another) of each row's set."""
    size = tv.row_counts(rows, n)
    out = []
    for salt in (0x51, 0xA3):
        acc = np.zeros(n, _U)
        np.add.at(acc, rows, tv.mix64(grams ^ (_U(salt) << _U(54))))
        out.append(tv.mix64(acc + size.astype(_U) * _ODDS[salt % 64]).view(np.int64))
    return size, *out


def signatures(rows: np.ndarray, grams: np.ndarray, size: np.ndarray, bands: Bands) -> Iterator[tuple]:
    """For the own band (role 0) and the one below (role 1): (role, rows, keys, slack by row, full segments or deletions needed)."""
    own = np.where(size > 0, bands.of(np.maximum(size, 1)), -1)
    start = np.cumsum(size) - size
    place = np.arange(len(rows)) - start[rows]
    mixed = tv.mix64(grams + _U(0x5851F42D4C957F2D))
    for role in (0, 1):
        band = own - role
        top = bands.lows[np.maximum(own, 0)] - 1  # largest size of the band below
        used = (band >= 0) & ((role == 0) | (size * bands.num <= top * bands.den))
        h = bands.differ(size, size * bands.den // bands.num if role == 0 else np.minimum(top, size))
        if bands.deletions is not None:
            used &= np.isin(band, list(bands.deletions))
        m = np.where(used, bands.segments[np.maximum(band, 0)], 0)
        if bands.deletions is not None:
            m[np.isin(band, [b for b, d in bands.deletions.items() if d < 0])] = 0
        single = used & (m == 0)
        slots = np.where(single, size, m)
        base = np.cumsum(slots) - slots
        keep = used[rows]
        r, g, mx = rows[keep], grams[keep], mixed[keep]
        seg = ((tv.mix64(g ^ (band[r].astype(_U) << _U(54))) >> _U(32)) * m[r].astype(_U) >> _U(32)).astype(np.int64)
        at = base[r] + np.where(single[r], place[keep], seg)
        total = int(slots.sum())
        acc = np.zeros(total, _U)
        np.add.at(acc, at, mx)
        held = np.bincount(at, minlength=total)
        row_of = np.repeat(np.arange(len(size)), slots)
        seg_of = np.where(single[row_of], 0, np.arange(total) - base[row_of] + 1)
        tag = tv.mix64((band[row_of].astype(_U) << _U(40)) | seg_of.astype(_U))
        full = held > 0
        if bands.deletions is not None:
            limit = np.array([bands.deletions.get(int(b), 0) for b in band], np.int64) if len(band) else band
            full &= single[row_of] | (seg_of <= limit[row_of])
            pick = (~single[r]) & (seg + 1 <= limit[r]) & (held[at] > 1)
            a = at[pick]
            yield role, np.concatenate([row_of[full], r[pick]]), np.concatenate([tv.mix64(acc[full] + tag[full]), tv.mix64(acc[a] - mx[pick] + tag[a])]), None, None
            continue
        credit = np.bincount(row_of[full], minlength=len(size))
        slack = np.where(used, credit - h - 1, 1 << 30)
        need = credit.astype(np.int64)  # of rows with slack: their full segments; of others: deletions needed
        for i in np.flatnonzero(slack < 0):
            double = np.cumsum(held[base[i] : base[i] + m[i]] > 1)
            d = int(np.searchsorted(double, -slack[i])) + 1
            need[i] = d if d <= m[i] else -1
        yield role, row_of[full], tv.mix64(acc[full] + tag[full]), slack, need


BLOCK = "part int, doc_id bigint, n bigint, sid bigint, sid2 bigint, slack0 bigint, slack1 bigint, need0 bigint, need1 bigint, sids binary, runs binary, keys binary"
_BLOCK = pa.schema(
    [("part", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "sid", "sid2", "slack0", "slack1", "need0", "need1")), *((c, pa.binary()) for c in ("sids", "runs", "keys"))]
)


def _blocks(sid: np.ndarray, role: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch | None:
    """One row for each part: ids of sets, runs of them (15 bits of length, one of role), and 40 bits of each key."""
    if not len(keys):
        return None
    part = ((keys >> _U(40)) % _U(parts)).astype(np.int32)
    order = np.lexsort((role, sid, part)) if len(keys) < 2 else np.argsort(part, kind="stable")
    part, sid, role, keys = part[order], sid[order], role[order], keys[order]
    change = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (sid[1:] != sid[:-1]) | (role[1:] != role[:-1])]))
    lens = np.diff(np.append(change, len(keys)))
    if lens.max() > 32767:  # a run of a very long text is cut
        cut = np.concatenate([np.arange(c, c + n, 32767) for c, n in zip(change.tolist(), lens.tolist(), strict=True)])
        change, lens = cut, np.diff(np.append(cut, len(keys)))
    runs = (lens | (role[change].astype(np.int64) << 15)).astype(np.uint16)
    low, high = (keys & _U(0xFFFFFFFF)).astype(np.uint32), ((keys >> _U(32)) & _U(0xFF)).astype(np.uint8)
    here = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    upto = np.append(here, len(keys))
    in_runs = np.searchsorted(change, upto)
    rows: dict[str, list] = {c: [] for c in ("part", "sids", "runs", "keys")}
    for i, p in enumerate(part[here].tolist()):
        a, b, c, d = upto[i], upto[i + 1], in_runs[i], in_runs[i + 1]
        rows["part"].append(p)
        rows["sids"].append(sid[change[c:d]].tobytes())
        rows["runs"].append(runs[c:d].tobytes())
        rows["keys"].append(low[a:b].tobytes() + high[a:b].tobytes())
    k = len(rows["part"])
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(k, f.type) for f in _BLOCK], schema=_BLOCK)


def sign(docs: DataFrame, parts: int, bands: Bands, n: int = N) -> DataFrame:
    """Rows of documents and blocks of signatures, each with the part that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        waiting = 0
        for b in batches:
            for lo, hi, buf, offs in tv.chunks(b.column(1)):
                rows, grams = shingle_sets(buf, offs, n)
                size, sid, sid2 = set_ids(rows, grams, hi - lo)
                by_role = {}
                for role, r, keys, slack, need in signatures(rows, grams, size, bands):
                    by_role[role] = (slack, need)
                    for h, x in zip(held, (sid[r], np.full(len(r), role, np.uint8), keys), strict=True):
                        h.append(x)
                    waiting += len(keys)
                if bands.deletions is None:
                    (s0, n0), (s1, n1) = by_role[0], by_role[1]
                    ints = [pa.array(np.asarray(x, np.int64)) for x in (size, sid, sid2, s0, s1, n0, n1)]
                    part = pa.array(((sid.view(_U) >> _U(40)) % _U(parts)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part, b.column(0).slice(lo, hi - lo), *ints, *[pa.nulls(hi - lo, pa.binary())] * 3], schema=_BLOCK)
                if waiting > 1_000_000:
                    if (out := _blocks(*map(np.concatenate, held), parts)) is not None:
                        yield out
                    held, waiting = [[], [], []], 0
        if waiting and (out := _blocks(*map(np.concatenate, held), parts)) is not None:
            yield out

    return docs.mapInArrow(tidy(run), BLOCK)


FOUND = "kind int, doc_id bigint, n bigint, a bigint, b bigint, slack0 bigint, slack1 bigint, need0 bigint, need1 bigint"
_FOUND = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "a", "b", "slack0", "slack1", "need0", "need1"))])
DOC, PAIR, MEMBER = 0, 1, 2


def _found(kind: int, **cols: np.ndarray) -> pa.Table:
    n = len(next(iter(cols.values())))
    return pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(np.asarray(cols[f.name], np.int64)) if f.name in cols else pa.nulls(n, f.type) for f in _FOUND][1:]], schema=_FOUND)


def _group(table: pa.Table, limit: int = HOT) -> pa.Table:
    """A part's documents as they are, the pairs of sets that share a signature, and the members of those shared by more than limit."""
    import pyarrow.compute as pc

    is_doc = pc.is_null(table["keys"])
    d = table.filter(is_doc)
    docs = pa.Table.from_arrays([pa.array(np.zeros(len(d), np.int32)), d["doc_id"], d["n"], d["sid"], d["sid2"], d["slack0"], d["slack1"], d["need0"], d["need1"]], schema=_FOUND)
    blocks = table.filter(pc.invert(is_doc))
    if not len(blocks):
        return docs
    sids, runs, keys = [], [], []
    for s, r, k in zip(blocks["sids"], blocks["runs"], blocks["keys"], strict=True):
        s, r, k = (x.as_buffer() for x in (s, r, k))
        m = len(k) // 5
        sids.append(np.frombuffer(s, np.int64))
        runs.append(np.frombuffer(r, np.uint16))
        keys.append(np.frombuffer(k, np.uint32, m).astype(_U) | (np.frombuffer(k, np.uint8, m, 4 * m).astype(_U) << _U(32)))
    sids, runs, keys = np.concatenate(sids), np.concatenate(runs), np.concatenate(keys)
    del table, blocks
    names, number = np.unique(sids, return_inverse=True)
    member = (number.astype(_U) << _U(1)) | (runs >> 15).astype(_U)
    wide = _U(max(1, int(2 * len(names) - 1).bit_length()))
    if int(wide) <= 24:
        v = np.sort((keys << _U(24)) | np.repeat(member, (runs & 0x7FFF).astype(np.int64)))
        v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        key, who = v >> _U(24), (v & _U((1 << 24) - 1)).astype(np.int64)
    else:  # one word does not hold both: sorted by two columns
        who = np.repeat(member, (runs & 0x7FFF).astype(np.int64))
        order = np.lexsort((who, keys))
        key, who = keys[order], who[order].astype(np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])
        key, who = key[new], who[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    many = np.repeat(count, count)
    out = [docs]
    small = np.flatnonzero((many > 1) & (many <= limit))
    who_s, key_s = who[small], key[small]
    pairs = []
    for step in range(1, limit):
        if len(key_s) <= step:
            break
        same = np.flatnonzero(key_s[step:] == key_s[:-step])
        if not len(same):
            break
        x, y = who_s[same], who_s[same + step]
        fit = ((x & 1) + (y & 1) < 2) & (x >> 1 != y >> 1)
        x, y = x[fit], y[fit]  # x < y
        pairs.append((x >> 1 << 33) | (y >> 1 << 2) | (x & 1) | (y & 1) << 1)  # fewer than 2^30 sets, or their ids alone take 8 GB
    if pairs:
        p, shared = np.unique(np.concatenate(pairs), return_counts=True)
        out.append(_found(PAIR, a=names[p >> 33], b=names[p >> 2 & ((1 << 31) - 1)], n=p & 3, slack0=shared))
    hot = np.flatnonzero(many > limit)
    if len(hot):
        mark = tv.mix64(key[hot] + _U(1)).view(np.int64)
        out.append(_found(MEMBER, a=names[who[hot] >> 1], b=mark, n=who[hot] & 1))
    return pa.concat_tables(out)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, rep, grams) of the wanted representatives (columns doc_id, sid); grams as sorted 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tv.chunks(b.column(2)):
                rows, grams = shingle_sets(buf, offs, n)
                _, sid, _ = set_ids(rows, grams, hi - lo)
                upto = np.searchsorted(rows, np.arange(hi - lo + 1)).tolist()
                same = sid == b.column(1).slice(lo, hi - lo).to_numpy()  # another text under the same id is not meant
                keep = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[keep]), b.column(0).slice(lo, hi - lo).take(pa.array(keep)), pa.array([grams[upto[i] : upto[i + 1]].tobytes() for i in keep.tolist()], pa.binary())],
                    names=["sid", "rep", "grams"],
                )

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    right = F.broadcast(wanted) if few else wanted
    picked = docs.join(right, "doc_id").select("doc_id", "sid", "text")
    return picked.mapInArrow(tidy(run), "sid bigint, rep bigint, grams binary").dropDuplicates(["sid", "rep"])


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the pairs (u, v, ga, gb) whose n-grams ga and gb are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(p) > len(q):
                    p, q = q, p
                if not len(p) or len(p) * den < len(q) * num:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    return pairs.mapInArrow(tidy(run), "u bigint, v bigint")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): representatives of the pairs (a, b) of set ids that are linked."""
    a = sets.select(F.col("sid").alias("a"), F.col("rep").alias("u"), F.col("grams").alias("ga"))
    b = sets.select(F.col("sid").alias("b"), F.col("rep").alias("v"), F.col("grams").alias("gb"))
    return _linked(pairs.join(a, "a").join(b, "b").select("u", "v", "ga", "gb"), num, den)


def _plausible(pairs: DataFrame, spared: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share as many signatures as links must.

    Linked sets agree in all of a set's full segments but as many as they differ in n-grams; some of those that agree
    may be hot. Sets short of segments, and pairs found by deletions, pass.
    """
    counted = pairs.groupBy("a", "b", F.col("n").alias("upper")).agg(F.sum("slack0").alias("shared"))
    cols = ("n", "full0", "full1", "lost0", "lost1")
    a = spared.select(F.col("sid").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = spared.select(F.col("sid").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    differ = F.floor((F.col("a_n") + F.col("b_n")) * (den - num) / F.lit(den + num))
    enough = F.lit(True)
    for side, code in (("a", 1), ("b", 2)):
        full, lost = (F.when(F.col("upper") == code, F.col(f"{side}_{c}1")).otherwise(F.col(f"{side}_{c}0")) for c in ("full", "lost"))
        enough &= F.col("shared") + lost >= full - differ
    sizes = F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num
    return counted.join(a, "a").join(b, "b").where(enough & sizes).select("a", "b")


#: Sets, and bytes of n-grams, that one block holds about.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
#: A hub is dealt to so many places, for it may meet a third of all sets.
SALTS = 8


def _links_between(x: list[np.ndarray], y: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of linked sets of x and y, or within x (i < j): all intersections at once, by n-gram."""
    every = x if y is None else x + y
    n = np.fromiter(map(len, every), np.int64, len(every))
    grams, of = np.concatenate(every), np.repeat(np.arange(len(every)), n)
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    count = np.diff(np.append(first, len(grams)))
    rows, cols = len(x), len(every)
    both = np.zeros(rows * cols, np.float32)
    many = np.repeat(count, count)
    rare, group = of[(many > 1) & (many <= 32)], np.repeat(np.arange(len(count)), count)[(many > 1) & (many <= 32)]
    for step in range(1, 32):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        i, j = rare[same], rare[same + step]  # i < j
        keep = i < rows
        both += np.bincount(i[keep] * cols + j[keep], minlength=rows * cols).astype(np.float32)
    both = both.reshape(rows, cols)
    often = np.flatnonzero(count > 32)
    for k in range(0, len(often), 1024):
        m = np.zeros((cols, min(1024, len(often) - k)), np.float32)
        for c, f in enumerate(often[k : k + 1024]):
            m[of[first[f] : first[f] + count[f]], c] = 1
        both += m[:rows] @ m.T
    linked = den * both >= num * (n[:rows, None] + n[None, :] - both)
    i, j = np.nonzero(linked & (np.arange(cols)[None, :] > (np.arange(rows)[:, None] if y is None else rows - 1)))
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component, instead of all links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    v = np.flatnonzero(label != np.arange(n))
    return label[v], v


def _block_links(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        comp, side = table["component"].to_numpy(), table["side"].to_numpy()
        rep = table["rep"].to_numpy()
        sets = [np.frombuffer(g.as_buffer(), _U) for g in table["grams"]]
        u, v = [], []
        order = np.argsort(comp, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            left, right = at[side[at] == 0], at[side[at] == 1]
            if len(left):
                i, j = _links_between([sets[k] for k in left], [sets[k] for k in right] if len(right) else None, num, den)
                both = np.concatenate([left, right])
                i, j = _forest(i, j, len(both))
                u.append(rep[both[i]])
                v.append(rep[both[j]])
        cat = lambda c: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
        return pa.table({"u": cat(u), "v": cat(v)})

    return run


def _with_hubs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): representatives of the pairs (hub, a) of set ids that are linked."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    hubs = pairs.select(F.col("hub").alias("sid")).distinct().join(sets, "sid")
    hubs = hubs.select(F.col("sid").alias("hub"), F.col("rep").alias("u"), F.col("grams").alias("ga"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    members = sets.select(F.col("sid").alias("a"), F.col("rep").alias("v"), F.col("grams").alias("gb"))
    return _linked(salted.join(members, "a").join(hubs, ["hub", "salt"]).select("u", "v", "ga", "gb"), num, den)


def _hot_links(hot: DataFrame, edges: DataFrame, sizes: DataFrame, sets: DataFrame, parts: int, num: int, den: int, block_sets: int, block_bytes: int, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """(edges with the links between sets that share a hot signature, as forests; their components).

    hot: (key, a), edges: links so far, sizes: (sid, n). Each set meets the least of its hubs. The sets of signatures
    that then still span several components are cut into cells by component of signatures, component of links (small
    ones together) and size, cells into blocks, and each pair of blocks of like sizes, but those of one component of
    links, is compared in one task.
    """
    if hubs:
        least = hot.groupBy("key").agg(F.min("a").alias("hub"))
        pairs = hot.join(least, "key").groupBy("a").agg(F.min("hub").alias("hub")).where("hub <> a")
        edges = materialize(edges.unionByName(_with_hubs(pairs, sets, num, den)), "hub-links")
    now = materialize(components(edges), "components")
    at = sets.select(F.col("sid").alias("a"), "rep").join(now.withColumnRenamed("node", "rep"), "rep", "left").select("a", F.coalesce("component", "rep").alias("cc"))
    open_ = hot.join(at, "a")
    span = open_.groupBy("key").agg(F.min("cc").alias("low"), F.max("cc").alias("high")).where("low <> high")
    left = materialize(open_.join(span.select("key"), "key"), "open")
    if left.isEmpty():
        return edges, now
    keyed = left.select("key", F.col("a").alias("sid"), "cc")
    anchors = keyed.groupBy("key").agg(F.min("sid").alias("hub"))
    joint = components(keyed.join(anchors, "key").select("sid", "hub"), "sid", "hub").select(F.col("node").alias("sid"), "component")
    placed = keyed.select("sid", "cc").distinct().join(joint, "sid").join(sizes, "sid")
    many = placed.groupBy("component", "cc").agg(F.count(F.lit(1)).alias("of_cc"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("long")
    group = F.when(F.col("of_cc") * 8 >= block_sets, F.col("cc"))  # small components of links share cells
    placed = materialize(placed.join(many, ["component", "cc"]).select("sid", "component", group.alias("cell"), "n", band.alias("band")), "placed")
    cells = placed.groupBy("component", "cell", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    cells = materialize(cells.select("component", "cell", "band", F.greatest(F.ceil(F.col("c") / block_sets), F.ceil(F.col("n") * 8 / block_bytes)).cast("long").alias("blocks")), "cells")
    blocks = cells.select("component", "cell", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    name = F.xxhash64("component", F.coalesce("cell", F.lit(-1)), F.col("cell").isNull(), "band", "block")
    blocks = blocks.withColumn("id", name)
    x, y = (blocks.select("component", *[F.col(c).alias(f"{c}{k}") for c in ("cell", "band", "id")]) for k in (0, 1))
    apart = F.col("cell0").isNull() | F.col("cell1").isNull() | (F.col("cell0") != F.col("cell1"))
    near = x.join(y, "component").where((F.col("id0") <= F.col("id1")) & (F.abs(F.col("band0") - F.col("band1")) <= 1) & apart)
    task = F.xxhash64("id0", "id1")
    each = near.select(task.alias("pair"), F.explode(F.when(F.col("id0") == F.col("id1"), F.array(F.struct(F.col("id0").alias("id"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("id0").alias("id"), F.lit(0).alias("side")), F.struct(F.col("id1").alias("id"), F.lit(1).alias("side"))))).alias("s"))
    rows = placed.join(cells, (placed.component == cells.component) & placed.cell.eqNullSafe(cells.cell) & (placed.band == cells.band)).select("sid", placed.component, placed.cell, placed.band, F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block"))
    rows = rows.select("sid", name.alias("id")).join(each.select("pair", "s.id", "s.side"), "id").join(sets, "sid")
    links = rows.select(F.pmod("pair", F.lit(parts)).alias("task"), F.col("pair").alias("component"), "side", "rep", "grams")
    links = materialize(links.groupBy("task", "component").applyInArrow(_block_links(num, den), "u bigint, v bigint"), "block-links")
    if links.isEmpty():
        return edges, now
    edges = edges.unionByName(links)
    return edges, materialize(components(edges), "components")


def _grouped(docs: DataFrame, parts: int, bands: Bands, n: int, hot: int) -> DataFrame:
    return sign(docs, parts, bands, n).repartition(parts, "part").groupBy("part").applyInArrow(lambda table: _group(table, hot), FOUND)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN, hot_sets: int = HOT, block_sets: int = BLOCK_SETS, block_bytes: int = BLOCK_BYTES, hubs: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): one row for each document; links are 100 * |both| >= 75 * |either|.

    HOT, the blocks' sizes and the use of hubs change where the work is done, not the result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = partitions_for(docs, PART_BYTES)
    found = materialize(_grouped(docs, parts, Bands(num, den), n, hot_sets), "signatures")
    rows = found.where(F.col("kind") == DOC).select("doc_id", "n", F.col("a").alias("sid"), F.col("b").alias("sid2"), "slack0", "slack1", "need0", "need1")
    bands = Bands(num, den)
    lows = F.array(*[F.lit(int(x)) for x in bands.lows])
    band = F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1
    short = rows.where("slack0 < 0 or slack1 < 0").select(band.alias("band"), "slack0", "slack1", "need0", "need1")
    each = short.where("slack0 < 0").select("band", F.col("need0").alias("d")).unionByName(short.where("slack1 < 0").select(F.expr("band - 1").alias("band"), F.col("need1").alias("d")))
    worst = {r["band"]: (-1 if r["least"] < 0 else r["most"]) for r in each.groupBy("band").agg(F.max("d").alias("most"), F.min("d").alias("least")).collect()}  # a row a band
    if worst:
        again = _grouped(docs, parts, Bands(num, den, worst), n, hot_sets).where(F.col("kind") != DOC)
        found = found.unionByName(materialize(again.withColumn("slack0", F.lit(1 << 40).cast("long")), "deletions"))
    classes = materialize(
        rows.where("n > 0 and doc_id is not null").groupBy("sid", "sid2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("slack0", "slack1", "need0", "need1")]),
        "classes",
    )
    members = found.where(F.col("kind") == MEMBER).select("a", F.col("b").alias("key"), F.col("n").alias("role"))
    full = [F.when(F.col(f"slack{r}") >= 0, F.col(f"need{r}")).otherwise(F.lit(-(1 << 40))).alias(f"full{r}") for r in (0, 1)]
    spared = classes.select("sid", "n", *full, "slack0", "slack1")
    hot = None
    if not members.isEmpty():
        lost = materialize(members.groupBy("a", "role").agg(F.count(F.lit(1)).alias("lost")), "lost")
        both = lost.groupBy(F.col("a").alias("sid")).agg(*[F.sum(F.when(F.col("role") == r, F.col("lost")).otherwise(0)).alias(f"lost{r}") for r in (0, 1)])
        spared = spared.join(both, "sid", "left").select("sid", "n", "full0", "full1", "slack0", "slack1", *[F.coalesce(f"lost{r}", F.lit(0)).alias(f"lost{r}") for r in (0, 1)])
        spare = F.when(F.col("role") == 0, F.col("slack0")).otherwise(F.col("slack1"))
        short = lost.join(classes.select(F.col("sid").alias("a"), "slack0", "slack1"), "a").where(F.col("lost") > spare).select("a", "role", (F.col("lost") - spare).alias("keep"))
        # Two such sets share more hot signatures than either has to spare; so among the rarest of each one is shared.
        often = members.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
        w = Window.partitionBy("a", "role").orderBy("often", "key")
        ranked = members.join(short, ["a", "role"]).join(often, "key").withColumn("r", F.row_number().over(w))
        hot = materialize(ranked.where("r <= keep").select("key", "a"), "hot")
    else:
        spared = spared.withColumns({"lost0": F.lit(0), "lost1": F.lit(0)})
    pairs = materialize(_plausible(found.where(F.col("kind") == PAIR), spared, num, den).distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    if hot is not None:
        nodes = nodes.unionByName(hot.select(F.col("a").alias("sid")))
    wanted = materialize(nodes.distinct().join(classes.select("sid", F.col("rep").alias("doc_id")), "sid"), "wanted")
    sets = materialize(_sets(docs, wanted, n), "sets")
    reps = sets.select("sid", "rep")
    least = pairs.groupBy("b").agg(F.min("a").alias("a"))
    edges = materialize(_verify(least, sets, num, den), "links")
    if hot is not None:
        edges, now = _hot_links(hot, edges, classes.select("sid", "n"), sets, parts, num, den, block_sets, block_bytes, hubs)
    else:
        now = materialize(components(edges), "components")

    def across(now: DataFrame, candidates: DataFrame) -> DataFrame:
        """Candidates whose ends are in different components."""
        at = reps.join(now.withColumnRenamed("node", "rep"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("c"))
        a, b = at.select(F.col("sid").alias("a"), F.col("c").alias("ca")), at.select(F.col("sid").alias("b"), F.col("c").alias("cb"))
        return candidates.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b")

    rest = materialize(across(now, pairs).distinct(), "rest")
    if not rest.isEmpty():
        more = materialize(_verify(rest, sets, num, den), "links")
        now = now if more.isEmpty() else components(edges.unionByName(more))
    by_class = classes.select("sid", "sid2", "rep").join(now.withColumnRenamed("node", "rep"), "rep", "left").select("sid", "sid2", F.coalesce("component", "rep").alias("component_id"))
    linked = rows.select("doc_id", F.col("n").alias("n_shingles"), "sid", "sid2").join(by_class, ["sid", "sid2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"), F.col("sid").alias("set_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, of each component the document of the least id; rows without an id or words stay."""
    joined = jaccard_join(docs, id_col, text_col)
    return drop_ids(docs, joined.where("component_id <> doc_id").select("doc_id"), id_col)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
