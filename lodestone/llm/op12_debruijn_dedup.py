"""Substring dedup by de Bruijn compaction: every word goes that a window of K words covers which also stands in an earlier document.

Edges of the graph are the windows of K words. An edge belongs to its anchor, its GRAM words of least hash (the leftmost
of equals); the edges that follow each other in a text with one anchor are a piece, one row instead of five or six.
Equal edges have equal anchors, so pieces are dealt to parts of the graph by anchor, and a part decides (``_group``):

* a piece whose words stand in an earlier document too repeats as a whole, with that document's place as its source;
* an anchor's other pieces are open where words beside the anchor also agree with another piece's: a branch is near;
* the rest stands in one document only.

Of open pieces, only those of each spelling's first document, the edges are dealt one by one in a second round of the
same code. Then a document's repeated pieces and edges that follow each other and have the same source document at the
same distance are compacted to one path (``paths``), of any length, with its source's coordinates.

Every path is verified: the words at both coordinates are read again from the texts, digested (sha256), and joined. If
one differs, hashes have collided, and all is done again with another seed. So hashes decide nothing on their own.

Rows of many equal pieces, or of an anchor with many spellings, are settled as far as possible in the scanning task, which
holds HELD pieces: of a spelling only its first document there goes on, and of an anchor with more than LOCAL spellings
the pieces are open at once and go on by turns. So no part gets more than a row for each task of what is common.

Defined results: a null text has no words; documents with fewer than K words keep all; rows with a null id keep all and
are nobody's source; rows of one id count as one document, so they take nothing from each other; an empty table gives no
rows; only the id and the text are carried, so other columns cannot clash; very long texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import discard, materialize, partitions_for, release, tidy

K, GRAM = 13, 4
#: Parquet bytes of documents whose pieces one task groups, about; bytes scanned at once; pieces that a scanning task holds.
PART_BYTES, SCAN_BYTES, HELD = 16 << 20, 1 << 20, 200_000
#: Spellings of an anchor among the pieces that a scanning task holds, above which they are open at once.
LOCAL = 1024
#: Contents up to which a list of those wanted is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: Source spans that one row of a document's text is joined with.
CHECKS = 2000
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd number to the powers 0..n and their inverses mod 2^64; kept from call to call."""
    if len(_KEPT[0]) <= n:
        n = 1 << n.bit_length()
        odd = 0x9E3779B97F4A7C15
        for i, base in enumerate((odd, pow(odd, -1, 1 << 64))):
            p = np.full(n + 1, _U(base))
            p[0] = 1
            _KEPT[i] = np.multiply.accumulate(p)
    return _KEPT[0], _KEPT[1]


_KEPT = [np.ones(1, _U), np.ones(1, _U)]


class Spelled:
    """Hashes of runs of words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, seed: int):
        self.starts, self.ends, self.row = tv.words(buf, offs)
        w = tv.mix64(tv.word_hashes(buf, self.starts, self.ends) ^ _U(seed))
        power, self.inverse = _powers(len(w))
        self.upto = np.concatenate([np.zeros(1, _U), np.cumsum(w * power[: len(w)])])
        self.first = np.searchsorted(self.row, np.arange(len(offs)))  # each row's first word, and the end

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tv.mix64((self.upto[b] - self.upto[a]) * self.inverse[a] + tv.mix64((b - a).astype(_U)))


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where a run of rows equal in these columns begins."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def leftmost_least(g: np.ndarray, span: int) -> np.ndarray:
    """Of each ``span`` values in a row, the place of the least, the leftmost of equals."""
    low, width = np.arange(len(g)), 1
    while width * 2 <= span:
        a, b = low[:-width], low[width:]
        low, width = np.where(g[b] < g[a], b, a), width * 2
    if span > width:
        a, b = low[: len(low) - (span - width)], low[span - width :]
        low = np.where(g[b] < g[a], b, a)
    return low


def pieces(x: Spelled, k: int) -> dict[str, np.ndarray]:
    """row, s (first edge, counted in the row), n (edges), m (the anchor), hull (all words), left and right (words beside the
    anchor that half of the edges hold; 0 where the piece has none of those)."""
    n = len(x.row)
    if n < k:
        return {c: np.zeros(0, _U if c in ("m", "hull") else np.int64) for c in ("row", "s", "n", "m", "hull", "left", "right")}
    i = np.arange(n - GRAM + 1)
    gram = x.of(i, i + GRAM)
    start = np.flatnonzero(x.row[: n - k + 1] == x.row[k - 1 :])
    at = leftmost_least(gram, k - GRAM + 1)[start]
    row = x.row[start]
    first = np.flatnonzero(_starts(at, row))
    count = np.diff(np.append(first, len(start)))
    s, at, row = start[first], at[first], row[first]
    half = (k - GRAM + 1) // 2
    most, least = at - s, at - s - count + 1  # how far the anchor stands in the first and the last edge
    beside = []
    for have, a, b in ((most >= half, at - half, at), (least < half, at + GRAM, at + k - half + 1)):
        a, b = np.where(have, a, 0), np.where(have, b, 0)
        beside.append(np.where(have, (x.of(a, b) % _U(65535)).astype(np.int64) + 1, 0))
    return {"row": row, "s": s - x.first[row], "n": count, "m": gram[at], "hull": x.of(s, s + count + k - 1), "left": beside[0], "right": beside[1]}


#: Blocks of packed pieces. DEALT: to be grouped; FOUND: repeated, with their source; OPEN: to be dealt edge by edge.
DEALT, FOUND, OPEN = 0, 1, 2
_PACKED = {
    DEALT: {"s": np.uint32, "n": np.uint16, "m": np.uint32, "hull": _U, "left": np.uint16, "right": np.uint16, "hot": np.uint8},
    FOUND: {"s": np.uint32, "n": np.uint32, "sdoc": np.int64, "sh": np.uint16, "ss": np.uint32},
    OPEN: {"s": np.uint32, "n": np.uint32},
}
_COLS = ["docs", "hs", "runs", *dict.fromkeys(c for p in _PACKED.values() for c in p)]
BLOCK = "part int, kind int, " + ", ".join(f"`{c}` binary" for c in _COLS)
_BLOCK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in _COLS)])
ROWS = "kind int, doc bigint, h int, s bigint, n bigint, sdoc bigint, sh int, ss bigint"
_ROWS = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("h", pa.int32()), ("s", pa.int64()), ("n", pa.int64()), ("sdoc", pa.int64()), ("sh", pa.int32()), ("ss", pa.int64())])


def _classes(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by anchor, spelling, document and place; each row's class, each class's first row, each row's anchor), in that order."""
    order = np.lexsort((x["s"], x["h"], x["doc"], x["hull"], x["m"]))
    new_m = _starts(x["m"][order])
    new = new_m | _starts(x["hull"][order])
    return order, np.cumsum(new) - 1, order[np.flatnonzero(new)], np.cumsum(new_m) - 1


def compacted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows (doc, h, s, n and perhaps a source) in order; those that follow each other, at one distance from one source, are one."""
    order = np.lexsort((x["s"], x["h"], x["doc"]))
    x = {c: v[order] for c, v in x.items()}
    follows = np.zeros(len(order), bool)
    follows[1:] = (x["s"][:-1] + x["n"][:-1] == x["s"][1:]) & (x["doc"][1:] == x["doc"][:-1]) & (x["h"][1:] == x["h"][:-1])
    if "sdoc" in x:
        follows[1:] &= (x["sdoc"][1:] == x["sdoc"][:-1]) & (x["sh"][1:] == x["sh"][:-1]) & (x["s"][1:] - x["ss"][1:] == x["s"][:-1] - x["ss"][:-1])
    first = np.flatnonzero(~follows)
    if not len(first):
        return x
    return {c: v[first] for c, v in x.items()} | {"n": np.add.reduceat(x["n"], first)}


def _with_source(x: dict[str, np.ndarray], rows: np.ndarray, source: np.ndarray) -> dict[str, np.ndarray]:
    return compacted({c: x[c][rows] for c in ("doc", "h", "s", "n")} | {"sdoc": x["doc"][source], "sh": x["h"][source], "ss": x["s"][source]})


def _deal(x: dict[str, np.ndarray], parts: int, turn: int, local: int) -> pa.RecordBatch:
    """Packed blocks of pieces, by the anchor's part; what is settled here already goes to part ``turn``."""
    order, cls, first, anchor = _classes(x)
    later = x["doc"][order] > x["doc"][first][cls]
    spellings = np.bincount(anchor[np.flatnonzero(_starts(cls))])
    hot = (spellings > local)[anchor]
    marker = _starts(anchor)
    dealt = order[~later & (~hot | marker)]
    y = {c: x[c][dealt] for c in ("doc", "h", "s", "n", "m", "hull", "left", "right")} | {"hot": hot[~later & (~hot | marker)]}
    opened = order[~later & hot & ~marker]
    blocks = [
        (DEALT, ((y["m"] >> _U(32)) % _U(parts)).astype(np.int64), y),
        (FOUND, None, _with_source(x, order[later], first[cls[later]])),
        (OPEN, None, compacted({c: x[c][opened] for c in ("doc", "h", "s", "n")})),
    ]
    cols: dict[str, list] = {f.name: [] for f in _BLOCK}
    for kind, part, y in blocks:
        if not len(y["doc"]):
            continue
        part = np.full(len(y["doc"]), turn % parts) if part is None else part
        by = np.lexsort((y["s"], y["h"], y["doc"], part))
        part, y = part[by], {c: v[by] for c, v in y.items()}
        upto = np.append(np.flatnonzero(_starts(part)), len(part))
        run_at = np.flatnonzero(_starts(part, y["doc"], y["h"]))
        runs = np.diff(np.append(run_at, len(part))).astype(np.uint32)
        docs, hs = y["doc"][run_at], y["h"][run_at].astype(np.uint16)
        in_runs = np.searchsorted(run_at, upto)
        packed = {c: (y[c] & _U(0xFFFFFFFF) if c == "m" else y[c]).astype(kind_of) for c, kind_of in _PACKED[kind].items()}
        for i, p in enumerate(part[upto[:-1]].tolist()):
            a, b, c, d = upto[i], upto[i + 1], in_runs[i], in_runs[i + 1]
            cols["part"].append(p)
            cols["kind"].append(kind)
            for name, v in (("docs", docs), ("hs", hs), ("runs", runs)):
                cols[name].append(v[c:d].tobytes())
            for name in _COLS[3:]:
                cols[name].append(packed[name][a:b].tobytes() if name in packed else b"")
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _BLOCK], schema=_BLOCK)


def _dealt(found: Iterator[dict[str, np.ndarray]], parts: int, most: int, local: int) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces, ``most`` of them at a time."""
    from pyspark import TaskContext

    held: list[dict[str, np.ndarray]] = []
    waiting, turn = 0, TaskContext.get().partitionId()
    for x in found:
        held.append(x)
        waiting += len(x["s"])
        if waiting > most:
            yield _deal({c: np.concatenate([d[c] for d in held]) for c in held[0]}, parts, turn, local)
            held, waiting, turn = [], 0, turn + 7919
            release()
    if waiting:
        yield _deal({c: np.concatenate([d[c] for d in held]) for c in held[0]}, parts, turn, local)


def _row_range(mine: pa.ListArray, fields: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a list column of structs: the row of each entry, and the entries' fields."""
    flat = mine.flatten()
    count = np.asarray(pc.fill_null(mine.value_lengths(), 0))
    return np.repeat(np.arange(len(mine)), count), {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields}


def _scan(docs: DataFrame, parts: int, k: int, seed: int, most: int, local: int) -> DataFrame:
    """Blocks of the pieces of all texts. docs: doc, h, text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            doc, h = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            for lo, _hi, buf, offs in tv.chunks(b.column(2), SCAN_BYTES):
                x = pieces(Spelled(buf, offs, seed), k)
                row = x.pop("row") + lo
                yield x | {"doc": doc[row], "h": h[row]}

    return docs.mapInArrow(tidy(lambda batches: _dealt(found(batches), parts, most, local)), BLOCK)


def _edges(docs: DataFrame, wanted: DataFrame, parts: int, k: int, seed: int, most: int, local: int) -> DataFrame:
    """Blocks of single edges: those of the pieces ``wanted`` (doc, h, s, n)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            doc, h, spans = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(3)
            for lo, hi, buf, offs in tv.chunks(b.column(2), SCAN_BYTES):
                x = Spelled(buf, offs, seed)
                row, y = _row_range(spans.slice(lo, hi - lo), ("s", "n"))
                s = np.repeat(y["s"] - np.cumsum(y["n"]) + y["n"], y["n"]) + np.arange(y["n"].sum())
                row = np.repeat(row, y["n"])
                at = x.first[row] + s
                inside = at + k <= x.first[row + 1]  # else rows of equal id and hash have different texts; verified later
                row, s, at = row[inside], s[inside], at[inside]
                edge = x.of(at, at + k)
                none = np.zeros(len(at), np.int64)
                yield {"s": s, "n": none + 1, "m": edge, "hull": edge, "left": none, "right": none, "doc": doc[row + lo], "h": h[row + lo]}

    rows = _with_spans(docs, wanted.groupBy("doc", "h").agg(F.collect_set(F.struct("s", "n")).alias("spans")))
    return rows.select("doc", "h", "text", "spans").mapInArrow(tidy(lambda batches: _dealt(found(batches), parts, most, local)), BLOCK)


def _group(table: pa.Table) -> pa.Table:
    """Of a part: repeated pieces with their sources, and open pieces."""

    def unpacked(t: pa.Table, kind: int) -> dict[str, np.ndarray]:
        x = {c: np.concatenate([np.zeros(0, kind_of), *[np.frombuffer(v.as_buffer(), kind_of) for v in t[c]]]) for c, kind_of in _PACKED[kind].items()}
        x = {c: v if v.dtype == _U else v.astype(np.int64) for c, v in x.items()}
        docs, hs, runs = (np.concatenate([np.zeros(0, k), *[np.frombuffer(v.as_buffer(), k) for v in t[c]]]) for c, k in (("docs", np.int64), ("hs", np.uint16), ("runs", np.uint32)))
        return x | {"doc": np.repeat(docs, runs), "h": np.repeat(hs.astype(np.int64), runs)}

    def rows(kind: int, x: dict[str, np.ndarray]) -> pa.Table:
        zero = np.zeros(len(x["doc"]), np.int64)
        cols = [np.full(len(zero), kind), *(x.get(f.name, zero) for f in list(_ROWS)[1:])]
        return pa.Table.from_arrays([pa.array(np.asarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

    out = []
    for kind in (FOUND, OPEN):
        t = table.filter(pc.equal(table["kind"], kind))
        if len(t):
            out.append(rows(kind, compacted(unpacked(t, kind))))
    t = table.filter(pc.equal(table["kind"], DEALT))
    del table
    if len(t):
        x = unpacked(t, DEALT)
        del t
        order, cls, first, anchor = _classes(x)
        later = x["doc"][order] > x["doc"][first][cls]
        near = np.zeros(len(order), bool)
        near[order] = (np.bincount(anchor, x["hot"][order]) > 0)[anchor]
        for side in ("left", "right"):
            by = np.lexsort((x["hull"], x[side], x["m"]))
            new = _starts(x["m"][by], x[side][by])
            of, at = np.cumsum(new) - 1, np.flatnonzero(new)
            spellings = np.bincount(of[np.flatnonzero(new | _starts(x["hull"][by]))])
            several = (spellings > 1) & (np.minimum.reduceat(x["doc"][by], at) < np.maximum.reduceat(x["doc"][by], at)) & (x[side][by][at] > 0)
            near[by] |= several[of]
        out.append(rows(FOUND, _with_source(x, order[later], first[cls[later]])))
        opened = order[~later & near[order]]
        out.append(rows(OPEN, compacted({c: x[c][opened] for c in ("doc", "h", "s", "n")})))
    return pa.concat_tables(out) if out else _ROWS.empty_table()


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of docs that spans (doc, h and lists) name, with them; few contents are picked out before the texts move."""
    keys = spans.select("doc", "h")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), ["doc", "h"], "left_semi")
    return docs.join(spans, ["doc", "h"])


def keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """doc, h, text: doc and h name a content."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select("doc", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(65536)).cast("int").alias("h"), "text")


def paths(docs: DataFrame, k: int = K, seed: int = 0, most: int = HELD, local: int = LOCAL) -> DataFrame:
    """(doc, h, s, n, sdoc, sh, ss): runs of n edges from word s that stand in document sdoc, which is earlier, from word ss.
    docs: keyed(). Each repeated edge of a document is in one at least; runs that follow each other are not joined yet."""
    if not GRAM + 2 <= k <= 60_000:
        raise ValueError(f"a window has {GRAM + 2} to 60000 words")
    docs = docs.where("doc is not null").where(F.octet_length("text") >= 2 * k - 1)
    parts = partitions_for(docs, PART_BYTES)

    def grouped(blocks: DataFrame, name: str) -> DataFrame:
        return materialize(blocks.repartition(parts, "part").groupBy("part").applyInArrow(_group, ROWS), name)

    found = grouped(_scan(docs, parts, k, seed, most, local), "pieces")
    edges = grouped(_edges(docs, found.where(F.col("kind") == OPEN), parts, k, seed, most, local), "edges")
    return found.where(F.col("kind") == FOUND).drop("kind").unionByName(edges.where(F.col("kind") == FOUND).drop("kind"))


def _digests(buf: np.ndarray, x: Spelled, row: np.ndarray, s: np.ndarray, n: np.ndarray, k: int) -> list[bytes]:
    """sha256 of the words of n edges from word s of a row, a null byte after each; of spans that leave the row, no bytes."""
    raw, out, starts, ends = buf.tobytes(), [], x.starts.tolist(), x.ends.tolist()
    first, last = x.first[row] + s, x.first[row] + s + n + k - 1
    for a, b, end in zip(first.tolist(), last.tolist(), x.first[row + 1].tolist(), strict=True):
        out.append(hashlib.sha256(b"\0".join([raw[i:j] for i, j in zip(starts[a:b], ends[a:b], strict=True)])).digest() if b <= end else b"")
    return out


CHECK = "array<struct<n: bigint, sdoc: bigint, sh: int, ss: bigint, digest: binary>>"
JUDGED = f"doc bigint, n_words bigint, kept string, removed array<struct<a: bigint, b: bigint>>, checks {CHECK}"


def _judge(k: int, kept_text: bool):
    """Of rows (doc, text, spans): what stays, which words go, and the compacted paths with a digest of their words. Instead of
    the text that stays, its sha256 where kept_text is False."""
    fields = ("s", "n", "sdoc", "sh", "ss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tv.chunks(b.column(1), SCAN_BYTES):
                x = Spelled(buf, offs, 0)
                row, y = _row_range(b.column(2).slice(lo, hi - lo), fields)
                y = compacted(y | {"doc": row, "h": row * 0})
                row = y["doc"]
                digests = _digests(buf, x, row, y["s"], y["n"], k)
                ends = x.first[row + 1]
                a, e = np.minimum(x.first[row] + y["s"], ends), np.minimum(x.first[row] + y["s"] + y["n"] + k - 1, ends)
                depth = np.bincount(a, minlength=len(x.row) + 1) - np.bincount(e, minlength=len(x.row) + 1)
                gone = np.cumsum(depth[:-1]) > 0
                raw, stay = buf.tobytes(), np.flatnonzero(~gone)
                upto = np.searchsorted(stay, x.first).tolist()
                starts, last = x.starts[stay].tolist(), x.ends[stay].tolist()
                texts = [b" ".join([raw[i:j] for i, j in zip(starts[u:v], last[u:v], strict=True)]) for u, v in zip(upto[:-1], upto[1:], strict=True)]
                edge = np.zeros(len(gone) + 1, bool)
                edge[x.first] = True
                begin = np.flatnonzero(gone & (~np.append(False, gone[:-1]) | edge[:-1]))
                end = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1
                of = np.searchsorted(begin, x.first)
                base = np.repeat(x.first[:-1], np.diff(of))
                ranges = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["a", "b"])
                check = pa.StructArray.from_arrays([pa.array(y["n"]), pa.array(y["sdoc"]), pa.array(y["sh"].astype(np.int32)), pa.array(y["ss"]), pa.array(digests, pa.binary())], names=["n", "sdoc", "sh", "ss", "digest"])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(x.first)),
                        pa.array([t.decode() if kept_text else hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), ranges),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), check),
                    ],
                    names=["doc", "n_words", "kept", "removed", "checks"],
                )

    return tidy(run)


def unequal(docs: DataFrame, judged: DataFrame, k: int) -> int:
    """Paths whose words at the source's coordinates are other ones than at their own."""
    asked = judged.select(F.explode("checks").alias("c")).select("c.*").distinct()
    turns = asked.groupBy("sdoc", "sh").agg(F.ceil(F.count(F.lit(1)) / CHECKS).alias("turns"))
    asked = asked.join(turns, ["sdoc", "sh"]).withColumn("turn", F.pmod(F.xxhash64("ss", "n", "digest"), F.col("turns")))
    asked = asked.groupBy(F.col("sdoc").alias("doc"), F.col("sh").alias("h"), "turn").agg(F.collect_list(F.struct("ss", "n", "digest")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tv.chunks(b.column(0), SCAN_BYTES):
                mine = b.column(1).slice(lo, hi - lo)
                row, y = _row_range(mine, ("ss", "n"))
                want = mine.flatten().field("digest").to_pylist()
                bad = sum(a != b for a, b in zip(_digests(buf, Spelled(buf, offs, 0), row, y["ss"], y["n"], k), want, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64())], names=["bad"])

    rows = _with_spans(docs, asked).select("text", "spans").mapInArrow(tidy(run), "bad bigint")
    return rows.agg(F.sum("bad").alias("n")).first()["n"] or 0


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = True, seeds: int = 4, most: int = HELD, local: int = LOCAL) -> DataFrame:
    """(doc, n_words, kept, removed, checks), one row for each row of docs: the words that stay, joined by spaces, the ranges of
    words that went, and the paths behind them. ``most`` and ``local`` change where the work is done, not the result."""
    for seed in range(seeds):
        base = keyed(docs, id_col, text_col, seed)
        found = paths(base, k, seed, most, local)
        # A content that stands in the table more than once was scanned as often; equal runs count once.
        found = found.groupBy("doc", "h", "s").agg(F.max(F.struct("n", "sdoc", "sh", "ss")).alias("x"))
        spans = found.groupBy("doc", "h").agg(F.collect_list(F.struct("s", "x.n", "x.sdoc", "x.sh", "x.ss")).alias("spans"))
        spans = materialize(spans, "spans")
        kind = spans.schema["spans"].dataType
        if spans.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            keys = F.broadcast(spans.select("doc", "h"))
            judged = _with_spans(base, spans).select("doc", "text", "spans").mapInArrow(_judge(k, kept_text), JUDGED)
            rest = base.join(keys, ["doc", "h"], "left_anti").select("doc", "text", F.lit(None).cast(kind).alias("spans"))
            judged, rest = materialize(judged, "judged"), rest.mapInArrow(_judge(k, kept_text), JUDGED)
        else:
            rows = base.join(spans, ["doc", "h"], "left").select("doc", "text", "spans")
            judged, rest = materialize(rows.mapInArrow(_judge(k, kept_text), JUDGED), "judged"), None
        if not unequal(base, judged, k):
            return judged if rest is None else judged.unionByName(rest)
        discard(judged)
    raise RuntimeError(f"{seeds} seeds in turn gave unequal words for equal hashes")


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept_text=False)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select(F.col("doc").alias("doc_id"), "n_words", gone.alias("n_removed"), F.col("kept").alias("kept_sha256"))


def oracle(k: int = K) -> str:
    """The same by DuckDB, each window as a row."""
    return rf"""
with w as materialized (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as materialized (select r, doc_id, i, array_to_string(ws[i:i + {k - 1}], ' ') as g from (select *, unnest(range(1, len(ws) - {k - 2})) as i from w where doc_id is not null)),
lo as (select g, min(doc_id) as lo from win group by g having count(distinct doc_id) > 1),
hit as (select r, i from win join lo using (g) where lo < doc_id),
gone as (select distinct r, unnest(range(i, i + {k})) as p from hit),
words as (select r, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select r, string_agg(x, ' ' order by p) as t from words anti join gone using (r, p) group by r),
n as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join n using (r) left join kept using (r)"""
