"""Suffix-array deduplication: every byte covered by a 200-byte string that also starts elsewhere goes.

Pieces. Each window has an anchor: its 16-byte gram of least hash, the leftmost of equals. Equal windows have equal
anchors at equal places. The windows of a document that share an anchor are cut where their distance to it passes a
multiple of the level's width; what is left together is a piece. Its core, the bytes that every window of such a place
holds, is the same in equal windows; its hull is all bytes of its windows. A core that stands in one place only holds no
repeat. Where the same hull stands twice, all its windows repeat. What is left, one copy of each hull whose core has
different ones, goes to the core's shard, where a suffix array (``suffix``) and permuted common prefixes decide it.

Where a core has more different hulls than SHARD_BYTES hold (the edge of a passage in very many documents), its pieces
are cut again at the next level's width, a quarter, down to single windows, so that no shard outgrows its bound and a
piece gives a few rows.

Repeats are gathered before they are dealt: of the pieces that one scanning task holds at a time, equal hulls are marked
there, and one goes on; cores with more than LOCAL_HULLS different ones go to the next level, and one goes on.

Documents are compared on the input; matches never cross documents. Cores and hulls are told apart by 64-bit hashes,
windows in shards byte by byte.

Defined results: a null text counts as an empty one (nothing removed); texts shorter than the window keep all bytes;
repeated rows are copies of each other; null ids are kept as they are; an empty table gives no rows; only the id and
the text are carried, so other columns cannot clash; very long texts are scanned in overlapping stretches.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import discard, materialize, partitions_for, release, tidy
from .suffix import permuted_lcp, suffix_array

WINDOW, GRAM = 200, 16
#: The longest window: lengths and distances are packed into 16 bits, of which one is a mark.
MAX_WINDOW = 32_000
#: Parquet bytes of documents whose pieces one task groups, and bytes of hulls in a shard, about.
PART_BYTES, SHARD_BYTES = 16 << 20, 1 << 20
#: Bytes scanned at once, and pieces held by a scanning task before they are dealt.
SCAN_BYTES, STRETCH, HELD = 1 << 18, 1 << 20, 200_000
#: Different hulls of one core among the pieces that a scanning task holds, above which they go to the next level.
LOCAL_HULLS = 1024
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15) | _U(1)
_C = [_U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63)]
_BYTE = tv.mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_MARK = 1 << 15


def widths(window: int) -> list[int]:
    """Distances to the anchor that a piece holds at most, by level: half of all, then a quarter each time, then one."""
    if not GRAM <= window <= MAX_WINDOW:
        raise ValueError(f"a window has {GRAM} to {MAX_WINDOW} bytes")
    out = [(window - GRAM) // 2 + 1]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 4))
    return out


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_R to the powers 0..n and their inverses mod 2^64."""
    inv = pow(int(_R), -1, 1 << 64)
    out = []
    for base in (int(_R), inv):
        p = np.full(n + 1, _U(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place; the last GRAM - 1 places have none."""
    h, width = _BYTE[buf], 1
    for c in _C:  # doubles the width each time: 16 bytes
        if len(h) <= width:
            return np.zeros(0, _U)
        h = h[:-width] * c + (h[width:] ^ (h[width:] >> _U(29)))
        width *= 2
    return tv.mix64(h)


_EMPTY = {"row": np.zeros(0, np.int64), "s0": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "o": np.zeros(0, np.int64), "core": np.zeros(0, _U), "hull": np.zeros(0, _U)}


def cut(h: np.ndarray, row: np.ndarray, start: np.ndarray, at: np.ndarray, window: int, width: int) -> dict[str, np.ndarray]:
    """Pieces of windows (row, start, place of the anchor; in order): row, s0 and n (windows), o (from s0 to the anchor), core, hull.

    h: the hashes of the grams, whose places start and at count.
    """
    o = at - start
    block = o // width
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s, at, o, block = start[first], at[first], o[first], block[first]
    power, inverse = _powers(1 << max(18, len(h).bit_length()))
    upto = np.concatenate([np.zeros(1, _U), np.cumsum(h * power[: len(h)])])

    def spelled(a: np.ndarray, b: np.ndarray, more: np.ndarray) -> np.ndarray:
        """A hash of bytes a..b."""
        return tv.mix64((upto[b - GRAM + 1] - upto[a]) * inverse[a] + tv.mix64(more.astype(_U)))

    core = spelled(at - block * width, at - np.minimum((block + 1) * width - 1, window - GRAM) + window, block)
    hull = spelled(s, s + n - 1 + window, n << 20 | o)
    return {"row": row[first], "s0": s, "n": n, "o": o, "core": core, "hull": hull}


def anchored(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The first level's pieces; s0 counts from the row's first byte."""
    if len(buf) < window:
        return _EMPTY
    h = gram_hashes(buf)
    # The place breaks ties, the leftmost first; 40 bits of hash whatever the stretch, so that ties are the same everywhere.
    value = (h & ~_U((1 << 24) - 1)) | np.arange(len(h), dtype=_U)
    width, span = 1, window - GRAM + 1
    low = value
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    ok = np.ones(len(low), bool)
    lens = np.diff(offs)
    for e, n in zip(offs[1:].tolist(), lens.tolist(), strict=True):  # windows that would leave their row
        ok[max(e - min(window - 1, n), 0) : e] = False
    start = np.flatnonzero(ok)
    if not len(start):
        return _EMPTY
    at = (low[start] & _U((1 << 24) - 1)).astype(np.int64)
    out = cut(h, np.searchsorted(offs, start, "right") - 1, start, at, window, widths(window)[0])
    return out | {"s0": out["s0"] - offs[out["row"]]}


def column_pieces(col: pa.Array, window: int = WINDOW, stretch: int = STRETCH) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, end row, pieces); a text longer than a stretch comes in overlapping stretches."""
    stretch = max(stretch, 2 * window)
    for lo, hi, buf, offs in tv.chunks(col, SCAN_BYTES):
        if len(buf) <= stretch:
            yield lo, hi, anchored(buf, offs, window)
            continue
        for a in range(0, len(buf), stretch - window + 1):  # one row
            b = min(a + stretch, len(buf))
            out = anchored(buf[a:b], np.array([0, b - a]), window)
            yield lo, hi, out | {"s0": out["s0"] + a}
            if b == len(buf):
                break


#: Blocks of packed pieces; kind DEALT: to be grouped, else already decided.
_PACKED = {"s0": np.uint32, "n": np.uint16, "o": np.uint16, "core": _U, "hull": _U}
_BLOCK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "runs", *_PACKED))])
BLOCK = "part int, kind int, ids binary, runs binary, s0 binary, n binary, o binary, core binary, hull binary"
DEALT, REPEATED, ALONE, MANY = -1, 0, 1, 2
FOUND = "kind int, k bigint, h bigint, s0 bigint, n int, o int, core bigint"
_FOUND = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("h", pa.int64()), ("s0", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("core", pa.int64())])


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where a run of rows equal in these columns begins."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _grouped(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by core and hull, first of each hull in it, copies of each hull, number of each hull's core, hulls of each core)."""
    order = np.lexsort((x["hull"], x["core"]))
    core = x["core"][order]
    new_core = _starts(core)
    new = new_core | _starts(x["hull"][order])
    at = np.flatnonzero(new)
    of_core = np.cumsum(new_core)[at] - 1
    return order, at, np.diff(np.append(at, len(order))), of_core, np.bincount(of_core, minlength=1)


def _deal(x: dict[str, np.ndarray], parts: int, spread: int, local: int) -> pa.RecordBatch:
    """Packed blocks of pieces by the core's part. Repeats among them are marked here, in blocks of part ``spread``."""
    order, at, copies, of_core, hulls = _grouped(x)
    hot = (hulls > local)[of_core]
    one = order[at]
    twin, first_of_core = copies > 1, _starts(of_core)
    here = order[np.repeat(twin, copies)]
    go = ~hot | first_of_core
    pick = one[go]
    dealt = {c: x[c][pick] for c in (*_PACKED, "k", "h")}
    dealt["n"] = dealt["n"] | np.where(twin[go], _MARK, 0)
    dealt["o"] = dealt["o"] | np.where(hot[go], _MARK, 0)
    part = ((dealt["core"] >> _U(33)) % _U(parts)).astype(np.int64)
    blocks = [(DEALT, part, dealt)]
    for kind, rows in ((REPEATED, here), (MANY, one[hot])):
        rows = np.sort(rows)  # as scanned
        if len(rows):
            blocks.append((kind, np.full(len(rows), spread % parts), {c: x[c][rows] for c in (*_PACKED, "k", "h")}))
    cols: dict[str, list] = {f.name: [] for f in _BLOCK}
    for kind, part, y in blocks:
        order = np.argsort(part, kind="stable")
        part = part[order]
        y = {c: v[order] for c, v in y.items()}
        upto = np.append(np.flatnonzero(_starts(part)), len(part))
        run_at = np.flatnonzero(_starts(part, y["k"], y["h"]))
        run_len = np.diff(np.append(run_at, len(part))).astype(np.uint32)
        in_runs = np.searchsorted(run_at, upto)
        ids = np.column_stack([y["k"][run_at], y["h"][run_at]])
        for i, p in enumerate(part[upto[:-1]].tolist()):
            a, b, c, d = upto[i], upto[i + 1], in_runs[i], in_runs[i + 1]
            cols["part"].append(p)
            cols["kind"].append(kind)
            cols["ids"].append(ids[c:d].tobytes())
            cols["runs"].append(run_len[c:d].tobytes())
            for name, dtype in _PACKED.items():
                cols[name].append(y[name][a:b].astype(dtype).tobytes() if kind == DEALT or name in ("s0", "n", "o") else b"")
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _BLOCK], schema=_BLOCK)


def _dealt(pieces: Iterator[dict[str, np.ndarray]], parts: int, most: int, local: int) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces (with k and h), ``most`` pieces at a time."""
    from pyspark import TaskContext

    held: list[dict[str, np.ndarray]] = []
    waiting, turn = 0, TaskContext.get().partitionId()
    for x in pieces:
        held.append(x)
        waiting += len(x["s0"])
        if waiting > most:
            yield _deal({c: np.concatenate([d[c] for d in held]) for c in held[0]}, parts, turn, local)
            held, waiting, turn = [], 0, turn + 7919
            release()
    if waiting:
        yield _deal({c: np.concatenate([d[c] for d in held]) for c in held[0]}, parts, turn, local)


def _scan(docs: DataFrame, parts: int, window: int, most: int, local: int) -> DataFrame:
    """Blocks of the first level's pieces. docs: k, h, text."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            k, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _hi, x in column_pieces(b.column(2), window):
                r = x["row"] + lo
                yield x | {"k": k[r], "h": h[r]}

    return docs.mapInArrow(tidy(lambda batches: _dealt(pieces(batches), parts, most, local)), BLOCK)


def _bodies(b: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Of rows (k, h, text, spans), some at a time: (row of each span, bytes of all hulls, their offsets, the spans' columns)."""
    text, spans = b.column(2), b.column(3)
    for lo, hi, buf, offs in tv.chunks(text, SCAN_BYTES):
        mine = spans.slice(lo, hi - lo)
        flat = mine.flatten()
        x = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)}
        row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy())
        size = x["n"] - 1 + window
        upto = np.concatenate([[0], np.cumsum(size)])
        if len(row):
            yield row + lo, buf[np.arange(upto[-1]) + np.repeat(offs[row] + x["s0"] - upto[:-1], size)], upto, x


def _finer(docs: DataFrame, many: DataFrame, parts: int, window: int, most: int, local: int, width: int) -> DataFrame:
    """Blocks of the pieces that the pieces ``many`` are cut into."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            k, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, buf, upto, x in _bodies(b, window):
                n = x["n"]
                of = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + upto[of]
                y = cut(gram_hashes(buf), of, start, (upto[:-1] + x["o"])[of], window, width)
                of = y["row"]
                yield y | {"s0": y["s0"] - upto[of] + x["s0"][of], "k": k[row[of]], "h": h[row[of]]}

    return _with_spans_of(docs, many, "s0", "n", "o").mapInArrow(tidy(lambda batches: _dealt(pieces(batches), parts, most, local)), BLOCK)


def _group(window: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a part: pieces that repeat whole, and one of each hull where a core has different ones."""

        def unpacked(t: pa.Table, names) -> dict[str, np.ndarray]:
            x = {c: np.concatenate([np.zeros(0, _PACKED[c]), *[np.frombuffer(v.as_buffer(), _PACKED[c]) for v in t[c]]]) for c in names}
            ids = np.concatenate([np.zeros((0, 2), np.int64), *[np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 2) for v in t["ids"]]])
            runs = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(v.as_buffer(), np.uint32) for v in t["runs"]]]).astype(np.int64)
            return x | {"ids": ids, "doc": np.repeat(np.arange(len(runs)), runs)}

        def rows(kind: int | np.ndarray, x: dict[str, np.ndarray], take: np.ndarray) -> pa.Table:
            d = x["ids"][x["doc"][take]]
            core = x["core"][take].view(np.int64) if "core" in x else np.zeros(len(take), np.int64)
            n, o = (x[c][take] & (_MARK - 1) for c in ("n", "o"))
            kinds = np.broadcast_to(np.asarray(kind, np.int32), len(take))
            return pa.Table.from_arrays([pa.array(kinds), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(x["s0"][take].astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(core)], schema=_FOUND)

        out = []
        for kind in (REPEATED, MANY):
            t = table.filter(pc.equal(table["kind"], kind))
            if len(t):
                x = unpacked(t, ("s0", "n", "o"))
                if kind == MANY:
                    out.append(rows(kind, x, np.arange(len(x["s0"]))))
                    continue
                # Pieces that follow each other in a document are one run.
                new = _starts(x["doc"], np.cumsum(np.concatenate([[0], x["n"][:-1].astype(np.int64)])) - x["s0"])
                first = np.flatnonzero(new)
                n = np.add.reduceat(x["n"].astype(np.int64), first)
                d = x["ids"][x["doc"][first]]
                zero = np.zeros(len(first), np.int64)
                out.append(pa.Table.from_arrays([pa.array(zero.astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(x["s0"][first].astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(zero.astype(np.int32)), pa.array(zero)], schema=_FOUND))
        t = table.filter(pc.equal(table["kind"], DEALT))
        del table
        if len(t):
            x = unpacked(t, _PACKED)
            del t
            order, at, copies, of_core, hulls = _grouped(x)
            one = order[at]
            marked = (x["n"][order] & _MARK) > 0
            again = (copies > 1) | np.maximum.reduceat(marked, at)
            here = order[np.repeat(again, copies) & ~marked]  # marked ones are told where they were scanned
            hot = np.bincount(of_core, np.maximum.reduceat((x["o"][order] & _MARK) > 0, at), len(hulls)) > 0
            size = np.bincount(of_core, (x["n"][one] & (_MARK - 1)).astype(float) + window, len(hulls))
            kind = np.where(hot | (size > shard_bytes), MANY, ALONE)[of_core]
            pick = (hulls > 1)[of_core] | (hot[of_core] & ~((x["o"][one] & _MARK) > 0))
            out += [rows(REPEATED, x, here), rows(kind[pick], x, one[pick])]
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return run


def _pack(rows: DataFrame, *cols: str) -> DataFrame:
    """Of each content, its different spans: equal rows count once, however many there are."""
    return rows.groupBy("k", "h").agg(F.collect_set(F.struct(*cols)).alias("spans"))


#: Contents up to which a list of those wanted is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 500_000


def _with_spans_of(docs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """k, h, text and spans of the contents that rows name, one row of each."""
    keys = rows.select("k", "h").distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), ["k", "h"], "left_semi")
    docs = docs.groupBy("k", "h").agg(F.first("text").alias("text"))
    return docs.join(_pack(rows, *cols), ["k", "h"]).select("k", "h", "text", "spans")


CONTEXT = "shard int, k bigint, h bigint, s0 bigint, n int, body binary"


def _hulls(docs: DataFrame, wanted: DataFrame, shards: int, window: int) -> DataFrame:
    """The bytes of the wanted pieces' hulls, each with its core's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, upto, x in _bodies(b, window):
                shard = ((x["core"].view(_U) >> _U(7)) % _U(shards)).astype(np.int32)
                take = pa.array(row)
                body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(buf)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), b.column(0).take(take), b.column(1).take(take), pa.array(x["s0"]), pa.array(x["n"].astype(np.int32)), body], names=["shard", "k", "h", "s0", "n", "body"]
                )

    return _with_spans_of(docs, wanted, "s0", "n", "core").mapInArrow(tidy(run), CONTEXT)


SPAN = "k bigint, h bigint, s0 bigint, n int"
_SPAN = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("s0", pa.int64()), ("n", pa.int32())])


def repeated_windows(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, place) of the windows that start at another place in the bodies too, by suffix array."""
    lens = np.fromiter(map(len, bodies), np.int64, len(bodies))
    t = np.frombuffer(b"\xff".join(bodies) + b"\xff\xff", np.uint8).astype(np.int16) + np.int16(1)  # 0xFF is in no UTF-8 text
    t[-1] = 0
    sa = suffix_array(t, 257)
    lcp, phi = permuted_lcp(t, sa)
    long = np.flatnonzero(lcp >= window)
    hit = np.zeros(len(t), bool)
    hit[long] = True
    hit[phi[long]] = True
    first = np.cumsum(lens + 1) - lens - 1
    at = np.flatnonzero(hit)
    body = np.searchsorted(first, at, "right") - 1
    place = at - first[body]
    inside = place + window <= lens[body]
    return body[inside], place[inside]


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        body, place = repeated_windows(table["body"].to_pylist(), window)
        release()
        s0 = table["s0"].to_numpy()[body] + place if len(body) else place
        first = np.flatnonzero(np.concatenate([[True], (body[1:] != body[:-1]) | (place[1:] != place[:-1] + 1)])[: len(body)])
        n = np.diff(np.append(first, len(body)))
        k, h = table["k"].to_numpy(), table["h"].to_numpy()
        return pa.Table.from_arrays([pa.array(k[body[first]]), pa.array(h[body[first]]), pa.array(s0[first]), pa.array(n.astype(np.int32))], schema=_SPAN)

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k, h, text: k and h name a row's content, for joins; rows equal in both are copies."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h = F.xxhash64("text", "doc_id")
    return docs.select("doc_id", F.coalesce("doc_id", h).alias("k"), h.alias("h"), "text")


def repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, local: int = LOCAL_HULLS, most: int = HELD) -> DataFrame:
    """(k, h, s0, n): runs of n window starts from byte s0 whose windows start elsewhere too. docs: keyed().

    The bounds (SHARD_BYTES, LOCAL_HULLS, HELD) change where the work is done, not the result.
    """
    docs = docs.where(F.octet_length("text") >= window).select("k", "h", "text")
    parts = partitions_for(docs, PART_BYTES)
    out, alone, alone_bytes, many, found_at = [], [], 0, None, []
    for level, width in enumerate(widths(window)):
        blocks = _scan(docs, parts, window, most, local) if many is None else _finer(docs, many, parts, window, most, local, width)
        found = materialize(blocks.repartition(parts, "part").groupBy("part").applyInArrow(_group(window, shard_bytes), FOUND), f"pieces{level}")
        found_at.append(found)
        size = {r["kind"]: r["b"] for r in found.groupBy("kind").agg(F.sum(F.col("n") + window - 1).alias("b")).collect()}  # three rows
        out.append(found.where(F.col("kind") == REPEATED).select("k", "h", "s0", "n"))
        if size.get(ALONE):
            alone.append(found.where(F.col("kind") == ALONE).select("k", "h", "s0", "n", "core"))
            alone_bytes += size[ALONE]
        if not size.get(MANY):
            break
        many = found.where(F.col("kind") == MANY).select("k", "h", "s0", "n", "o")
    if alone:
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(min(least, alone_bytes // (shard_bytes // 8 + 1) + 1), alone_bytes // shard_bytes + 1)
        hulls = _hulls(docs, functools.reduce(DataFrame.unionByName, alone), shards, window)
        out.append(hulls.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(window), SPAN))
    spans = materialize(functools.reduce(DataFrame.unionByName, out), "spans")
    for table in found_at:
        discard(table)
    return spans


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (keyed) with ``spans``: a list of (s0, n), null where nothing repeats."""
    return docs.join(_pack(spans, "s0", "n"), ["k", "h"], "left")


def removals(text: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them, which bytes go)."""
    for lo, hi, buf, offs in tv.chunks(text):
        mine = spans.slice(lo, hi - lo)
        row = np.repeat(np.arange(hi - lo), np.asarray(pc.fill_null(mine.value_lengths(), 0)))
        flat = mine.flatten()
        first = offs[row] + flat.field("s0").to_numpy(zero_copy_only=False).astype(np.int64)
        last = first + flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64) - 1 + window
        depth = np.bincount(first, minlength=len(buf) + 1) - np.bincount(last, minlength=len(buf) + 1)
        yield lo, hi, buf, offs, np.cumsum(depth[:-1]) > 0


def kept(buf: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that stay, offsets of the rows in them)."""
    return buf[~gone], np.concatenate([[0], np.cumsum(~gone)])[offs]


def runs(offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, offsets of the rows in these) of the maximal runs of bytes that go; none crosses a row."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[offs] = True
    before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
    first = np.flatnonzero(gone & (~before | edge[:-1]))
    return first, np.flatnonzero(gone & (~after | edge[1:])) + 1, np.searchsorted(first, offs)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, removed): the bytes that stay and the ranges that went, one row for each row."""
    base = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs, gone in removals(b.column(1), b.column(2), window):
                data, upto = kept(buf, offs, gone)
                first, end, of = runs(offs, gone)
                base_of = np.repeat(offs[:-1], np.diff(of))
                ranges = pa.StructArray.from_arrays([pa.array(first - base_of), pa.array(end - base_of)], names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)]),
                        pa.array(np.diff(offs)),
                        pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), ranges),
                    ],
                    names=["doc_id", "kept", "n_bytes", "removed"],
                )

    out = "doc_id bigint, kept binary, n_bytes bigint, removed array<struct<a: bigint, b: bigint>>"
    return with_spans(base, repeats(base, window)).select("doc_id", "text", "spans").mapInArrow(tidy(run), out)


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns and rows, the text less its repeated bytes. What a cut leaves of a character goes too."""
    spans = _pack(repeats(keyed(docs, id_col, text_col), window), "s0", "n")
    spans = spans.select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text, F.col(id_col).cast("long"))
    rows = docs.withColumn("__h", h).withColumn("__k", F.coalesce(F.col(id_col).cast("long"), F.col("__h")))
    rows = rows.join(spans, ["__k", "__h"], "left").select(*docs.columns, "__spans")
    place, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs, gone in removals(b.column(place), b.column(last), window):
                old = b.column(place).slice(lo, hi - lo)
                data, upto = kept(buf, offs, gone)
                touched = np.diff(upto) < np.diff(offs)
                raw, at = data.tobytes(), np.flatnonzero(touched)
                fresh = [raw[upto[i] : upto[i + 1]].decode("utf-8", "ignore") for i in at.tolist()]
                new = pc.replace_with_mask(old, pa.array(touched), pa.array(fresh, old.type)) if fresh else old
                cols = [new if i == place else c.slice(lo, hi - lo) for i, c in enumerate(b.columns[:last])]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:last])

    return rows.mapInArrow(tidy(run), docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs, gone in removals(b.column(1), b.column(2), WINDOW):
                data, upto = kept(buf, offs, gone)
                raw, u = memoryview(data.tobytes()), upto.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offs)),
                        pa.array(np.diff(offs) - np.diff(upto)),
                        pa.array(np.diff(runs(offs, gone)[2]).astype(np.int64)),
                        pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(u[:-1], u[1:], strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    rows = with_spans(base, repeats(base)).select("doc_id", "text", "spans")
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
