"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a word embedding and embeddings of its characters (beginnings of three to six bytes and
endings of three, hashed). Two gated recurrent layers read each window of WINDOW words forwards and backwards, attention
pools their states, and a logistic unit gives the window's probability. Windows start every STRIDE words, so they
overlap and cover every word; a document's score is that of its worst window.

Training sees labels of at most MAX_LABELLED documents of each class outside the held-out fold, chosen by hash, and of
their texts at most ``labelled.MAX_BYTES`` for each class.
Smoothed log-odds of words and character pieces start the first place of the embeddings, and choose the windows to learn
from: in toxic documents those of most evidence, in others those of most evidence and evenly spread ones. Gradients are
taken by hand (back-propagation through time) and applied by Adam. A last logistic fit on documents that were left out
of that calibrates the worst window's logit.

Defined results: a null or empty text gets the score of an empty window; repeated rows get equal scores; an empty table
gives no rows; with no labels, or labels of one class, every score is the share of label 1 (0.5 with none); only the id
and the text are read from the documents, so other columns cannot clash; a long text is a longer list of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .labelled import fold, sample_docs
from .runtime import plus, tidy

MAX_LABELLED = 3_000
WINDOW, STRIDE = 32, 16
WORD_SLOTS, CHAR_SLOTS, DIM, HIDDEN = 1 << 15, 1 << 15, 6, 6
STEPS, BATCH, RATE = 300, 256, 0.01
FOLDS, HELD = 3, 1
THRESHOLD = 0.7
PIECES = (3, 4, 5, 6)

F4 = np.float32


def pieces_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row for each word: its word slot, then the slots of its beginnings and its ending."""
    lens = ends - starts
    out = np.empty((len(starts), len(PIECES) + 2), np.int32)
    out[:, 0] = hashes & np.uint64(WORD_SLOTS - 1)
    code, top = np.zeros(len(starts), np.uint64), max(PIECES)
    for k in range(top):
        c = np.where(k < lens, buf[np.minimum(starts + k, len(buf) - 1)], 0) if len(buf) else np.zeros(0, np.uint8)
        code = code * np.uint64(257) + c.astype(np.uint64)
        if k + 1 in PIECES:
            out[:, 1 + PIECES.index(k + 1)] = tv.mix64(code + np.uint64((k + 1) << 56)) & np.uint64(CHAR_SLOTS - 1)
    code = np.zeros(len(starts), np.uint64)
    for k in (3, 2, 1):
        code = code * np.uint64(257) + np.where(lens >= k, buf[np.maximum(ends - k, 0)], 0).astype(np.uint64) if len(buf) else code
    out[:, -1] = tv.mix64(code + np.uint64(99 << 56)) & np.uint64(CHAR_SLOTS - 1)
    return out


def windows_of(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of each window; a row without words has one window of no words."""
    count = tv.row_counts(rows, n)
    many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(n), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = k * STRIDE
    first = np.cumsum(count) - count
    return first[row] + at, np.minimum(WINDOW, count[row] - at), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """The network's weights, its pass over windows, and its gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(F4)
        h = HIDDEN
        self.w = {
            "word": n(WORD_SLOTS, DIM, k=0.01), "char": n(CHAR_SLOTS, DIM, k=0.01),
            "in0": n(DIM, 3 * h), "in1": n(DIM, 3 * h), "b0": np.zeros(3 * h, F4), "b1": np.zeros(3 * h, F4),
            "rec0": n(h, 3 * h), "rec1": n(h, 3 * h), "att": n(2 * h), "out": n(2 * h), "bias": np.zeros(1, F4),
        }
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def embed(self, pieces: np.ndarray) -> np.ndarray:
        x = self.w["word"][pieces[:, 0]]
        for k in range(1, pieces.shape[1]):
            x = x + self.w["char"][pieces[:, k]]
        return x

    def logits(self, proj: tuple[np.ndarray, np.ndarray], index: np.ndarray, lens: np.ndarray, keep: bool = False):
        """proj: input sums by word number, for either direction; index [windows, WINDOW]; words beyond lens don't count."""
        b, t = index.shape
        h2 = np.empty((t, b, 2 * HIDDEN), F4)
        tape: list = [[], []]
        short = lens < t
        for d in (0, 1):
            h = np.zeros((b, HIDDEN), F4)
            rec = self.w[f"rec{d}"]
            for s in range(t) if d == 0 else range(t - 1, -1, -1):
                x = proj[d][index[:, s]]
                u = h @ rec
                zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
                z, q = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + q * u[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if short.any():
                    new[s >= lens] = 0
                if keep:
                    tape[d].append((s, h, z, q, c, u[:, 2 * HIDDEN :]))
                h = new
                h2[s, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        e = h2 @ self.w["att"]
        if short.any():
            e[np.arange(t)[:, None] >= np.maximum(lens, 1)[None, :]] = -30
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, h2)
        out = pooled @ self.w["out"] + self.w["bias"][0]
        return (out, (h2, a, pooled, tape)) if keep else out

    def gradients(self, pieces: np.ndarray, index: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted cross entropy; index points into pieces."""
        w, h = self.w, HIDDEN
        x = self.embed(pieces)
        proj = tuple(x @ w[f"in{d}"] + w[f"b{d}"] for d in (0, 1))
        out, (h2, a, pooled, tape) = self.logits(proj, index, lens, True)
        do = ((_sigmoid(out) - y) * weight / len(y)).astype(F4)
        g = {"out": pooled.T @ do, "bias": np.array([do.sum()], F4)}
        dpool = do[:, None] * w["out"]
        da = np.einsum("bh,tbh->tb", dpool, h2)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tb,tbh->h", de, h2)
        dh2 = a[:, :, None] * dpool[None] + de[:, :, None] * w["att"]
        dx = np.zeros_like(x)
        for d in (0, 1):
            dproj = np.zeros((len(x), 3 * h), F4)
            drec, dh = np.zeros_like(w[f"rec{d}"]), np.zeros((len(y), h), F4)
            for s, before, z, q, c, uc in reversed(tape[d]):
                dh = dh + dh2[s, :, d * h : (d + 1) * h]
                dh[s >= lens] = 0
                dz, dc = dh * (before - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
                dq = dc * uc * q * (1 - q)
                du = np.concatenate([dz, dq, dc * q], 1)
                drec += before.T @ du
                din = np.concatenate([dz, dq, dc], 1)
                np.add.at(dproj, index[:, s], din)
                dh = dh * z + du @ w[f"rec{d}"].T
            g[f"rec{d}"], g[f"in{d}"], g[f"b{d}"] = drec, x.T @ dproj, dproj.sum(0)
            dx += dproj @ w[f"in{d}"].T
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], pieces[:, 0], dx)
        for k in range(1, pieces.shape[1]):
            np.add.at(g["char"], pieces[:, k], dx)
        return g

    def worst(self, col: pa.Array) -> np.ndarray:
        """The largest window logit of each text."""
        out = np.zeros(len(col))
        for lo, hi, buf, offs in tv.chunks(col):
            buf = tv.lower(buf)
            starts, ends, rows = tv.words(buf, offs)
            hashes = tv.word_hashes(buf, starts, ends)
            _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            x = self.embed(pieces_of(buf, starts[at], ends[at], hashes[at]))
            x = np.concatenate([x, np.zeros((1, DIM), F4)])  # the last is the place beyond a window's words
            proj = tuple(x @ self.w[f"in{d}"] + self.w[f"b{d}"] for d in (0, 1))
            first, lens, row = windows_of(rows, hi - lo)
            which = np.append(which, len(x) - 1)
            best = np.full(hi - lo, -np.inf)
            for i in range(0, len(first), 2048):
                f, n = first[i : i + 2048], lens[i : i + 2048]
                at = f[:, None] + np.arange(WINDOW)
                index = which[np.where(np.arange(WINDOW) < n[:, None], at, len(which) - 1)]
                np.maximum.at(best, row[i : i + 2048], self.logits(proj, index, n))
            out[lo:hi] = best
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(col), self.constant)
        return _sigmoid(self.worst(col) * self.scale + self.shift)


def _evidence(slots: np.ndarray, docs: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of each slot by the documents that have it; what few have counts little."""
    pair = np.unique(slots.astype(np.int64) * len(y) + docs)
    slot, doc = pair // len(y), pair % len(y)
    t, n = np.bincount(slot[y[doc] == 1], minlength=size), np.bincount(slot[y[doc] == 0], minlength=size)
    nt, nn = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    odds = np.log((t + 0.5) / (nt + 1)) - np.log((n + 0.5) / (nn + 1))
    return (odds * np.minimum(1, (t + n) / 8)).clip(-2, 6)


def fit(texts: pa.Array, y: np.ndarray) -> Net:
    """Trains on whole texts and their labels."""
    net, share = Net(), float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        net.constant = share
        return net
    apart = np.arange(len(y)) % 4 == 3  # for the calibration
    pieces, rows = [], []
    for lo, _hi, buf, offs in tv.chunks(texts):
        buf = tv.lower(buf)
        s, e, r = tv.words(buf, offs)
        pieces.append(pieces_of(buf, s, e, tv.word_hashes(buf, s, e)))
        rows.append(r + lo)
    pieces, rows = np.concatenate(pieces), np.concatenate(rows)
    used = ~apart[rows]
    word = _evidence(pieces[used, 0], rows[used], np.where(apart, -1, y), WORD_SLOTS)
    char = np.max([_evidence(pieces[used, k] , rows[used], np.where(apart, -1, y), CHAR_SLOTS) for k in range(1, pieces.shape[1])], 0)
    net.w["word"][:, 0] += (word / 6).astype(F4)
    net.w["char"][:, 0] += (char / 6).astype(F4)
    value = word[pieces[:, 0]] + char[pieces[:, 1:]].max(1)
    first, lens, row = windows_of(rows, len(y))
    upto = np.concatenate([[0], np.cumsum(np.maximum(value, 0) ** 2)])
    total = upto[first + lens] - upto[first]
    order = np.lexsort((-total, row))
    place = np.arange(len(order)) - np.repeat(np.searchsorted(row[order], np.arange(len(y))), np.bincount(row, minlength=len(y)))
    few = place < np.where(y[row[order]] == 1, 1, 2)
    spread = (y[row[order]] == 0) & (place % 8 == 5)
    chosen = np.sort(order[(few | spread) & ~apart[row[order]]])
    rng = np.random.default_rng(11)
    target = y[row[chosen]].astype(F4)
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(F4).clip(0.2, 5)
    pad = np.zeros((1, pieces.shape[1]), np.int32)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    while step < STEPS:
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(shuffled), BATCH):
            pick = shuffled[i : i + BATCH]
            f, n = first[chosen[pick]], lens[chosen[pick]]
            flat = np.where(np.arange(WINDOW) < n[:, None], f[:, None] + np.arange(WINDOW), -1)
            seen, index = np.unique(flat, return_inverse=True)
            rows_in = np.concatenate([pad, pieces[seen[1:]]]) if seen[0] < 0 else pieces[seen]
            g = net.gradients(rows_in, index.reshape(flat.shape), n, target[pick], weight[pick])
            step += 1
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.01 * (d * d - v2[k])
                net.w[k] -= (RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(F4)
    _calibrate(net, net.worst(texts.filter(pa.array(apart))), y[apart])
    return net


def _calibrate(net: Net, z: np.ndarray, y: np.ndarray) -> None:
    """A logistic fit of two weights by Newton's steps, lightly held to (1, 0)."""
    if not len(z) or y.min() == y.max():
        return
    x, b = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ b)
        g = x.T @ (p - y) + 0.5 * (b - [1, 0])
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -1, 1)
    if b[0] > 0:
        net.scale, net.shift = float(b[0]), float(b[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED, folds: int = FOLDS, held: int = HELD) -> Net:
    rows = sample_docs(docs, labels, label, folds, held, most).toArrow()
    rows = rows.sort_by("doc_id")
    return fit(rows["text"].combine_chunks(), rows["y"].to_numpy())


def score(docs: DataFrame, model: Net, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Replaces the text by its score; all other columns stay. out_col must be a new name."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} exists")
    rest = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.score(b.column(len(rest))))], names=[*rest, out_col])

    ordered = docs.select(*rest, text_col)
    return ordered.mapInArrow(tidy(run), plus(ordered, out_col, "double", text_col))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
