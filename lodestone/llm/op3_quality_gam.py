"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a fixed vector of statistics. Training cycles over the features: in its turn a feature gets a shallow
tree (two levels of splits over its bins) fitted to the gradients so far, and the tree's leaves are added to the
feature's lookup table. Then the pairs whose joint bins explain most of what is left get tables of their own in the same
way. A score is a sum of table entries found by bin, for whole columns at once.

Training rows: at most MAX_LABELLED of each class, by least hash of the id, outside the held-out fold; only their
statistics reach the driver. Everything else covers every row and the whole of each text.

Defined results: a null text counts as an empty one and gets a score like any other; repeated rows get equal scores; an
empty table gives no rows; with no labels, or labels of one class, every score is the share of label 1 (0.5 with none);
only the id and the text are read from the documents, so other columns cannot clash.
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

MAX_LABELLED = 8_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, L2 = 60, 30, 0.15, 4.0
FOLDS, HELD = 4, 2
THRESHOLD = 0.7

FEATURES = [
    "log_words", "word_bytes", "symbols", "capitals", "digits", "punctuation", "exclamations", "repeated_words",
    "distinct_words", "distinct_lines", "short_lines", "words_per_line", "ends_in_symbol", "non_ascii", "bars", "long_words",
]


def _kinds() -> np.ndarray:
    kind = np.zeros((256, 6), bool)
    for k, chars in enumerate((b"#*$%&<>^~=", range(65, 91), range(48, 58), b".,;:!?'\"()", b"!", b"|")):
        kind[list(chars), k] = True
    return kind


_KIND = _kinds()


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for _lo, _hi, buf, offs in tv.chunks(col):
        out.append(_chunk_features(buf, offs))
    return np.concatenate(out)


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(mask)])
    return (upto[offs[1:]] - upto[offs[:-1]]).astype(float)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each row; rows come in order."""
    key = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def _chunk_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    starts, ends, rows = tv.words(buf, offs)
    size = np.maximum(np.diff(offs), 1).astype(float)
    words = tv.row_counts(rows, n).astype(float)
    some = np.maximum(words, 1)
    low = tv.lower(buf)
    hashes = tv.word_hashes(low, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    line_first = np.zeros(len(buf) + 1, bool)
    line_first[offs] = True
    line_first[1:][buf == 10] = True
    # A word opens a line if a line starts between the word before it and itself.
    lines_upto = np.cumsum(line_first)
    opens = np.ones(len(starts), bool)
    opens[1:] = lines_upto[starts[1:]] != lines_upto[starts[:-1]]
    lines = np.bincount(rows[opens], minlength=n).astype(float) if len(rows) else np.zeros(n)
    at = np.flatnonzero(opens)
    if len(at):
        place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        line_hash = tv.mix64(np.add.reduceat(hashes * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), at))
        distinct_lines = _distinct(rows[at], line_hash, n)
        short = np.bincount(rows[at][np.diff(np.append(at, len(starts))) < 4], minlength=n)
    else:
        distinct_lines, short = np.zeros(n), np.zeros(n)
    counts = [_per_row(_KIND[buf, k], offs) for k in range(6)]
    end_symbol = np.bincount(rows, weights=_KIND[buf[ends - 1], 0], minlength=n) if len(rows) else np.zeros(n)
    lens = ends - starts
    long_words = np.bincount(rows[lens > 20], minlength=n) if len(rows) else np.zeros(n)
    solid = np.bincount(rows, weights=lens, minlength=n) if len(rows) else np.zeros(n)
    some_lines = np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log1p(words), solid / some, counts[0] / size, counts[1] / size, counts[2] / size, counts[3] / size, counts[4] / size,
            (np.bincount(rows[again], minlength=n) if len(rows) else np.zeros(n)) / some,
            _distinct(rows, hashes, n) / some, distinct_lines / some_lines, short / some_lines, np.minimum(words / some_lines, 1e3),
            end_symbol / some, _per_row(buf >= 0x80, offs) / size, counts[5] / size, long_words / some,
        ]
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins left of the split) of the best split of bins with these sums."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    gl, hl = cg[:-1], ch[:-1]
    gain = gl**2 / (hl + L2) + (cg[-1] - gl) ** 2 / (ch[-1] - hl + L2) - cg[-1] ** 2 / (ch[-1] + L2)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step for each bin from a tree of this depth."""
    gain, k = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + L2))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step for each cell): the best split along one side, then of each half along the other."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(g))
    for side in (0, 1):
        a, b = (g, h) if side == 0 else (g.T, h.T)
        _, k = _split(a.sum(1), b.sum(1))
        step, gain = np.zeros_like(a), 0.0
        for part in (slice(0, k), slice(k, len(a))):
            if not len(a[part]):
                continue
            u, v = a[part].sum(0), b[part].sum(0)
            s = _tree(u, v, 1)
            gain += float(-(s * u).sum() - 0.5 * (s * s * v).sum())
            step[part] = s
        if gain > best[0]:
            best = (gain, step if side == 0 else step.T)
    return best


class Gam:
    """Lookup tables for features and pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pair_cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base, self.constant = 0.0, share if len(y) == 0 or share in (0.0, 1.0) else None
        if self.constant is None:
            self._fit(x, y.astype(float), share)

    def _fit(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        self.base = float(np.log(share / (1 - share)))
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = _sigmoid(z)
                m = len(self.tables[j])
                step = RATE * _tree(np.bincount(b, p - y, m), np.bincount(b, p * (1 - p), m))
                self.tables[j] += step
                z += step[b]
        wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
        sizes = [len(c) + 1 for c in self.pair_cuts]

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            p, cell, shape = _sigmoid(z), wide[i] * sizes[j] + wide[j], (sizes[i], sizes[j])
            m = shape[0] * shape[1]
            return np.bincount(cell, p - y, m).reshape(shape), np.bincount(cell, p * (1 - p), m).reshape(shape)

        all_pairs = [(i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
        chosen = sorted(all_pairs, key=lambda q: -_pair_tree(*sums(*q))[0])[:PAIRS]
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                step = RATE * _pair_tree(*sums(i, j))[1]
                table += step
                z += step[wide[i], wide[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return _sigmoid(z)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED, folds: int = FOLDS, held: int = HELD) -> Gam:
    """Fits the tables; the driver gets 2 * most rows of statistics at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sample_docs(docs, labels, label, folds, held, most).select("text", "y").mapInArrow(tidy(run), "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)
    return Gam(x[order], rows["y"].to_numpy()[order])


def score(docs: DataFrame, model: Gam, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score; all other columns stay. out_col must be a new name."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} exists")
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(features(b.column(place)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out_col])

    return docs.mapInArrow(tidy(run), plus(docs, out_col, "double"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    place = docs.select(F.col("doc_id"), (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the text does not go back to the JVM
        for b in batches:
            s = shared.value.score(features(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["doc_id", "held_out", "score"])

    out = place.mapInArrow(tidy(run), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
