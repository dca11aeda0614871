"""Classifiers: held-out accuracy, gradients, and rows that are odd."""

import re
import zlib

import numpy as np
import pyarrow as pa
from llm_rows import DOCS, ODD
from util import SF

from lodestone.llm import op2_toxicity as op2
from lodestone.llm import op3_quality_gam as op3
from lodestone.llm import textvec as tv
from lodestone.llm.labelled import sample_docs

LABELS = "doc_id long, quality int, toxic int"


def auc(p, y):
    return float(np.mean(p[y == 1][:, None] > p[y == 0][None, :]))


def held(df, labels, name, folds, fold):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = [r for r in df.collect() if r["doc_id"] in truth]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    rows = [r for r in rows if r["held_out"]]
    return np.array([r["score"] for r in rows]), np.array([truth[r["doc_id"]] for r in rows])


def test_quality(llm):
    sf = SF.replace("0.001", "0.01")
    p, y = held(op3.op3_quality_gam(llm, sf), llm.read.parquet(f"{sf}/labels.parquet"), "quality", 4, 2)
    assert auc(p, y) > 0.97 and (p[y == 1] >= 0.7).mean() > 0.95


def synthetic(rng, n=900):
    vocab = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "mo") for b in ("ra", "ne", "ti", "so", "pu", "va")]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 200]))]
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "vermin", "zorg" + rng.choice(vocab)])  # the last only by its beginning
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(llm, rng):
    rows = synthetic(rng)
    docs = llm.createDataFrame([r[:2] for r in rows], DOCS)
    labels = llm.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    model = op2.train(docs, labels)
    out = op2.score(docs, model).collect()
    mine = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    p, y = np.array([r["score"] for r in mine]), np.array([rows[r["doc_id"]][2] for r in mine])
    assert auc(p, y) > 0.97 and (p[y == 1] >= 0.7).mean() > 0.8 and (p[y == 0] >= 0.7).mean() < 0.03
    odd = op2.score(llm.createDataFrame(ODD, DOCS), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert op2.score(docs.limit(0), model).count() == 0


def test_gradients():
    r = np.random.default_rng(1)
    net = op2.Net(3)
    net.w["att"] = r.standard_normal(2 * op2.HIDDEN).astype(np.float32)
    pieces = r.integers(0, 50, (20, len(op2.PIECES) + 2)).astype(np.int32)
    index, lens = r.integers(0, 20, (4, op2.WINDOW)), np.array([op2.WINDOW, 5, 1, 0])
    y, weight = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 0.5, 1], np.float32)

    def loss():
        x = net.embed(pieces)
        out = net.logits(tuple(x @ net.w[f"in{d}"] + net.w[f"b{d}"] for d in (0, 1)), index, lens).astype(float)
        return float(np.mean(weight * (np.logaddexp(0, out) - y * out)))

    g = net.gradients(pieces, index, lens, y, weight)
    for name in ("in0", "in1", "rec0", "rec1", "b0", "att", "out", "bias"):
        flat = net.w[name].reshape(-1)
        for k in (0, flat.size // 2, flat.size - 1):
            old, step = flat[k], 3e-2
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 2e-3, (name, k)


def test_windows_cover_every_word():
    rows = np.repeat(np.arange(5), [0, 1, 32, 33, 100])
    first, lens, row = op2.windows_of(rows, 5)
    seen = np.zeros(len(rows), int)
    for f, n, r in zip(first, lens, row, strict=True):
        assert (rows[f : f + n] == r).all()
        seen[f : f + n] += 1
    assert seen.min() == 1 and set(row) == set(range(5)) and lens.max() <= op2.WINDOW


def test_without_labels(llm):
    docs = llm.createDataFrame(ODD, DOCS)
    none = llm.createDataFrame([], LABELS)
    one = llm.createDataFrame([(4, 1, 1), (5, 1, 1), (None, 0, None)], LABELS)
    for train, score in ((op2.train, op2.score), (op3.train, op3.score)):
        assert {r["score"] for r in score(docs, train(docs, none)).collect()} == {0.5}
        assert len({r["score"] for r in score(docs, train(docs, one)).collect()}) == 1


def test_sample_is_bounded(llm):
    """One row for each id, whole texts, as many as fit; the held-out fold never takes part."""
    docs = llm.createDataFrame([(i, "x" * 100) for i in range(200)] + [(0, "again " * 50)] * 40 + [(None, "z"), (1, None)], DOCS)
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    free = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = sample_docs(docs, labels, "quality", 4, 2, 500).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(free)
    assert all(r["text"] == ("" if r["doc_id"] == 1 else "x" * 100 if r["doc_id"] else "again " * 50) for r in rows)
    few = sample_docs(docs, labels, "quality", 4, 2, 500, max_bytes=1000).collect()
    assert 18 <= len(few) <= 22 and {r["doc_id"] for r in few} <= free
    assert all(sum(len(r["text"]) for r in few if r["y"] == y) <= 1000 for y in (0, 1))
    assert len(sample_docs(docs, labels, "quality", 4, 2, 5).collect()) == 10


def test_features():
    x = op3.features(pa.array(["a a b\n\na a b\nZZ!! 12 #", None, "", "x" * 100_000]))
    assert x.shape == (4, len(op3.FEATURES)) and np.isfinite(x).all()
    f = dict(zip(op3.FEATURES, x[0], strict=True))
    assert f["repeated_words"] == 2 / 9 and f["distinct_lines"] == 2 / 3 and f["distinct_words"] == 5 / 9


def _logit(net, words):
    """One window by a plain loop over words and units."""
    w, h = {k: v.astype(float) for k, v in net.w.items()}, op2.HIDDEN
    xs = []
    for word in words:
        buf = np.frombuffer(word, np.uint8)
        at = np.array([0]), np.array([len(buf)])
        p = op2.pieces_of(buf, *at, tv.word_hashes(buf, *at))[0]
        xs.append(w["word"][p[0]] + sum(w["char"][k] for k in p[1:]))
    states = np.zeros((len(xs), 2 * h))
    for d in (0, 1):
        s = np.zeros(h)
        for t in range(len(xs)) if d == 0 else reversed(range(len(xs))):
            x, u = xs[t] @ w[f"in{d}"] + w[f"b{d}"], s @ w[f"rec{d}"]
            z, q = (1 / (1 + np.exp(-(x[k * h : k * h + h] + u[k * h : k * h + h]))) for k in (0, 1))
            c = np.tanh(x[2 * h :] + q * u[2 * h :])
            s = z * s + (1 - z) * c
            states[t, d * h : d * h + h] = s
    if not len(xs):
        return w["bias"][0]
    a = np.exp(states @ w["att"])
    return a @ states / a.sum() @ w["out"] + w["bias"][0]


def test_toxicity_scores_by_brute_force(rng):
    """Every window of whole texts by itself; a document's score is that of its worst window."""
    r, net = np.random.default_rng(5), op2.Net(5)
    net.w = {k: (r.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in net.w.items()}
    net.scale, net.shift = 0.7, -0.2
    vocab = ["a", "Bad", "é", "中文字", "word", "x" * 90, "No!", "zorgling", "\xa0"]
    texts = [" ".join(rng.choices(vocab, k=k)) for k in (1, 2, 31, 32, 33, 47, 48, 49, 64, 200, 1000)] + ["", " \n", None, "\ta\x0bb "]
    want = []
    for t in texts:
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]  # of bytes, lower() takes A-Z only
        starts = [0] + [k for k in range(op2.STRIDE, len(words), op2.STRIDE) if k + op2.WINDOW - op2.STRIDE < len(words)]
        worst = max(_logit(net, words[k : k + op2.WINDOW]) for k in starts)
        want.append(1 / (1 + np.exp(-(0.7 * worst - 0.2))))
    assert np.allclose(net.score(pa.array(texts)), want, atol=2e-4)


def test_quality_scores_by_brute_force():
    """Each score is the sum of one bin of each table; splits are the best of all; a planted pair is chosen first."""
    r = np.random.default_rng(3)
    x = np.round(r.random((600, 5)), 1)  # with ties
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    model = op3.Gam(x, y)
    assert model.pairs[0][:2] == (3, 1)
    seen = np.concatenate([x[:60], r.random((60, 5)) * 3 - 1])
    for row, got in zip(seen, model.score(seen), strict=True):
        z = model.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables, strict=True))
        z += sum(t[sum(c <= row[i] for c in model.pair_cuts[i])][sum(c <= row[j] for c in model.pair_cuts[j])] for i, j, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
    assert auc(model.score(x), y) > 0.97
    for _ in range(50):
        g, h = r.standard_normal(7), r.random(7)
        part = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + op3.L2)  # noqa: B023, E731
        gains = [part(0, k) + part(k, 7) - part(0, 7) for k in range(1, 7)]
        gain, k = op3._split(g, h)
        assert abs(gain - max(gains)) < 1e-9 and gains[k - 1] == max(gains)


def test_features_by_brute_force(rng):
    pick = ["a", "A", "bb", "é", "1", "#", "x=", "|", "!", "long" * 6, "\n", "\n", "\n\n", "\t"]
    texts = [rng.choice([" ", "  "]).join(rng.choices(pick, k=rng.randint(0, 60))) for _ in range(300)]
    for t, x in zip(texts, op3.features(pa.array(texts)), strict=True):
        raw = t.encode()
        lines = [w for w in (re.findall(rb"[^\x20\x09-\x0D]+", part.lower()) for part in raw.split(b"\n")) if w]
        words = [w for line in lines for w in line]
        n, k, size = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
        want = {
            "log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / n, "capitals": sum(65 <= b <= 90 for b in raw) / size,
            "digits": sum(48 <= b <= 57 for b in raw) / size, "exclamations": raw.count(b"!") / size, "bars": raw.count(b"|") / size,
            "symbols": sum(b in b"#*$%&<>^~=" for b in raw) / size, "punctuation": sum(b in b".,;:!?'\"()" for b in raw) / size,
            "repeated_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "distinct_words": len(set(words)) / n,
            "distinct_lines": len({tuple(line) for line in lines}) / k, "short_lines": sum(len(line) < 4 for line in lines) / k,
            "words_per_line": len(words) / k, "ends_in_symbol": sum(w[-1] in b"#*$%&<>^~=" for w in words) / n,
            "non_ascii": sum(b >= 128 for b in raw) / size, "long_words": sum(len(w) > 20 for w in words) / n,
        }
        assert np.allclose(x, [want[f] for f in op3.FEATURES]), t
