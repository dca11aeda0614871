"""Near duplicates, repeated passages, decontamination: against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import DOCS, ODD

from lodestone.llm import components, suffix
from lodestone.llm import op1_jaccard_join as op1
from lodestone.llm import op6_suffix_dedup as op6
from lodestone.llm import op8_decontaminate as op8


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def jaccard(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = set(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * len(sets[x] | sets[y]):
                    a, b = find(x), find(y)
                    top[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(rng):
    vocab = [f"w{i}" for i in range(2000)]
    some = lambda k: [rng.choice(vocab) for _ in range(k)]
    docs = []
    base = some(200)
    for _ in range(60):  # near copies, in links of all strengths
        x = list(base)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        docs.append(x)
    for _ in range(50):  # a chain
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        docs.append(base)
    shared = some(40)
    docs += [some(rng.randint(5, 120)) + shared for _ in range(60)] + [shared] * 40
    for _ in range(60):
        b = some(rng.randint(1, 30))
        docs += [b, [*b[:-1], "zz"]]
    out = [" ".join(d) for d in docs] + ["", None, "  ", "a", "A", "a b"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard_join(llm, rng, monkeypatch, tight):
    if tight:  # too few segments, so that deletion neighbourhoods and single n-grams are needed
        monkeypatch.setattr(op1.Bands, "_segments", lambda self, low, high: 0 if high < 12 else max(2, high // 4 + 1))
    docs = corpus(rng)
    got = op1.jaccard_join(llm.createDataFrame(docs, DOCS)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == jaccard(docs)


#: Few sets make a signature hot, blocks are small, and without hubs the blocks have to find the links.
@pytest.mark.parametrize(("hot", "block", "size", "hubs"), [(2, 2048, 1 << 24, True), (3, 8, 1 << 24, False), (4, 16, 2000, True), (32, 4, 1 << 24, False)])
def test_jaccard_hot(llm, rng, hot, block, size, hubs):
    docs = corpus(rng)
    got = op1.jaccard_join(llm.createDataFrame(docs, DOCS), hot_sets=hot, block_sets=block, block_bytes=size, hubs=hubs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == jaccard(docs)


def test_near_copies_need_no_blocks(llm, rng, monkeypatch):
    """A group of near copies: as many rows as members meet the hub, and no pair of blocks is left."""
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    docs = []
    for i in range(300):
        x = list(base)
        x[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(x)))
    met = []
    real = op1._with_hubs
    monkeypatch.setattr(op1, "_with_hubs", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    monkeypatch.setattr(op1, "_block_links", lambda *a: pytest.fail("blocks"))
    got = op1.jaccard_join(llm.createDataFrame(docs, DOCS), hot_sets=8).collect()
    assert {r["component_id"] for r in got} == {0} and met[0] < 300


def test_jaccard_odd_rows(llm):
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in op1.jaccard_join(llm.createDataFrame(ODD, DOCS)).collect()}
    assert rows == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (None, 1): None, (6, 1): 6, (7, 1): 7}
    assert op1.jaccard_join(llm.createDataFrame([], DOCS)).count() == 0
    extra = llm.createDataFrame([(1, "a b c d e f", 3, 4)], "doc_id int, text string, part int, component_id int")
    assert op1.one_of_each(extra).columns == extra.columns


def test_components(llm):
    e = llm.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (2, 1)], "u long, v long")
    assert sorted(tuple(r) for r in components.components(e).collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]


# --- suffix arrays ---


def test_suffix_array(rng, monkeypatch):
    for _ in range(400):
        k = rng.choice([2, 3, 30])
        t = [rng.randint(1, k) for _ in range(rng.randint(0, 50))] * rng.choice([1, 3])
        t = np.array([*t, 0], np.int32)
        monkeypatch.setattr(suffix, "MOST_BUCKETS", rng.choice([0, 3, 1024]))
        sa = suffix.suffix_array(t, k + 1)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == order
        lcp, phi = suffix.permuted_lcp(t, sa)
        for a, b in zip(order, order[1:], strict=False):
            m = 0
            while t[a + m : a + m + 1].tolist() == t[b + m : b + m + 1].tolist() != []:
                m += 1
            assert lcp[b] == m and phi[b] == a


def removed(rows, window=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


def shown(df, window=200):
    out = []
    for r in df.collect():
        n = sum(x["b"] - x["a"] for x in r["removed"])
        assert len(r["kept"]) == r["n_bytes"] - n
        out.append((r["doc_id"], r["n_bytes"], n, len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out, key=repr)


#: Levels are forced by small shards, or by few hulls a core among those that a task holds.
@pytest.mark.parametrize(("window", "shard_bytes", "local"), [(200, 1 << 20, 256), (200, 1, 256), (200, 5000, 256), (200, 1 << 20, 2), (50, 1 << 20, 256), (50, 1, 3), (300, 5000, 256), (600, 1 << 20, 256), (600, 3000, 2), (16, 1, 256)])
def test_repeats(llm, rng, monkeypatch, window, shard_bytes, local):
    monkeypatch.setattr(op6.repeats, "__defaults__", (window, shard_bytes, local, 3000))
    letters = "abcdefgh é"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [some(rng.randint(150, 900)) for _ in range(6)] + [some(window + 90)]
    texts = []
    for _ in range(80):
        pieces = [rng.choice([some(rng.randint(0, 150)), rng.choice(passages), rng.choice(passages)[: rng.randint(1, 700)], rng.choice(passages)[rng.randint(1, 300) :]]) for _ in range(rng.randint(0, 5))]
        texts.append("".join(pieces))
    texts += [some(rng.randint(0, 60)) + passages[-1] + some(rng.randint(0, 60)) for _ in range(60)]  # one passage in many documents
    texts += ["a" * 1000, "ab" * 300, "a" * 199, "a" * 200, "a" * 201, "", None, "x" * 50 + "a" * 230, texts[3]]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[7])]
    got = op6.remove_repeats(llm.createDataFrame(rows, DOCS), window)
    assert shown(got) == removed(rows, window)


def test_repeats_many_copies(llm, rng):
    """Rows that are equal in every column, null ids too, take space in proportion to their number."""
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    base = op6.keyed(llm.createDataFrame([(None, text)] * 10_000 + [(7, text[:400]), (8, "other " * 9)], DOCS))
    spans = op6.repeats(base)
    assert op6._pack(spans, "s0", "n").count() == 2
    assert op6.with_spans(base, spans).agg(__import__("pyspark").sql.functions.max("spans")).first()[0] is not None
    assert spans.count() <= 10_001 * 20
    got = op6.remove_repeats(llm.createDataFrame([(None, text)] * 500 + [(7, text[:400])], DOCS)).groupBy("n_bytes").agg({"kept": "max", "*": "count"}).collect()
    assert {(r["n_bytes"], r["count(1)"], bytes(r["max(kept)"])) for r in got} == {(900, 500, b""), (400, 1, b"")}


def test_window_bounds():
    with pytest.raises(ValueError, match="window"):
        op6.widths(op6.MAX_WINDOW + 1)


def test_stretches(rng):
    text = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    flat = lambda parts: {(int(s) + j, int(s + o)) for _, _, x in parts for s, n, o in zip(x["s0"], x["n"], x["o"], strict=True) for j in range(n)}
    assert flat(op6.column_pieces(pa.array([text]))) == flat(op6.column_pieces(pa.array([text]), stretch=1500))


def test_cut_keeps_columns(llm):
    docs = llm.createDataFrame([(1, "é" * 150, 7), (2, "é" * 150, 8), (3, "plain", 9), (4, None, 1)], "doc_id long, text string, k int")
    out = op6.cut_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["k"]) for r in out.where("doc_id < 4").collect()) == [(1, "", 7), (2, "", 8), (3, "plain", 9)]
    assert op6.remove_repeats(docs.limit(0)).count() == 0


# --- decontamination ---


def leaks(docs, items):
    items = [(i, words(t)) for i, t in items if words(t)]
    n, df = len(items), Counter(w for _, ws in items for w in set(ws))
    mean = sum(len(w) for _, w in items) / n
    stride = max(24, -(-max(len(w) for _, w in items) // 2))
    weight = []
    for _, ws in items:
        imp = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
        weight.append({w: v / sum(imp.values()) for w, v in imp.items()})
    out = []
    for d, t in docs:
        ws, best, p = words(t), {}, 0
        while ws:
            window = set(ws[p : p + 2 * stride])
            for j in range(n):
                s = sum(v for w, v in weight[j].items() if w in window)
                if s >= 0.5:
                    best[j] = max(best.get(j, 0), s)
            if p + 2 * stride >= len(ws):
                break
            p += stride
        for j, s in best.items():
            half, shares = -(-len(items[j][1]) // 2), []
            for part in (items[j][1][:half], items[j][1][half:]):
                m = min(5, len(part))
                grams = {tuple(part[k : k + m]) for k in range(len(part) - m + 1)}
                shares.append(len(grams & {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)}) / len(grams) if part else 1.0)
            if min(shares) >= 0.6:
                out.append((d, items[j][0], round(s, 4), *[round(x, 4) for x in shares]))
    return sorted(out, key=repr)


def test_decontaminate(llm, rng):
    vocab = ["the", "of", "to", *[f"v{i}" for i in range(900)]]
    some = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, some(rng.choice([1, 3, 12, 40, 60]))) for i in range(150)] + [(500, ""), (501, None)]
    docs = []
    for i in range(120):
        t = some(rng.randint(0, 300))
        if i % 3 == 0:
            leak = rng.choice(items[:150])[1].split()
            if i % 2 and len(leak) > 8:
                leak[rng.randrange(len(leak))] = "edited"
            t += " " + " ".join(leak) + " " + some(40)
        docs.append((i, t))
    docs += ODD
    d, b = llm.createDataFrame(docs, DOCS), llm.createDataFrame(items, "item_id long, text string")
    shown = lambda df: sorted(((r["doc_id"], r["item_id"], *[round(r[c], 4) for c in ("score", "question_overlap", "answer_overlap")]) for r in df.collect()), key=repr)
    assert shown(op8.leaks(d, b)) == leaks(docs, items)
    assert shown(op8.leaks(d, b, index_bytes=4000)) == leaks(docs, items)
    assert op8.leaks(d.limit(0), b).count() == 0 and op8.leaks(d, b.limit(0)).count() == 0
    bad = {r[0] for r in leaks(docs, items)}
    assert {r["doc_id"] for r in op8.clean(d, b).collect()} == {i for i, _ in docs} - bad


def test_decontaminate_edited_copies(llm, rng, tmp_path):
    """The query and the pipeline's stage find copies with one to three words changed, lost or added, and without punctuation."""
    import corpus_pipeline

    vocab = ["the", "of", "to", *[f"v{i}" for i in range(900)]]
    some = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = []
    for i in range(120):
        ws = some(rng.randint(15, 59))
        items.append((i, " ".join(w + rng.choice(["", "", ",", ".", "?", "’"]) for w in ws)))
    docs, planted = [], set()
    for i in range(360):
        ws, kind = items[i % 120][1].split(), i // 120
        if kind == 0:
            for at in rng.sample(range(len(ws)), rng.randint(1, 3)):
                ws[at] = "edited"
        elif kind == 1:
            ws = re.sub(r"[^\w ]", "", " ".join(ws)).split()
            ws[rng.randrange(len(ws))] = "edited"
        else:
            for _ in range(rng.randint(1, 3)):
                del ws[rng.randrange(len(ws))]
            ws.insert(rng.randrange(len(ws)), "- added")
        docs.append((i, " ".join(some(rng.randint(0, 200)) + ws + some(rng.randint(0, 90)))))
        planted.add((i, i % 120))
    docs += [(1000 + i, " ".join(some(300))) for i in range(60)]
    docs += [(2000 + i, " ".join(items[i][1].split()[: len(items[i][1].split()) // 2] + some(100))) for i in range(60)]  # no answer
    llm.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = op8.op8_decontaminate(llm, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted and len(rows) == len(planted)
    kept = corpus_pipeline.decontaminated(llm, llm.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i >= 1000}


@pytest.mark.parametrize("heavy", [0, 1, 3, 1000])
def test_retrieve_with_any_pivot(rng, monkeypatch, heavy):
    """All passages and items that reach the threshold, whichever lists lead the walk, on many small blocks."""
    monkeypatch.setattr(op8, "BLOCK", 4)
    vocab = [f"v{i}" for i in range(400)]
    some = lambda k: [rng.choice(vocab[: rng.choice([9, 60, 400])]) for _ in range(k)]
    items = [some(rng.choice([3, 12, 40])) for _ in range(150)]
    ix = op8.Index(list(range(150)), [" ".join(x) for x in items], heavy=heavy)
    one = op8.Index(list(range(150)), [" ".join(x) for x in items])
    texts = [some(rng.randint(0, 150)) + rng.choice(items) + some(rng.randint(0, 80)) for _ in range(60)]
    rows = np.repeat(np.arange(60), [len(t) for t in texts])
    hashes = np.concatenate([op8._item_words(" ".join(t), False)[0] for t in texts])
    best, places = ix.retrieve(ix.number(hashes), rows, 60)
    n, df = len(items), Counter(w for x in items for w in set(x))
    mean = sum(map(len, items)) / n
    want, where = {}, {}
    base = 0
    for r, t in enumerate(texts):
        p = 0
        while True:
            window = set(t[p : p + ix.width])
            for j, x in enumerate(items):
                imp = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in Counter(x).items()}
                score = sum(v for w, v in imp.items() if w in window) / sum(imp.values())
                if score >= 0.5:
                    want[r, j] = max(want.get((r, j), 0), score)
                    where.setdefault((r, j), []).append(base + p)
            if p + ix.width >= len(t):
                break
            p += ix.stride
        base += len(t)
    assert best.keys() == want.keys() and len(want) > 60
    assert all(best[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert {k: sorted(v) for k, v in places.items()} == where
    assert one.nbytes > 0 and best.keys() == one.retrieve(one.number(hashes), rows, 60)[0].keys()


@pytest.mark.parametrize("more", [{}, {"edited": True}])
def test_decontaminate_in_slices(llm, rng, more):
    """Slices of the benchmark give the scores, windows and leaks of the whole."""
    vocab = ["the", "of", "to", *[f"v{i}" for i in range(300)]]
    some = lambda k: " ".join(rng.choice(vocab[: rng.choice([9, 300])]) for _ in range(k))
    items = [(i, some(rng.choice([3, 12, 30, 90]))) for i in range(100)] + [(500, ""), (501, None)]
    docs = [(i, some(rng.randint(0, 200)) + " " + items[i % 100][1].replace(" v1", " edited v2", 2) + " " + some(60)) for i in range(150)]
    d, b = llm.createDataFrame(docs, DOCS), llm.createDataFrame(items, "item_id long, text string")
    shown = lambda df: {(r["doc_id"], r["item_id"]): r[2:] for r in df.collect()}
    one, many = shown(op8.leaks(d, b, **more)), shown(op8.leaks(d, b, index_bytes=4000, **more))
    assert one.keys() == many.keys() and len(one) > 100
    assert all(many[k] == pytest.approx(v, abs=2e-5) for k, v in one.items())


def test_jaccard_part_of_many_sets():
    """A part of more than 2^23 sets gives its pairs and its hot members."""
    n = (1 << 23) + 101
    sid = np.arange(10, n + 10, dtype=np.int64)
    keys = np.arange(n, dtype=np.uint64)
    keys[-1] = keys[5]  # one pair
    keys[-61:-1] = keys[7]  # 61 sets with one signature
    block = op1._blocks(sid, np.zeros(n, np.int64), keys, 1)
    found = op1._group(pa.Table.from_batches([block])).to_pylist()
    assert [(r["a"], r["b"], r["slack0"]) for r in found if r["kind"] == op1.PAIR] == [(15, n + 9, 1)]
    hot = [r for r in found if r["kind"] == op1.MEMBER]
    assert sorted(r["a"] for r in hot) == [17, *range(n - 51, n + 9)] and len({r["b"] for r in hot}) == 1
