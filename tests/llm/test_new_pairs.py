"""Spelling variants, repeated word windows and the manifest against plain loops, and the rows that all have to bear."""

import hashlib
import itertools
import zlib
from collections import Counter

import pytest
from llm_rows import DOCS, ODD
from pyspark.sql import functions as F
from util import duck, rows_of

from lodestone.llm import op11_spelling_variants as op11
from lodestone.llm import op12_debruijn_dedup as op12
from lodestone.llm import op13_merkle_manifest as op13

WIDE = ["g", "h", "pos", "size", "word", "n", "key", "doc", "s", "row", "spans", "_tie", "lang_", "leaf"]


def more(df):
    for name in WIDE:
        df = df.withColumn(name, F.lit("extra"))
    return df


def table(spark, tmp_path, docs):
    """A folder with ``documents``, as the queries read it."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# op11


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize(("letters", "block", "longest"), [("ab", 7, 9), ("abcé", 20_000, 8), ("aÿ", 3, 14)])
def test_near_pairs(llm, rng, letters, block, longest):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(160)}
    words |= {"a" * k for k in range(5, 12)} | {"b" * 40, "b" * 41, "b" * 39 + "a"}
    df = llm.createDataFrame([(w, i + 3) for i, w in enumerate(sorted(words))], "word string, n long")
    got = {(r["a"], r["b"]) for r in op11.near_pairs(df, block=block, part_rows=500).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if near(a, b)}


def test_posting_bound(llm, rng):
    import numpy as np
    import pyarrow as pa

    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(120)})
    g = op11.Grams(pa.array(words))
    n = len(words)
    pairs = set()
    for bound in (1, 50, 10**6):
        for role in (0, 1):
            a, b = op11.merged(np.zeros(n, np.int64), np.ones(n, bool), np.full(n, role, np.int32), g, bound)
            ok = op11.one_edit(a, b, g) & (g.length[b] == g.length[a] + role)
            pairs.add((role, frozenset(zip(a[ok].tolist(), b[ok].tolist(), strict=True))))
    assert len(pairs) == 2
    assert dict(pairs)[1] == {(i, j) for i in range(n) for j in range(n) if len(words[j]) == len(words[i]) + 1 and near(words[i], words[j])}


def brute_forms(docs):
    count = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run and doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
            run = ""
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        has = bool(close) and -close[0][0] >= 2 * n
        out[w] = (n, len(close), close[0][1] if has else None, -close[0][0] if has else None)
    roots = {}
    for w in words:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        roots[w] = at
    return {(w, x[2], roots[w], x[0], x[1], x[3]) for w, x in out.items()}


def test_spelling_variants(llm, rng, tmp_path):
    base = ["".join(rng.choice("abcdeé×") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    base += [w[:2] + "x" + w[2:] for w in base[:10]] + [w[:-1] for w in base[:10]] + ["Straße", "STRASSE", "Élan", "naïve"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 300))) + rng.choice(["", ".", "-x", "\n"])) for i in range(60)]
    docs += [(d, t) for d, t in ODD] + [(None, "hello hello hello hallo"), (3, "hellö1hello_hello")]
    got = op11.op11_spelling_variants(llm, table(llm, tmp_path / "a", llm.createDataFrame(docs, DOCS)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_forms(docs)
    wide = op11.op11_spelling_variants(llm, table(llm, tmp_path / "b", more(llm.createDataFrame(docs, DOCS))))
    assert rows_of(wide) == rows_of(got)
    assert op11.op11_spelling_variants(llm, table(llm, tmp_path / "c", llm.createDataFrame([], DOCS))).count() == 0


def test_long_chain_of_forms(llm):
    words = [("abcde" + "f" * k, 3 * 2 ** (20 - k)) for k in range(20)]
    df = llm.createDataFrame(words, "word string, n long")
    got = op11.forms(df, op11.near_pairs(df)).collect()
    assert {r["root"] for r in got} == {"abcde"} and len(got) == 20


# op12


def brute_removal(docs, k):
    ws = [(t or "").split(" ") if t else [] for _, t in docs]
    ws = [[w for w in x if w] for x in ws]
    first = {}
    for (doc, _), x in zip(docs, ws, strict=True):
        if doc is not None:
            for i in range(len(x) - k + 1):
                g = tuple(x[i : i + k])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for (doc, _), x in zip(docs, ws, strict=True):
        gone = set()
        for i in range(len(x) - k + 1) if doc is not None else []:
            if first[tuple(x[i : i + k])] < doc:
                gone |= set(range(i, i + k))
        out.append((doc, len(x), " ".join(w for i, w in enumerate(x) if i not in gone), len(gone)))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc"], r["n_words"], r["kept"], sum(b - a for a, b in r["removed"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "vocabulary", "most", "local"), [(13, 3, 10**6, 1024), (13, 400, 50, 2), (6, 2, 200, 1), (8, 6, 10**6, 1), (30, 50, 300, 1024)])
def test_word_windows(llm, rng, k, vocabulary, most, local):
    words = [f"w{i}" for i in range(vocabulary)]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    docs = []
    for i in range(70):
        text = " ".join(rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5)))
        docs.append((rng.randint(0, 50) if i % 9 == 0 else 100 - i, text))
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, parts[0] * 2), (500, None), (501, ""), (-7, parts[1]), (502, "x " * 2000), (503, "x " * 2000)]
    df = llm.createDataFrame(docs, DOCS)
    got = op12.remove_repeats(df, k=k, most=most, local=local)
    assert removed(got) == brute_removal(docs, k)


def test_common_passage_and_anchor(llm, rng):
    """A passage in all documents, and an anchor that stands in different words everywhere, go through every branch."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for i in range(120):
        own = " ".join(f"d{i}x{j}" for j in range(20))
        docs.append((i, f"{own} {passage} {own[::-1]} p3 p4 p5 p6 z{i} z{i + 1} " + " ".join(f"q{i % 3}{j}" for j in range(15))))
    got = op12.remove_repeats(llm.createDataFrame(docs, DOCS), most=200, local=3)
    assert removed(got) == brute_removal(docs, 13)
    spans = got.where("doc = 119").select(F.explode("checks").alias("c")).select("c.*").collect()
    assert len(spans) <= 3  # the passage is one path, not forty edges


def test_collisions_are_found(llm):
    """A path whose source reads otherwise counts as unequal, so that another seed is tried."""
    text = " ".join(f"a{i}" for i in range(30))
    df = llm.createDataFrame([(1, text), (2, text.replace("a", "b")), (3, text)], DOCS)
    spans = llm.createDataFrame([(2, 1, 0, 5), (3, 1, 0, 18)], "doc long, sdoc long, s long, n long")
    base = op12.keyed(df, "doc_id", "text", 0)
    h = {r["doc"]: r["h"] for r in base.collect()}
    hs = F.create_map(*[F.lit(x) for d in h.items() for x in d])
    spans = spans.select("doc", F.element_at(hs, F.col("doc").cast("int")).alias("h"), F.array(F.struct("s", "n", "sdoc", F.element_at(hs, F.col("sdoc").cast("int")).alias("sh"), F.lit(0).cast("long").alias("ss"))).alias("spans"))
    judged = base.join(spans, ["doc", "h"]).select("doc", "text", "spans").mapInArrow(op12._judge(13, True), op12.JUDGED)
    assert op12.unequal(base, judged, 13) == 1


def test_windows_odd_rows(llm, tmp_path):
    docs = llm.createDataFrame(ODD, DOCS)
    got = op12.op12_debruijn_dedup(llm, table(llm, tmp_path / "a", docs))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == len(ODD)
    assert rows_of(op12.op12_debruijn_dedup(llm, table(llm, tmp_path / "b", more(docs)))) == rows_of(got)
    assert op12.op12_debruijn_dedup(llm, table(llm, tmp_path / "c", llm.createDataFrame([], DOCS))).count() == 0


# op13

FULL = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """(root, of each node the siblings level by level, and the places to put it in)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(at):
            paths[k].append((runs[p // 8], p % 8))
        level, at = [sha(*r) for r in runs], [p // 8 for p in at]
    return level[0], paths


def brute_manifest(rows):
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    groups = {}
    for r in sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(key(r), []).append(r)
    trees = {g: climb([leaf_of(r) for r in rs]) for g, rs in groups.items()}
    order = sorted(groups)
    root, top = climb([trees[g][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            path = path + top[i]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            up = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            h = leaf_of((*r[:4], up)) if hit else leaf_of(r)
            for run, p in path:
                h = sha(*run[:p], h, *run[p + 1 :])
            proof = sha(*[x for run, p in path for q, x in enumerate(run) if q != p])
            out.append((r[0], leaf_of(r), trees[g][0], root, proof, h, h == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 65, "de": 1, "fr": 64, None: 3, "é": 513}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_manifest(llm, rng, tmp_path, sizes):
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((rng.choice([n, n, n, 7, None]) if n % 11 == 0 else n * 3 % 1009, rng.choice([None, "", "web", "bü"]), lang, rng.choice([None, 0, 12]), rng.choice([None, "", "Ab Cd", "é", "word " * 50])))
    rows += rows[:2]
    df = llm.createDataFrame(rows, FULL).repartition(5)
    got = op13.op13_merkle_manifest(llm, table(llm, tmp_path / "a", df))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_manifest(rows)
    assert rows_of(got) == duck_on(str(tmp_path / "a"), op13.oracle())
    wide = op13.op13_merkle_manifest(llm, table(llm, tmp_path / "b", more(df)))
    assert rows_of(wide) == rows_of(got)


def duck_on(folder, sql):
    import duckdb
    from util import _plain

    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted(repr(tuple(_plain(row[i]) for i in at)) for row in r.fetchall())


def test_manifest_tells_changes(llm, tmp_path):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"Text {i}") for i in range(100)]
    m = op13.manifest(llm.createDataFrame(rows, FULL))
    now = [(*r[:4], "other") if r[0] in (5, 66) else r for r in rows]
    assert {r["doc_id"] for r in op13.differing(llm.createDataFrame(now, FULL), m).collect()} == {5, 66}
    assert op13.op13_merkle_manifest(llm, table(llm, tmp_path / "a", llm.createDataFrame([], FULL))).count() == 0
    assert op13.manifest(llm.createDataFrame([], FULL)).root is None


@pytest.mark.parametrize("op", [(op11, "op11_spelling_variants"), (op12, "op12_debruijn_dedup"), (op13, "op13_merkle_manifest")])
def test_against_sql(llm, op):
    sf = "/root/testdata/sf0.001"
    assert rows_of(getattr(*op)(llm, sf)) == duck(op[0].oracle(), sf)
