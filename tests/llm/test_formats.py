"""Token files, BPE, rules, URLs and conversations: round trips, SQL and brute force."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import DOCS, ODD
from util import SF, duck, rows_of

from lodestone.llm import op4_chat_format as op4
from lodestone.llm import op5_token_orc as op5
from lodestone.llm import op7_url_filter as op7
from lodestone.llm import op9_quality_rules as op9
from lodestone.llm import op10_bpe as op10
from lodestone.llm import queries

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "B", "é", "É", "Σ", "ς", "'", "'s", "'t", "’", ".", ",", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", " ", "  ", "\t", "\n", "\r\n", "́", "…", "１", "23", "中", "🙂", "%", "\xa0", "\x85", "\x1c", "\x0b", "the", "ing", "aaaa"]


def fuzz(rng, n):
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)]


# --- token files ---


def test_pieces_give_the_library_ids(rng):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), fuzz(rng, 3000)
    got = [ids[offs[i] : offs[i + 1]].tolist() for lo, hi, ids, offs in op5.encode_column(pa.array(texts), path, 2) for i in range(hi - lo)]
    assert got == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_other_vocabulary(rng):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), [t.replace("<|endoftext|>", "") for t in fuzz(rng, 500)]
    got = [ids[offs[i] : offs[i + 1]].tolist() for lo, hi, ids, offs in op5.encode_column(pa.array(texts), path, None) for i in range(hi - lo)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_orc_round_trip(llm, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    out = str(tmp_path / "t")
    op5.write_tokens(llm.createDataFrame(ODD, DOCS), out, path)
    rows = sorted(op5.checksums(op5.with_starts(op5.read_tokens(llm, out))).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    texts, start = {str(i): t for i, t in ODD}, 0
    for r in rows:
        ids = [*lib.encode(texts[str(r["doc_id"])] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert op5.read_tokens(llm, out).where("doc_id = 6").count() == 1
    assert any(f.endswith(".orc") for f in os.listdir(out))
    op5.write_tokens(llm.createDataFrame([], DOCS), str(tmp_path / "e"), path)
    assert op5.with_starts(op5.read_tokens(llm, str(tmp_path / "e"))).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = op10.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_gives_the_library_ids(rng, library):
    c = op10.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    tokens = [t for t in library._mergeable_ranks if len(t) <= 4]
    texts = fuzz(rng, 3000) + [b"".join(rng.choices(tokens, k=rng.randint(1, 8))).decode("utf-8", "ignore") for _ in range(20_000)] + ["ab" * 5000, "a" * 3000]
    got = []
    for lo, hi, ids, offs, _, _ in c.encode_column(pa.array(texts)):
        raw, upto = c.decode(ids, offs)
        got += [(ids[offs[i] : offs[i + 1]].tolist(), raw[upto[i] : upto[i + 1]].tobytes()) for i in range(hi - lo)]
    assert got == [(library.encode_ordinary(t), t.encode()) for t in texts]


def test_other_pattern(rng):
    import tiktoken

    pattern = r"[^\r\n]+|[\r\n]"
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op10.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    c, texts = op10.codec(P.path("byte_bpe_50k.tiktoken"), pattern), fuzz(rng, 500)
    got = [ids[offs[i] : offs[i + 1]].tolist() for lo, hi, ids, offs, _, _ in c.encode_column(pa.array(texts)) for i in range(hi - lo)]
    assert got == [lib.encode_ordinary(t) for t in texts]


def test_same_bytes():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"aabbcc", b"aabxcc"))
    assert op10.same_bytes(a, np.array([0, 2, 4, 6]), b, np.array([0, 2, 4, 6])).tolist() == [True, False, True]
    assert op10.same_bytes(a, np.array([0, 2, 4, 6]), b, np.array([0, 2, 3, 6])).tolist() == [True, False, False]


def test_bpe_frames(llm, library):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = llm.createDataFrame([(*r, "x") for r in ODD], DOCS + ", decoded0 string")
    back = op10.decode(op10.encode(docs, path, P.PATTERN, check_col="same"), path, P.PATTERN).collect()
    assert len(back) == len(ODD) and all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["same"] for r in back)
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in back)
    with pytest.raises(ValueError):
        op10.encode(docs, path, P.PATTERN, out_col="text")
    d = {r["doc_id"]: r for r in op10.digests(docs, path, P.PATTERN).collect()}
    assert d[1]["n_tokens"] == 0 and d[1]["ids_sha256"] == d[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


# --- rules ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(llm, name):
    assert rows_of(queries.QUERIES[name](llm, SF)) == duck(queries.ORACLE_SQL[name])


def test_rules(llm, rng):
    texts = [" ".join(rng.choice(["a", "b", "c", "d#"]) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\na b\n a b\nA B!"]) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in op9.ledger(llm.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        solid = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(again), len(solid) - len(set(solid)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and bool(r["fail_bits"] & 1) == (len(w) < 50)
    led = op9.ledger(llm.createDataFrame(rows, DOCS))
    kept = op9.apply_policy(led, "v1").where("kept").count()
    assert kept == sum(1 for r in got.values() if not r["fail_bits"] & op9.mask("v1"))
    ab = {r["rule"]: r for r in op9.ablation(led, "base").collect()}
    assert ab["min_words"]["n_failed"] == sum(r["fail_bits"] & 1 for r in got.values())
    assert ab["min_words"]["n_failed_alone"] == sum(r["fail_bits"] & 3 == 1 for r in got.values())
    assert op9.ledger(llm.createDataFrame([], DOCS)).count() == 0


# --- URLs ---

PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def test_parts_and_given_rules(llm):
    urls = [None, "nourl", "", "http://A.Org", "HTTP://X.ORG:80/?q#f", "a://b://c/d", "http://q.com/fr/x", "http://example.org/en/12#z", "http://notexample.org/es/", "http://example.org/es/?x", "http://a.com/de/"]
    got = {r["page_id"]: r for r in op7.url_filter(llm.createDataFrame(list(enumerate(urls)), PAGES), llm.createDataFrame([], LABELS)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in op7.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2]), u
    assert urlparse("http://q.com/fr/x").hostname == got[6]["host"]


def test_mined_rules(llm):
    """Rules as brute force finds them: token sets of enough support and confidence, none implied by a shorter one."""
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'ok'}.example.net/{'x' if i % 2 else 'y'}/p{i}") for i in range(240)] + [(999, None)]
    labels = [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(240)] + [(None, 0, 1)]
    out = op7.url_filter(llm.createDataFrame(pages, PAGES), llm.createDataFrame(labels, LABELS)).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {i for i in range(240) if i % 3 == 0 and i % 2}
    assert len(out) == len(pages)
    assert op7.url_filter(llm.createDataFrame([], PAGES), llm.createDataFrame(labels, LABELS)).count() == 0


def _tokens(url):
    scheme, rest = url.split("://")
    host, *segments = rest.split("?")[0].split("/")
    labels = host.split(".")
    out = {"p:" + scheme} | {"d:" + ".".join(labels[k:]) for k in range(len(labels))} | {f"s{k}:{x}" for k, x in enumerate(segments)}
    pairs = rest.split("?")[1].split("&") if "?" in rest else []
    return out | {"k:" + q.split("=")[0] for q in pairs} | {"q:" + q for q in pairs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_by_brute_force(llm, seed):
    """Every set of a page's tokens counted: the same pages fire, with the same confidence, labelled or not."""
    rng = random.Random(seed)
    pages = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice('abc')}.{rng.choice('uv')}.net/{rng.choice('xyz')}{rng.choice(['', '?k=1', '?k=2'])}") for i in range(500)]
    pages += pages[:30]  # repeated rows count each time
    words = sorted({t for _, u in pages for t in _tokens(u)})
    sour = [set(rng.sample(sorted(_tokens(rng.choice(pages)[1])), 2)) for _ in range(4)]  # pairs that pages have
    labels = [(i, 0 if any(s <= _tokens(u) for s in sour) and rng.random() < 0.9 else 1, 0) for i, u in pages[:400]]
    bad = {i: not q for i, q, _ in labels}
    known = [(_tokens(u), bad[i]) for i, u in pages if i in bad]
    need = max(20, math.ceil(0.002 * len(known)))
    on = {t: frozenset(k for k, (have, _) in enumerate(known) if t in have) for t in words}
    chosen = {max((t for t in words if on[t] == p), key=lambda t: (len(t), t)) for p in on.values() if len(p) >= need}
    n, hits = Counter(), Counter()
    for have, b in known:
        have = sorted(have & chosen)
        for k in range(1, len(have) + 1):
            for x in itertools.combinations(have, k):
                n[x] += 1
                hits[x] += b
    rules = {frozenset(x): hits[x] / n[x] for x in n if hits[x] >= need and hits[x] / n[x] >= 0.7}
    least = {x: c for x, c in rules.items() if not any(y < x for y in rules)}
    assert least
    out = op7.url_filter(llm.createDataFrame(pages, PAGES), llm.createDataFrame(labels, LABELS), [])
    want = [(i, u, max((c for x, c in least.items() if x <= _tokens(u)), default=None)) for i, u in pages]
    got = sorted((r["page_id"], r["verdict"], r["confidence"]) for r in out.fillna(-1.0, "confidence").collect())
    assert got == sorted((i, "allow" if c is None else "block", -1.0 if c is None else c) for i, _, c in want)


# --- conversations ---


def test_snapshots(llm):
    talk = lambda c, *turns: [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    a, b, c = ("user", "hi"), ("assistant", "yes <|end|>"), ("user", None)
    rows = talk(1, a) + talk(2, a, b) + talk(3, a, b, c) + talk(4, a, c) + talk(5, a, b, c) + talk(6, ("system", "hi")) + [(7, None, None, "x"), (7, 1, "user", "y"), (None, 0, "user", "lost")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as p1")
    got = {r["conv_id"]: r for r in op4.chat_format(df).collect()}
    assert {k: (r["n_turns"], r["n_copies"]) for k, r in got.items()} == {3: (3, 2), 4: (2, 1), 6: (1, 1), 7: (2, 1), None: (1, 1)}
    assert got[3]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes <\\|end|><|end|>\n<|user|>\n<|end|>\n"
    assert got[7]["rendered"].startswith("<|unknown|>\nx<|end|>")
    assert op4.chat_format(df.limit(0)).count() == 0
    assert json.dumps(got[4]["rendered"])
