"""The pipeline's stages against plain versions of what they decide, each on its own input."""

import hashlib

import corpus_pipeline as cp
import pytest
from test_pairs import jaccard, leaks, removed
from util import SF

from lodestone.llm import op3_quality_gam as op3
from lodestone.llm.runtime import materialize


def test_stages(llm):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    docs = llm.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for _, stage in cp.STAGES:
        docs = materialize(stage(llm, docs, SF), "test")
        steps.append(docs.collect())
    start = llm.read.parquet(f"{SF}/documents.parquet")
    columns = start.columns
    text = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    # quality: what the model gives, and labelled good documents stay
    model = op3.train(start, llm.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in op3.score(start, model).collect() if r["score"] >= cp.REJECT_BELOW}
    assert {r["doc_id"] for r in steps[0]} == good
    # near duplicates: the least of each component
    assert sorted(r["doc_id"] for r in steps[1]) == [i for i, _, c in jaccard(text(steps[0])) if i == c]
    # passages
    want = {i: h for i, _, _, _, h in removed(text(steps[1]))}
    for r in steps[2]:
        whole = hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]]
        assert whole or r["text"] != dict(text(steps[1]))[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert len(steps[2]) == len(steps[1])
    # leaks
    items = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks(text(steps[2]), items)}
    assert {r["doc_id"] for r in steps[3]} == {r["doc_id"] for r in steps[2]} - bad
    # tokens
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=__import__("lodestone.llm.op10_bpe", fromlist=["x"]).load_ranks(P.path(cp.RANKS)), special_tokens={})
    last = dict(text(steps[3]))
    assert all(r["ids"] == enc.encode_ordinary(last[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in steps[4])
    assert len(steps[4]) == len(last)
    assert all([f for f in s[0].asDict()] == columns for s in steps[:4] if s)


def test_empty(llm, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        llm.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(llm, str(tmp_path)).count() == 0
