"""Extra columns whose names the operators use themselves change no result; score columns that exist are refused."""

import pytest
from llm_rows import DOCS, ODD
from pyspark.sql import functions as F

from lodestone.llm import op2_toxicity as op2
from lodestone.llm import op3_quality_gam as op3
from lodestone.llm import op5_token_orc as op5
from lodestone.llm import op7_url_filter as op7
from lodestone.llm import op8_decontaminate as op8

NAMES = ["y", "h", "row", "key", "turn", "shard", "start", "ids", "item_id", "tokens", "token", "host", "path", "rule", "rule_id", "given", "verdict", "confidence", "bad", "items", "n", "low", "high", "__upto", "__size", "predicted", "held_out"]


def more(df):
    """The same rows, with a column of text under each name that the frame does not have yet."""
    for k, name in enumerate(n for n in NAMES if n not in df.columns):
        df = df.withColumn(name, F.lit(f"extra {k}"))
    return df


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("op", [op2, op3])
def test_classifiers(llm, op):
    texts = [f"{'vile ' if i % 2 else 'calm '}{'word ' * (i % 7)}{i}" for i in range(60)]
    docs = llm.createDataFrame([*enumerate(texts), (None, None), (3, "")], DOCS)
    labels = llm.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = op.train(docs, labels)
    wide = more(docs)
    want = rows(op.score(docs, model).select("doc_id", "score"))
    out = op.score(wide, op.train(wide, more(labels)))
    assert rows(out.select("doc_id", "score")) == want
    assert set(wide.columns) <= {*out.columns, "text"} and out.where("y = 'extra 0'").count() == len(texts) + 2
    with pytest.raises(ValueError):
        op.score(docs.withColumn("score", F.lit(0.0)), model)


def test_token_files(llm, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = llm.createDataFrame(ODD, DOCS)
    for name, df in (("a", docs), ("b", more(docs))):
        op5.write_tokens(df, str(tmp_path / name), path)
    a, b = (op5.checksums(op5.with_starts(op5.read_tokens(llm, str(tmp_path / n)))) for n in "ab")
    assert rows(a) == rows(b)


def test_urls(llm):
    pages = llm.createDataFrame([(i, f"http://{'bad' if i % 3 else 'ok'}.net/{i % 2}") for i in range(120)] + [(None, None), (7, "")], "page_id long, url string")
    labels = llm.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    want = op7.url_filter(pages, labels)
    assert want.where("verdict = 'block'").count() == 80
    assert rows(op7.url_filter(more(pages), more(labels))) == rows(want)


def test_benchmark(llm):
    item = " ".join(f"w{k}" for k in range(30))
    docs = llm.createDataFrame([(1, item), (2, "clean words " * 20), (3, f"x {item} y"), (None, None)], DOCS)
    items = llm.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    want = rows(op8.leaks(docs, items))
    assert len(want) == 2 and rows(op8.leaks(more(docs), more(items))) == want
    wide = more(docs)
    assert op8.clean(wide, items).columns == wide.columns and {r["doc_id"] for r in op8.clean(wide, items).collect()} == {2, None}
