"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame, which
is written as Parquet and read again. All but the last return the columns of ``documents``.

Defined results: null texts count as empty ones; rows with a null id are never dropped for an id; repeated rows stay
together; an empty table gives an empty result; columns beyond those of ``documents`` are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_jaccard_join as jaccard
from lodestone.llm import op3_quality_gam as quality
from lodestone.llm import op6_suffix_dedup as suffix
from lodestone.llm import op8_decontaminate as decontaminate
from lodestone.llm import op10_bpe as bpe
from lodestone.llm.runtime import discard, materialize, prepare, settle

#: A document is rejected where the classifier gives a good one less than this probability.
REJECT_BELOW = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def _begin(spark: SparkSession) -> None:
    """What a stage needs of the session; memory that the stage before took is handed back."""
    prepare(spark)
    settle(spark)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _begin(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out_col="__score").where(F.col("__score") >= REJECT_BELOW).drop("__score")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75."""
    _begin(spark)
    return jaccard.one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a string of 200 bytes covers which also starts elsewhere."""
    _begin(spark)
    out = suffix.cut_repeats(docs)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(kind))
    return out.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    _begin(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), edited=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the text."""
    import public_tokenizers

    _begin(spark)
    docs = docs.select("doc_id", "lang", "source", "text")
    ids = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, check_col="round_trip")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("suffix-array dedup", cut_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokenize),
]

#: The stages' models and shingle sets are not expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes as soon as the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            last, out = docs, materialize(out, f"stage{k}")
            discard(last)
        docs = out
    return docs
