"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.session import importable

#: Rows in one Arrow batch. Texts are long, so the batches handed to Python stay small.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Let executors import this package and keep Arrow batches small."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only where all runs in one process may it be unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends, or before by ``discard``."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended
        return


#: Bytes that a task gathers for a scratch file before it writes them.
ROW_GROUP = 16 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(table: DataFrame) -> None:
    """Removes what ``materialize`` wrote for this table, which nothing reads any more."""
    path = table.__dict__.get("_scratch")
    if path:
        _remove(table.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Executors hand the heap that an earlier step grew back to the system, so that steps in one session do not add up."""
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def plus(df: DataFrame, name: str, kind: str, without: str | None = None) -> StructType:
    """df's schema and one more column."""
    return StructType([f for f in df.schema.fields if f.name != without] + StructType.fromDDL(f"`{name}` {kind}").fields)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, for choosing a number of partitions only; measured where it has none."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = df.agg(F.sum(sum(texts, F.lit(8)).cast("long")).alias("n")).first()["n"]
    return int(total or 0)


def partitions_for(df: DataFrame, bytes_each: int, factor: float = 1.0) -> int:
    """Partitions such that each gets about bytes_each of df's size times factor; the session's setting at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = input_bytes(df) * factor / bytes_each
    return max(least, min(200_000, int(n) + 1))


def release() -> None:
    """Hands a worker's freed memory back to the system, where the C library can."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A batch function that hands its memory back when its task ends; workers live on from task to task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


#: Ids up to which a list of documents to drop is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids (one column); null ids stay."""
    ids = materialize(ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).where("__gone is not null").distinct(), "gone")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
