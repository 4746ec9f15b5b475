"""The loop primitive: driver iteration over DataFrames with lineage cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="floeberg-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: a table written to the shared folder and read back.

    Unlike a checkpoint, which runs the plan once more to write it, this runs it
    once; like one, it survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # for discard()
    return out


def cut_seen(df: DataFrame, **sums) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over it that are taken while it is written; an aggregate over no rows is 0."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *(how.alias(name) for name, how in sums.items())))
    return out, {name: seen.get.get(name) or 0 for name in ("_rows", *sums)}


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` written as a table in ``buckets`` buckets by ``keys``, sorted by them, and read back.

    Joins and aggregates on the keys of tables with as many buckets need no
    exchange.  Rows that are hashed by the keys already are written as they lie."""
    spark = df.sparkSession
    path, name = new_folder(spark), f"floeberg_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._written, out._table = path, name
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete cut tables that a loop has passed and nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_written", None)):
            if name := getattr(df, "_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], iterations: int, done: Callable[[DataFrame, DataFrame, int], bool] | None = None) -> DataFrame:
    """Apply ``step`` up to ``iterations`` times, cutting lineage every time."""
    state = cut(state)
    for k in range(iterations):
        new = cut(step(state, k))
        if done is not None and done(state, new, k):
            return new
        discard(state)
        state = new
    return state
