"""Exact deduplication with stateful streaming.

Records (digest of the normalised text, stable id, content locator, length)
stream into an aggregation whose state lives in RocksDB, keyed by digest and
never expiring: for each digest it retains the best record seen and the count.
Only what a batch changed is written.  Groups with hits are then checked on full
bytes: where texts with one digest differ, they are grouped again by digest and
text.  A group's rows are summed before any shuffle, and groups with many rows
are joined by broadcast (at most 1000), so a hot group lands on no single task.

With a ``state_path`` a later run continues where the last one stopped and streams
only its own records.  The state folder then holds every run's records with
their normalised texts, so a hit on an earlier run's record is checked on full
bytes too.  A run returns its own rows; keep_id may name a row of an earlier
run, and a longer original in a later run supersedes what an earlier one kept.  A
run that is repeated under its name is not counted twice.

Cases: null counts as empty, so null and empty texts are equal; ties go to the
smallest doc_id, null ids last, then to the first locator; of repeated rows one
is kept; an empty table gives no rows.  Only DataFrame operations are used."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .common import lookup, materialize, maybe_broadcast, new_path, with_locator, without_rows

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.metricsEnabled": "false",
}


def normalised(text: str = "text") -> Column:
    """The text without spaces and the controls 9 to 13."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best() -> Column:
    """The longest original text, then the smallest id, then the first locator."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_loc"))


#: Records for one state partition.  The number of state partitions is fixed for
#: a state's life, so it follows the corpus and not the session's shuffle setting.
STATE_ROWS = 500_000


def stream_state(records_path: str, schema, state_path: str, spark, rows: int) -> DataFrame:
    """Run the stream over all records not yet seen; the state's rows.

    (digest, best, group_size), as of the last finished batch.  Each batch leaves
    the rows that it changed; a group's latest row is its largest."""
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
    conf = _STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(parts)}
    old = {k: spark.conf.get(k, None) for k in conf}

    def snapshot(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state_path}/snapshots/{number}")

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).parquet(records_path)
        state = stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).foreachBatch(snapshot).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    empty = spark.createDataFrame([], schema).groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    try:
        found = spark.read.schema(empty.withColumn("batch", F.lit(0).cast("long")).schema).parquet(f"{state_path}/snapshots/*")
    except AnalysisException:  # no batch has run
        return empty
    if found.agg(F.min("batch") == F.max("batch")).first()[0] is False:
        found = found.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "group_size").alias("s")).select("digest", "s.*")
    return found.select("digest", "best", "group_size")


def _keep_records(located: DataFrame, digest, path: str, run: str | None) -> DataFrame:
    """This run's records, written; with a run name also their normalised texts."""
    spark, full = located.sparkSession, normalised()
    cols = ["doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(full).alias("digest")]
    cols += [] if digest is sha256 else [sha256(full).alias("sha")]
    if run is None:
        located.select(*cols, "_loc").write.parquet(path)
        return spark.read.parquet(path)
    kept = located.select(*cols, F.concat(F.lit(f"{run}/"), "_loc").alias("_loc"), F.col("_loc").alias("_own"), full.alias("full"), F.lit(run).alias("run"))
    try:
        done = spark.read.schema(kept.schema).parquet(path).where(F.col("run") == run).limit(1).count()
    except AnalysisException:  # the first run
        done = 0
    if not done:
        kept.write.mode("append").parquet(path)
    return spark.read.schema(kept.schema).parquet(path)


def exact_duplicates(docs: DataFrame, digest=sha256, state_path: str | None = None, run: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and _loc of every row.

    ``state_path``: the folder in which runs continue each other; ``run`` names this
    one (a new name if not given)."""
    spark = docs.sparkSession
    located = with_locator(docs).select("doc_id", "_loc", "text")
    lasting = state_path is not None
    run = (run or uuid.uuid4().hex) if lasting else None
    path = f"{state_path}/records" if lasting else new_path(spark, "dedup-records")
    every = _keep_records(located, digest, path, run)
    records = every.where(F.col("run") == run) if lasting else every
    rows = records.count()
    schema = every.select("doc_id", "_loc", "n_chars", "digest").schema
    state = stream_state(path, schema, state_path or new_path(spark, "dedup-state"), spark, rows)
    if lasting:
        state = state.join(records.select("digest").distinct(), "digest", "left_semi")
    # Full bytes of every group with a hit: the least and the greatest text must be one.
    hits = state.where("group_size > 1").select("digest")
    n_hits = hits.count()
    full = F.col("full") if lasting else normalised()
    source = every if lasting else located
    texts = source.select(full.alias("full"), ("digest" if lasting else digest(full).alias("digest"))).join(maybe_broadcast(hits, n_hits), "digest", "left_semi")
    differ = materialize(texts.groupBy("digest").agg(F.min("full").alias("low"), F.max("full").alias("high")).where("low <> high").select("digest"), "dedup-differ") if n_hits else None
    found = state.select("digest", "best", "group_size")
    own = F.col("_own" if lasting else "_loc").alias("_at")
    sure = records
    split = None
    if differ is not None and (n_differ := differ.count()):
        sure = records.join(maybe_broadcast(differ, n_differ), "digest", "left_anti")
        if lasting:
            again = every.withColumn("sha", sha256(F.col("full")))
        else:
            again = located.select("doc_id", "_loc", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(full).alias("digest"), sha256(full).alias("sha"), full.alias("full"))
        again = again.join(maybe_broadcast(differ, n_differ), "digest", "left_semi")
        groups = again.groupBy("digest", "full").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
        mine = again.where(F.col("run") == run) if lasting else again
        split = mine.join(groups, ["digest", "full"]).select("doc_id", "_loc", own, "sha", "best", "group_size")
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    sure = lookup(sure.drop("full", "run"), found, "digest", "group_size", rows).select("doc_id", "_loc", own, sha.alias("sha"), "best", "group_size")
    out = sure if split is None else sure.unionByName(split)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("_loc") == F.col("best._loc")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("_at").alias("_loc"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    return without_rows(docs, materialize(exact_duplicates(docs).where(~F.col("kept")).select("_loc"), "dedup-dropped"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_loc")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n
  FROM documents),
r AS (
  SELECT doc_id, n, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM r
"""
