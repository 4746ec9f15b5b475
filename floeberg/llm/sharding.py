"""Sharding by a Hilbert curve over quantised metadata.

Rows are ordered by the curve index of several metadata columns, and the order
is cut into runs whose row counts differ by at most one.  Neighbouring rows
share small ranges in every dimension at once, so a reader that filters on any
of them skips most shards by their min/max statistics.

Cases: null in a dimension takes the lowest cell; null text has size 1 and the
checksum of the empty text; repeated rows and ties keep distinct slots (order
among rows equal in every key is arbitrary); an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "n_chars")
BITS = 6


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (rows x dimensions, values < 2^bits).

    The transposed-axes form: undo the excess work of each level from the top
    bit down, Gray-encode across axes, then interleave the bits."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << one) | ((v >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _number(df: DataFrame, name: str) -> Column:
    """An order-preserving number for a column: itself, or a string's first 6 bytes."""
    if dict(df.dtypes)[name] in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(F.coalesce(F.col(name).cast("binary"), F.lit(b"")), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(name).cast("double")


def quantise(df: DataFrame, dimensions: tuple[str, ...], bits: int) -> list[Column]:
    """Cell of each dimension: how many of 2^bits - 1 quantiles lie below.

    The quantiles come from a mergeable sketch over all rows, so the driver
    gets (2^bits - 1) numbers per dimension whatever the size."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = df.agg(*(F.percentile_approx(_number(df, d), at, 10_000).alias(f"b{i}") for i, d in enumerate(dimensions))).first()
    cells = []
    for i, d in enumerate(dimensions):
        cuts = sorted(set(bounds[i] or []))
        cell = F.lit(0)
        for c in cuts:
            cell = cell + F.when(_number(df, d) >= F.lit(c), 1).otherwise(0)
        cells.append(F.coalesce(cell, F.lit(0)).cast("int"))
    return cells


def curve_index(cells: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def number(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_numbers(np.stack([c.to_numpy() for c in columns], 1), bits))

    return number(*cells)


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with size, text_crc32, curve, shard and gapless slot.

    Only ids, sizes and checksums are range-partitioned and written, never the
    texts.  Ranks follow from the row counts of the written partitions, so no
    task orders more than its own range."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(*keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), curve_index(quantise(docs, dimensions, bits), bits).alias("curve"))
    tie = [F.col("curve"), F.col("text_crc32"), *(F.col(k) for k in keep)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    at = F.monotonically_increasing_id()
    ordered = materialize(
        slim.repartitionByRange(parts, *tie).sortWithinPartitions(*tie).withColumns({"_part": F.shiftright(at, 33).cast("int"), "_in": at.bitwiseAND((1 << 33) - 1)}), "hilbert")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("_part").count().collect())  # one row per partition
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not total:
        return ordered.select(*keep, "size", "text_crc32", "curve", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    firsts = spark.createDataFrame(starts, "_part int, _start long")
    rank = F.col("_start") + F.col("_in")
    shard = F.expr(f"cast(((_start + _in) * {shards}L) div {total}L as int)")
    first_rank = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ordered.join(F.broadcast(firsts), "_part").withColumn("shard", shard).withColumn("slot", rank - first_rank).select(*keep, "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Write one run per shard in curve order (folder _shard=N, rows with _slot and
    _bytes beside their own columns); returns each run's ranges.

    The result has a row per shard with rows, bytes and the min and max of every
    dimension: what a reader needs to skip files."""
    marked = docs.withColumn("_row", F.monotonically_increasing_id())
    marked = materialize(marked, "hilbert-rows")
    placed = hilbert_shards(marked, shards, dimensions, bits, keep=("_row",)).select("_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("size").alias("_bytes"))
    out = marked.join(placed, "_row").drop("_row").repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_slot")
    out.write.partitionBy("_shard").parquet(path)
    ranges = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return docs.sparkSession.read.parquet(path).groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"), *ranges)


def op1_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
