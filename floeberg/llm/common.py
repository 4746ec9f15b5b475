"""Shared pieces of the training-data operators: working folders, byte-level
text access for Arrow batches, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that one numpy step works on; bounds a worker's memory.
SLICE_BYTES = 1 << 18
#: A lookup side is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20
#: Bytes that a value of these types is counted with.
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "string": 150, "binary": 150}

WHITE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session has none (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="floeberg-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # for discard()
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_written", None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def _width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return 32 * _width(kind.elementType)
    return _WIDTH.get(kind.simpleString(), 8)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast behind a check of rows and bytes; beyond it the join shuffles."""
    small = rows <= limit and rows * _width(df.schema) <= BROADCAST_BYTES
    return F.broadcast(df) if small else df.hint("merge")


def lookup(df: DataFrame, table: DataFrame, key: str, size: str, rows: int, how: str = "left") -> DataFrame:
    """Join df to table (one row per key, ``size`` = rows of df with the key).

    Keys with more than a thousandth of the rows are at most 1000, so their
    part of the table is broadcast; their rows take no part in the shuffle
    join, since their shuffle key is made unique."""
    cols = [c for c in table.columns if c != key]
    hot_at = max(1000, rows // 1000)
    hot = table.where(F.col(size) > hot_at).select(F.col(key), F.struct(*cols).alias("_hot"))
    cold = table.where(F.col(size) <= hot_at).select(F.col(key).cast("string").alias("_key"), F.struct(*cols).alias("_cold"))
    out = df.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")))
    out = out.withColumn("_key", spread).join(cold, "_key", "left")
    if how == "inner":
        out = out.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    return out.select(*df.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in cols))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Hold Arrow batches of long texts to a few MB.

    The setting is read when a plan runs, so it is left set in the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
    if now is None or not 0 < int(now[1]) <= most:
        spark.conf.set(key, str(most))


# ---------------------------------------------------------------- byte access


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, most_rows: int = 1 << 14):
    """Row ranges (lo, hi) of about ``most`` bytes; one longer text goes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + most_rows)
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        made = []
        for base in (_MULT, _INV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            made.append(np.cumprod(t))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of letters and digits; all bytes of other scripts count as letters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-white bytes (or of bytes ``inside``);
    runs end with their text."""
    n = len(data)
    solid = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~nxt | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from prefix sums of a polynomial modulo 2^64."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def merge_counts(first: tuple[np.ndarray, np.ndarray], more: list) -> tuple[np.ndarray, np.ndarray]:
    """Sum of tables of (sorted keys, counts)."""
    if not more:
        return first
    keys, at = np.unique(np.concatenate([first[0], *(m[0] for m in more)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([first[1], *(m[1] for m in more)]), len(keys)).astype(np.int64)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id's text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def with_locator(docs: DataFrame) -> DataFrame:
    """docs with _loc: file and row of each record, or where the rows don't
    come straight from files, a number that repeats for an unchanged plan."""
    from pyspark.errors import AnalysisException

    try:
        out = docs.withColumn("_loc", F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string")))
        out.schema  # noqa: B018  resolves the columns
        return out
    except AnalysisException:
        return docs.withColumn("_loc", F.monotonically_increasing_id().cast("string"))


def from_files(docs: DataFrame) -> bool:
    """Whether rows come straight from files, so that with_locator names them for good."""
    from pyspark.errors import AnalysisException

    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it until no column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose _loc is in ``dropped``; a column _loc of docs stays."""
    gone = dropped.select("_loc")
    own = free_name("_loc", docs.columns)
    held = docs.withColumnRenamed("_loc", own)
    kept = with_locator(held).join(maybe_broadcast(gone, gone.count()), "_loc", "left_anti").drop("_loc")
    return kept.withColumnRenamed(own, next((c for c in docs.columns if c.lower() == "_loc"), own)).select(*(f"`{c}`" for c in docs.columns))
