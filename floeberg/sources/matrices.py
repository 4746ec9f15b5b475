"""Matrix files: Matrix Market, binary triplets and text triplets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_OBJECTS, _FORMATS = ("matrix",), ("coordinate", "array")
_FIELDS, _SYMMETRIES = ("real", "integer", "complex", "pattern"), ("general", "symmetric", "skew-symmetric", "hermitian")


def parse_banner(line: str) -> dict[str, str]:
    """Object, format, field and symmetry of the first line; ValueError if they don't go together."""
    parts = line.strip().split()
    if len(parts) != 5 or parts[0] != "%%MatrixMarket":
        raise ValueError("no Matrix Market banner")
    out = dict(zip(("object", "format", "field", "symmetry"), (p.lower() for p in parts[1:]), strict=True))
    for key, allowed in (("object", _OBJECTS), ("format", _FORMATS), ("field", _FIELDS), ("symmetry", _SYMMETRIES)):
        if out[key] not in allowed:
            raise ValueError(f"unknown {key}: {out[key]}")
    if not valid(out):
        raise ValueError(f"not a valid type: {type_name(out)}")
    return out


def valid(kind: dict[str, str]) -> bool:
    if kind["format"] == "array" and kind["field"] == "pattern":
        return False
    if kind["field"] == "real" and kind["symmetry"] == "hermitian":
        return False
    return not (kind["field"] == "pattern" and kind["symmetry"] in ("hermitian", "skew-symmetric"))


def type_name(kind: dict[str, str]) -> str:
    return " ".join(kind[k] for k in ("object", "format", "field", "symmetry"))


def read_header(spark: SparkSession, path: str) -> tuple[dict[str, str], list[int]]:
    """The banner and the size line: the only lines that reach the driver."""
    lines = spark.read.text(path)
    banner = parse_banner(lines.first()[0])
    size = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()[0]
    return banner, [int(x) for x in size.split()]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the data lines: the lines after the size line, in file order from 0.

    Byte order within a file is kept by counting lines per partition."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.trim("value").alias("value"), "_at")
    part = F.shiftright("_at", 33)
    total, starts = 0, []
    for p, n in sorted((x[0], x[1]) for x in lines.groupBy(part.alias("p")).count().collect()):  # one row per partition
        starts.append((p, total))
        total += n
    table = spark.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_at"))
    return lines.withColumn("_p", part).withColumn("_n", rank).join(F.broadcast(table), "_p").select((F.col("_start") + F.col("_n") - 2).alias("line"), "value").where("line >= 0")


def read_matrix_market(spark: SparkSession, path: str, pattern_ok: bool = False, expand: bool = True, kind: str = "double") -> DataFrame:
    """mat(i, j, v) of a coordinate or array file, 1-based; the mirrored half is added.

    ``kind``: double, float, or a decimal type or string, for values of more digits
    than a double has.  Pattern matrices are rejected unless ``pattern_ok``; complex
    ones always.  An array file lists columns; a symmetric one their lower parts."""
    banner, size = read_header(spark, path)
    if banner["field"] == "complex" or (banner["field"] == "pattern" and not pattern_ok):
        raise ValueError(f"values can't be loaded from: {type_name(banner)}")
    if banner["format"] == "array":
        mat = _read_array(spark, path, banner, size, kind)
    else:
        f = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
        # An entry can look like the size line: only its first appearance is left out.
        head = " ".join(str(x) for x in size)
        same = F.regexp_replace(F.trim("value"), r"\s+", " ") == head
        again = lines.where(same).count() - 1
        v = (F.lit(1.0) if banner["field"] == "pattern" else F.get(f, F.lit(2))).cast(kind)
        entries = lines.where(~same)
        if again > 0:
            entries = entries.unionByName(spark.createDataFrame([(head,)] * again, "value string"))
        mat = entries.select(F.get(f, F.lit(0)).cast("long").alias("i"), F.get(f, F.lit(1)).cast("long").alias("j"), v.alias("v"))
    if not expand or banner["symmetry"] == "general":
        return mat
    mirrored = (-F.col("v") if banner["symmetry"] == "skew-symmetric" else F.col("v")).cast(kind)
    return mat.unionByName(mat.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), mirrored.alias("v")))


def _read_array(spark: SparkSession, path: str, banner: dict[str, str], size: list[int], kind: str) -> DataFrame:
    """Entries by their place in the file: down the columns, or their lower parts."""
    rows, cols = size[0], size[1]
    at = _numbered(spark, path)
    v = F.col("value").cast(kind).alias("v")
    if banner["symmetry"] == "general":
        return at.select((F.col("line") % rows + 1).alias("i"), (F.floor(F.col("line") / rows) + 1).alias("j"), v)
    skip = 1 if banner["symmetry"] == "skew-symmetric" else 0
    starts, total = [], 0
    for j in range(cols):  # one number per column
        starts.append((j + 1, total, total + rows - j - skip))
        total += rows - j - skip
    table = F.broadcast(spark.createDataFrame(starts, "j long, _from long, _to long"))
    inside = (F.col("line") >= F.col("_from")) & (F.col("line") < F.col("_to"))
    return at.join(table, inside).select((F.col("line") - F.col("_from") + F.col("j") + skip).alias("i"), "j", v)


def directory_traffic(spark: SparkSession, folder: str, es: int = 2, width: int = 32) -> DataFrame:
    """(bits, share): regime bits of all values of a folder's matrices, averaged over the files.

    Symmetric entries count twice.  A file's size line is the first one after its comments."""
    from ..functions.posit import regime_traffic

    # A line's place in its file: where its block begins, and its number in the block's partition.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(f"{folder}/*.mtx").select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    banners = lines.where(F.col("value").startswith("%%MatrixMarket")).select("file", F.lower("value").alias("banner"))
    data = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    heads = data.groupBy("file").agg(F.min("place").alias("_head"))
    # One row per file on the other side; Spark broadcasts it while it is small.
    data = data.join(banners, "file").join(heads, "file").where(F.col("place") != F.col("_head"))
    f = F.split(F.trim("value"), r"\s+")
    v = F.element_at(f, -1).cast("double")
    times = F.when(F.col("banner").contains("symmetric"), 2).otherwise(1)
    per = data.where(~F.col("banner").contains("pattern") & ~F.col("banner").contains("complex")).select("file", regime_traffic(v, es, width).alias("bits"), times.alias("n")).where("bits is not null").groupBy("file", "bits").agg(F.sum("n").alias("n"))
    total = per.groupBy("file").agg(F.sum("n").alias("t"))
    files = total.count()
    return per.join(F.broadcast(total), "file").groupBy("bits").agg((F.sum(F.col("n") / F.col("t")) / F.lit(float(max(files, 1)))).alias("share"))


def write_matrix_market(mat: DataFrame, path: str, rows: int, cols: int) -> None:
    """A coordinate real general file in two parts: ``header`` and the sorted entries."""
    spark = mat.sparkSession
    head = [("%%MatrixMarket matrix coordinate real general",), (f"{rows} {cols} {mat.count()}",)]
    spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/a-header")
    entry_lines(mat).write.mode("overwrite").text(f"{path}/b-entries")


def entry_lines(mat: DataFrame, by_column: bool = False) -> DataFrame:
    """``i j value`` lines with 15 digits, by row or by column."""
    return mat.orderBy(*(("j", "i") if by_column else ("i", "j"))).select(F.format_string("%d %d %.15e", "i", "j", "v").alias("value"))


_TRIPLET = np.dtype([("i", "<i4"), ("j", "<i4"), ("v", "<f8")])


def read_binary_triplets(spark: SparkSession, path: str, part: str = "full") -> DataFrame:
    """mat(i, j, v) of 16-byte records (int32, int32, float64), 1-based.

    Record 0 holds rows and entries; stored zeros become 1; ``part``: full,
    lower or upper (strict).  Files are read whole, one task each."""

    def parse(frames):
        for frame in frames:
            for content in frame.content:
                rows = np.frombuffer(content, _TRIPLET)[1:]
                yield pd.DataFrame({"i": rows["i"].astype("int64"), "j": rows["j"].astype("int64"), "v": np.where(rows["v"] == 0, 1.0, rows["v"])})

    mat = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "i long, j long, v double")
    return {"full": lambda m: m, "lower": lambda m: m.where("i > j"), "upper": lambda m: m.where("i < j")}[part](mat)


def read_text_triplets(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(f, F.lit(0)).cast("long").alias("i"), F.get(f, F.lit(1)).cast("long").alias("j"), F.get(f, F.lit(2)).cast("double").alias("v"))


def pack_triplets(rows: list[tuple[int, int, float]], n: int) -> bytes:
    """The binary form of a small matrix, header record first."""
    return np.array([(n, len(rows), 0.0), *rows], _TRIPLET).tobytes()


def graphviz(levels: DataFrame, deps: DataFrame) -> DataFrame:
    """Lines of a digraph of dependencies, nodes coloured by level."""
    nodes = levels.select(F.format_string('  %d [colorscheme="set312", color=%d];', "i", F.pmod("level", F.lit(12)) + 1).alias("value"))
    return nodes.unionByName(deps.select(F.format_string("  %d -> %d;", "j", "i").alias("value")))
