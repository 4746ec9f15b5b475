"""Graph files as DataFrames.

Lines are numbered inside each file by the text reader's row order, and
parsing is column work; only a file's few header lines reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.graph import combine_edges, renumber, undirected_first_seen


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with line numbers from 0 over the files in name order.

    Numbers inside a split come from the reader's order, split offsets from counts."""
    at = F.monotonically_increasing_id()
    rows = spark.read.text(path).select("value", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_in"))
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(starts.select("_part", "_start")), "_part").select((F.col("_start") + F.col("_in")).alias("line"), "value")


def _fields(c: str = "value"):
    return F.split(F.trim(F.col(c)), r"\s+")


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, name, node_weight) and edges(src, dst, w); ids as in the file, from 1.

    Default weight 1; node weights that aren't positive become 1; duplicates are summed."""
    lines = numbered_lines(spark, path)
    heads = lines.where(F.lower("value").startswith("*")).select("line", F.lower("value")).orderBy("line").limit(64).collect()
    arcs = next((r[0] for r in heads if r[1].startswith(("*arcs", "*edges"))), 1 << 62)
    body = lines.where(~F.col("value").startswith("*") & (F.trim("value") != ""))
    quoted = F.regexp_extract("value", r'^\s*(\d+)\s+"([^"]*)"\s*(\S*)', 3)
    weight = F.coalesce(F.expr("try_cast(w0 as double)"), F.lit(1.0))
    nodes = body.where(F.col("line") < arcs).select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("id"), F.regexp_extract("value", r'"([^"]*)"', 1).alias("name"), quoted.alias("w0"))
    nodes = nodes.withColumn("node_weight", F.when(weight > 0, weight).otherwise(1.0)).drop("w0")
    f = _fields()
    raw = body.where(F.col("line") > arcs).select(F.get(f, F.lit(0)).cast("long").alias("src"), F.get(f, F.lit(1)).cast("long").alias("dst"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    return nodes, combine_edges(raw)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """edges of a CSR text file: a header ``n m``, then a line of 0-based neighbours per
    vertex; of the two directions of a pair the first seen stays."""
    rows = numbered_lines(spark, path).where("line > 0 and trim(value) <> ''")
    pairs = rows.select("line", F.posexplode(_fields())).select((F.col("line") * (1 << 24) + F.col("pos")).alias("line"), (F.col("line") - 1).alias("src"), F.col("col").cast("long").alias("dst"))
    return undirected_first_seen(pairs)


def read_link_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges with ids 0..n-1 in ascending order of the old ones, (old_id, new_id))."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    f = _fields()
    raw = combine_edges(lines.select(F.get(f, F.lit(0)).cast("long").alias("src"), F.get(f, F.lit(1)).cast("long").alias("dst"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("w")))
    names = renumber(raw.select(F.col("src").alias("id")).union(raw.select("dst")), "id")
    a, b = names.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), names.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return raw.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), names


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    f = _fields()
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(f, F.lit(0)).cast("long").alias("id"), F.get(f, F.lit(1)).cast("int").alias("rank"))


def read_dependency_csv(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Boolean lower-triangular matrix of an ``i,j`` file, with a unit diagonal."""
    own = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"))
    rows = spark.read.schema("i long, j long").csv(path).where("i > j")
    return rows.union(own).distinct().withColumn("v", F.lit(1.0))


def longest_line(spark: SparkSession, path: str) -> DataFrame:
    """The line with the most comma-separated fields."""
    size = F.size(F.split("value", ","))
    return spark.read.text(path).agg(F.max_by("value", F.struct(size, "value")).alias("value"), F.max(size).alias("fields"))


def write_tree(ranked: DataFrame, length: float, path: str, names: DataFrame | None = None) -> None:
    """Two-level ``.tree`` files: a header line, then ``module:rank rate "name"``.

    ranked is (mod, rank, id, p); part files sort after the header by module."""
    label = ranked.withColumn("name", F.col("id").cast("string")) if names is None else ranked.join(names.select("id", "name"), "id")
    n = ranked.select("mod").distinct().count()
    spark = ranked.sparkSession
    body = label.orderBy("mod", "rank").select(F.concat(F.col("mod").cast("string"), F.lit(":"), F.col("rank").cast("string"), F.lit(" "), F.col("p").cast("string"), F.lit(' "'), F.col("name"), F.lit('"')).alias("value"))
    spark.createDataFrame([(f"# Code length {length} in {n} modules.",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    body.write.mode("overwrite").text(f"{path}/nodes")


def write_clusters(partition: DataFrame, path: str) -> None:
    """Pajek ``.clu``: the module number of each node from 1, in id order, CRLF ends."""
    n = partition.count()
    spark = partition.sparkSession
    spark.createDataFrame([(f"*Vertices {n}",)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    partition.orderBy("id").select((F.col("mod") + 1).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/nodes")
