"""Coordinate-form matrices mat(i, j, v) and vectors vec(i, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.quire import exact_dots
from ..plans.iterate import cut


def spmv(mat: DataFrame, vec: DataFrame) -> DataFrame:
    """y = A x; partial sums run before the shuffle on i."""
    return mat.join(vec.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def spmv_transpose(mat: DataFrame, vec: DataFrame) -> DataFrame:
    return mat.join(vec, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def histogram(df: DataFrame, index: str, bins: DataFrame | None = None) -> DataFrame:
    """(bin, cnt); with ``bins`` (bin) also those that have no row."""
    counts = df.groupBy(F.col(index).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts if bins is None else bins.select("bin").join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B.  The products that make an entry meet in one task: entries are exchanged, never products, of which there are many more."""
    from . import tiles as T

    return T.product(a, b)


def gram(a: DataFrame) -> DataFrame:
    """A A'.  The transposed side is not exchanged: an entry goes to its inner index once, and of two mirrored parts of the result one is made."""
    from . import tiles as T

    return T.gram(a)


def block_multiply(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The same by square tiles of a given size."""
    from . import tiles as T

    return T.product(a, b, size)


def block_gram(a: DataFrame, size: int) -> DataFrame:
    """A A' by square tiles, made once for both sides."""
    from . import tiles as T

    return T.gram(a, size)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


#: Entries whose sums one task holds.
HELD = 2_000_000


def spread(entries: DataFrame, rows: int, most: int = HELD) -> DataFrame:
    """Entries (i, j, v) dealt by their place over so many tasks that each gets about ``most`` of ``rows``; as they are where there are tasks enough."""
    parts = -(-rows // most)
    return entries.repartition(parts, "i", "j") if parts > int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")) else entries


def add(a: DataFrame, b: DataFrame, rows: int = 0) -> DataFrame:
    """A + B; with ``rows``, how many entries both have at most, no task holds more than HELD sums or so."""
    both = spread(a.select("i", "j", "v").unionByName(b.select("i", "j", "v")), rows)
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * F.lit(by))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", F.col("v").alias("d"))


def scale_rows(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d, "i").select("i", "j", (F.col("v") * F.col("d")).alias("v"))


def scale_columns(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d.select(F.col("i").alias("j"), "d"), "j").select("i", "j", (F.col("v") * F.col("d")).alias("v"))


def rectangle(a: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Rows i0..i1 and columns j0..j1, both inclusive, renumbered from 0."""
    return a.where(F.col("i").between(i0, i1) & F.col("j").between(j0, j1)).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")


def triangle(a: DataFrame, lower: bool = True, strict: bool = False) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    return a.where((i > j if strict else i >= j) if lower else (i < j if strict else i <= j))


def inner_product(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("x").alias("_y")), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("_y")), F.lit(0.0)).alias("dot"))


def combination(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    both = x.select("i", (F.col("x") * a).alias("x")).unionByName(y.select("i", (F.col("x") * b).alias("x")))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


def vector_norms(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("two"), F.sum(F.abs("x")).alias("one"), F.max(F.abs("x")).alias("inf"))


def matrix_norms(a: DataFrame) -> DataFrame:
    """Frobenius and infinity (largest absolute row sum), in one pass over rows."""
    rows = a.groupBy("i").agg(F.sum(F.abs("v")).alias("r"), F.sum(F.col("v") ** 2).alias("s"))
    return rows.agg(F.sqrt(F.sum("s")).alias("frobenius"), F.max("r").alias("infinity"))


def asymmetric_entries(a: DataFrame) -> DataFrame:
    """One row: how many entries differ from their mirror image."""
    left, right = a.alias("a"), transpose(a).alias("b")
    on = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return left.join(right, on, "full").where(F.coalesce("a.v", F.lit(0.0)) != F.coalesce("b.v", F.lit(0.0))).agg(F.count(F.lit(1)).alias("n"))


def shape_flags(a: DataFrame) -> DataFrame:
    is_ = lambda c: F.coalesce(F.max(F.when(c, 1).otherwise(0)), F.lit(0)) == 0
    return a.where("v <> 0").agg(is_(F.col("i") > F.col("j")).alias("upper"), is_(F.col("i") < F.col("j")).alias("lower"))


def extreme_entries(a: DataFrame) -> DataFrame:
    """Entries of least and greatest magnitude, with their sign."""
    return a.agg(F.min_by("v", F.struct(F.abs("v"), "v")).alias("least"), F.max_by("v", F.struct(F.abs("v"), "v")).alias("greatest"))


def row_starts(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, start, nnz) for every i of rows: offsets of compressed rows.

    A prefix sum in two steps: inside blocks of 65,536 rows, and over the blocks."""
    counts = rows.select("i").join(a.groupBy("i").agg(F.count(F.lit(1)).alias("nnz")), "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"), F.floor(F.col("i") / 65_536).alias("_b"))
    inside = Window.partitionBy("_b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    per = counts.groupBy("_b").agg(F.sum("nnz").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return counts.withColumn("_in", F.coalesce(F.sum("nnz").over(inside), F.lit(0))).join(per.select("_b", "_base"), "_b").select("i", (F.col("_base") + F.col("_in")).alias("start"), "nnz")


def laplace_5pt(spark: SparkSession, n: int, part: str = "full") -> DataFrame:
    """Five-point stencil on an n x n grid: 4 on the diagonal, -1 beside."""
    k = F.col("id")
    x, y = k % n, F.floor(k / n)
    cell = lambda j, v, ok: F.when(ok, F.struct(j.cast("long").alias("j"), F.lit(v).alias("v")))
    near = F.array(cell(k, 4.0, F.lit(True)), cell(k - 1, -1.0, x > 0), cell(k + 1, -1.0, x < n - 1), cell(k - n, -1.0, y > 0), cell(k + n, -1.0, y < n - 1))
    out = spark.range(n * n).select(k.alias("i"), F.explode(F.filter(near, lambda e: e.isNotNull())).alias("e")).select("i", "e.j", "e.v")
    return {"full": lambda d: d, "lower": lambda d: d.where("i >= j"), "upper": lambda d: d.where("i <= j")}[part](out)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_matrix(spark: SparkSession, n: int, most: int, part: str = "full", seed: int = 0) -> DataFrame:
    """1 to ``most`` off-diagonal draws a row in (0, 1/most), and a diagonal in (0, 1)."""
    rows = spark.range(n).select(F.col("id").alias("i"))
    draws = rows.select("i", F.explode(F.sequence(F.lit(1), (1 + F.floor(uniform(F.col("i"), seed=seed) * most)).cast("int"))).alias("k"))
    off = draws.select("i", F.floor(uniform(F.col("i"), F.col("k"), seed=seed + 1) * n).cast("long").alias("j"), (uniform(F.col("i"), F.col("k"), seed=seed + 2) / most).alias("v")).where("i <> j")
    off = off.groupBy("i", "j").agg(F.min("v").alias("v"))
    out = off.unionByName(rows.select("i", F.col("i").alias("j"), uniform(F.col("i"), seed=seed + 3).alias("v")))
    return out.where("i >= j") if part == "lower" else out.where("i <= j") if part == "upper" else out


def random_rows(spark: SparkSession, n: int, per_row: int, seed: int = 0) -> DataFrame:
    """Exactly ``per_row`` entries in each row, in different columns, normally distributed.

    The columns are an arithmetic progression with a random start and an odd step
    modulo a power of two, those beyond n skipped: no draw has to be repeated."""
    size = 1 << max((n - 1).bit_length(), 0)
    start, step = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(size)).bitwiseOR(F.lit(1))
    walk = F.transform(F.sequence(F.lit(0), F.lit(2 * per_row + 62)), lambda k: F.pmod(F.col("start") + k * F.col("step"), F.lit(size)))
    columns = F.slice(F.filter(F.array_distinct(walk), lambda j: j < n), 1, min(per_row, n))
    full = F.slice(F.array_distinct(F.concat(columns, F.sequence(F.lit(0).cast("long"), F.lit(min(per_row, n) - 1).cast("long")))), 1, min(per_row, n))
    rows = spark.range(n).withColumn("start", start).withColumn("step", step).select(F.col("id").alias("i"), F.explode(full).alias("j"))
    u, v = uniform(F.col("i"), F.col("j"), seed=seed + 2), uniform(F.col("i"), F.col("j"), seed=seed + 3)
    return rows.withColumn("v", F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v))


def spmv_exact(mat: DataFrame, vec: DataFrame) -> DataFrame:
    """y = A x with every row's products summed exactly and rounded once."""
    both = mat.join(vec.select(F.col("i").alias("j"), "x"), "j").select("i", "v", "x")
    return exact_dots(both, ["i"], "v", "x", "y")


def without(a: DataFrame, row: int, column: int) -> DataFrame:
    """The cofactor's sub-matrix: one row and one column left out, the rest renumbered."""
    close = lambda c, at: (F.col(c) - (F.col(c) > at).cast("long")).alias(c)
    return a.where((F.col("i") != row) & (F.col("j") != column)).select(close("i", row), close("j", column), "v")


def dependency_profile(a: DataFrame, lower: bool = True) -> DataFrame:
    """(i, back, forward): rows that i depends on, and rows that depend on i."""
    deps = triangle(a, lower, strict=True).where("v <> 0").select("i", "j").distinct()
    ends = deps.select("i", F.lit(1).alias("b"), F.lit(0).alias("f")).unionByName(deps.select(F.col("j").alias("i"), F.lit(0).alias("b"), F.lit(1).alias("f")))
    own = a.select("i", F.lit(0).alias("b"), F.lit(0).alias("f")).distinct()
    return ends.unionByName(own).groupBy("i").agg(F.sum("b").alias("back"), F.sum("f").alias("forward"))


def parallelism(levels: DataFrame) -> DataFrame:
    """One row: the number of levels and the size of the largest."""
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("levels"), F.max("n").alias("widest"))


def level_sets(a: DataFrame, lower: bool = True) -> DataFrame:
    """(i, level): 1 + the largest level among the rows that a row depends on.

    Peels all rows without open dependencies at once; one job per level."""
    deps = cut(triangle(a, lower, strict=True).select("i", "j").distinct())
    left, done, level = a.select("i").distinct(), None, 0
    while True:
        blocked = deps.join(left.select(F.col("i").alias("j")), "j", "left_semi").select("i", F.lit(True).alias("_blocked")).distinct()
        both = cut(left.join(blocked, "i", "left"))
        free = both.where("_blocked is null").select("i", F.lit(level).alias("level"))
        done = free if done is None else done.unionByName(free)
        left = both.where("_blocked").select("i")
        if not left.limit(1).count():
            return done
        if not free.limit(1).count():
            raise ValueError("the dependencies have a cycle")
        level += 1


def level_stats(levels: DataFrame) -> DataFrame:
    """(level, size, start); levels are few, so one task orders them."""
    sizes = levels.groupBy("level").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("start", F.sum("size").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))


def block_pattern(a: DataFrame, size: int) -> DataFrame:
    return a.where("v <> 0").select(F.floor(F.col("i") / size).alias("i"), F.floor(F.col("j") / size).alias("j")).distinct().withColumn("v", F.lit(1.0))


def dependency_counts(a: DataFrame) -> DataFrame:
    return triangle(a, strict=True).groupBy("i").agg(F.count(F.lit(1)).alias("in_degree"))


def equilibrate(a: DataFrame, factor: float = 1.0) -> DataFrame:
    """Rows, then columns, divided by their largest magnitude; times ``factor``."""
    top = a.groupBy("i").agg((F.lit(1.0) / F.max(F.abs("v"))).alias("d"))
    rows = scale_rows(a, top)
    side = rows.groupBy("j").agg((F.lit(factor) / F.max(F.abs("v"))).alias("d")).select(F.col("j").alias("i"), "d")
    return scale_columns(rows, side)


def equilibrate_symmetric(a: DataFrame, steps: int = 5, one_norm: bool = False) -> DataFrame:
    """Both sides by the root of the row norms, ``steps`` times: keeps symmetry."""
    for _ in range(steps):
        norm = F.sum(F.abs("v")) if one_norm else F.max(F.abs("v"))
        d = a.groupBy("i").agg((1.0 / F.sqrt(norm)).alias("d"))
        a = cut(scale_columns(scale_rows(a, d), d))
    return a


def nearest_power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.round(F.log2(F.abs(x))))


def scale_by_diagonal(a: DataFrame, how: str = "max") -> DataFrame:
    """The whole matrix divided by a power of two near its diagonal's max, mean or
    geometric mean, or near the entries' geometric mean or the infinity norm."""
    diag = a.where("i = j")
    value = {
        "max": lambda: diag.agg(F.max(F.abs("v"))), "mean": lambda: diag.agg(F.avg(F.abs("v"))), "geometric": lambda: diag.where("v <> 0").agg(F.exp(F.avg(F.ln(F.abs("v"))))),
        "entries": lambda: a.where("v <> 0").agg(F.exp(F.avg(F.ln(F.abs("v"))))), "norm": lambda: matrix_norms(a).select("infinity"),
    }[how]().toDF("s").select(nearest_power_of_two(F.col("s")).alias("s"))
    return a.crossJoin(F.broadcast(value)).select("i", "j", (F.col("v") / F.col("s")).alias("v"))


def round_robin(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, part, local) of the round-robin layout of 0-based keys."""
    return df.select(F.col(key).alias("key"), F.pmod(F.col(key), F.lit(parts)).alias("part"), F.floor(F.col(key) / parts).alias("local"))


def mean_squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.alias("a"), b.alias("b")
    on = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return left.join(right, on, "full").agg(F.avg((F.coalesce("a.v", F.lit(0.0)) - F.coalesce("b.v", F.lit(0.0))) ** 2).alias("mse"))
