"""Row-array storage of matrices and adjacency: one row of arrays for each matrix row.

rows(i, part, js, vs): the columns of row i in ascending order and their values.  A
row with more than ``most`` entries is cut into parts by ranges of its columns, so no
record outgrows a task.  A product joins one record a row instead of one an entry:
transposed products on the rows, products on the rows of the transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.iterate import cut_seen
from .sparse import transpose

#: Entries of one record.
MOST = 1 << 16


def to_rows(a: DataFrame, most: int = MOST) -> DataFrame:
    """Entries (i, j, v) as rows of arrays; an entry that repeats is kept as often."""
    sizes, seen = cut_seen(a.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("least"), F.max("j").alias("greatest")), most=F.max("n"))
    if seen["most"] <= most:
        keyed = a.select("i", F.lit(0).alias("part"), "j", "v")
    else:  # hubs: so many columns of about equal weight as there are parts
        hubs = sizes.where(F.col("n") > most).select("i", F.ceil(2 * F.col("n") / most).cast("int").alias("parts"))
        bounds = a.join(F.broadcast(hubs.select("i")), "i", "left_semi").groupBy("i").agg(F.percentile_approx("j", F.array(*(F.lit(k / 1000) for k in range(1, 1000))), 10_000).alias("at"))
        # With p parts the cuts are every 1000/p-th of a thousand quantiles.
        cuts = bounds.join(hubs, "i").select("i", F.transform(F.sequence(F.lit(1), F.least(F.col("parts"), F.lit(999)) - 1), lambda k: F.element_at("at", F.greatest(F.floor(k * 999 / F.least(F.col("parts"), F.lit(999))).cast("int"), F.lit(1)))).alias("cuts"))
        keyed = a.join(F.broadcast(cuts), "i", "left").select("i", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("j"))), F.lit(0)).alias("part"), "j", "v")
    packed = keyed.groupBy("i", "part").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return packed.select("i", "part", F.col("e.j").alias("js"), F.col("e.v").alias("vs"))


def to_entries(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.inline(F.arrays_zip(F.col("js").alias("j"), F.col("vs").alias("v"))))


def times_transposed(rows: DataFrame, x: DataFrame) -> DataFrame:
    """y = A' x: each record meets its row's x once; partial sums run before the shuffle on the columns."""
    met = rows.join(x.select("i", "x"), "i")
    products = met.select(F.inline(F.transform(F.arrays_zip("js", "vs"), lambda e: F.struct(e["js"].alias("i"), (e["vs"] * F.col("x")).alias("y")))))
    return products.groupBy("i").agg(F.sum("y").alias("y"))


def times(columns: DataFrame, x: DataFrame) -> DataFrame:
    """y = A x from ``columns``, the rows of the transpose."""
    return times_transposed(columns, x)


def columns_of(a: DataFrame, most: int = MOST) -> DataFrame:
    return to_rows(transpose(a), most)


def row_sums(rows: DataFrame) -> DataFrame:
    """(i, nnz, total, largest): within the arrays first, then over a row's parts."""
    own = rows.select("i", F.size("js").alias("n"), F.aggregate("vs", F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate("vs", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v))).alias("m"))
    return own.groupBy("i").agg(F.sum("n").alias("nnz"), F.sum("s").alias("total"), F.max("m").alias("largest"))


def offsets(rows: DataFrame) -> DataFrame:
    """(i, part, start, nnz): where each record's entries begin among all, rows ascending, parts in order.

    Prefix sums in two steps: inside blocks of 65,536 rows, and over the blocks."""
    own = rows.select("i", "part", F.size("js").cast("long").alias("nnz"), F.floor(F.col("i") / 65_536).alias("_b"))
    inside = Window.partitionBy("_b").orderBy("i", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    base = own.groupBy("_b").agg(F.sum("nnz").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    return own.withColumn("_in", F.coalesce(F.sum("nnz").over(inside), F.lit(0))).join(base, "_b").select("i", "part", (F.col("_base") + F.col("_in")).alias("start"), "nnz")


def compressed(rows: DataFrame) -> DataFrame:
    """(at, i, j, v): the compressed arrays, entry by entry, with their positions."""
    at = offsets(rows).select("i", "part", "start")
    return rows.join(at, ["i", "part"]).select("i", "start", F.posexplode(F.arrays_zip("js", "vs"))).select((F.col("start") + F.col("pos")).alias("at"), "i", F.col("col.js").alias("j"), F.col("col.vs").alias("v"))


def dealt(rows: DataFrame, owner: DataFrame) -> DataFrame:
    """(part, local, i, nnz, inside): rows in the parts that ``owner`` (i, part, local) gives them, and how many of their columns lie in the same part."""
    to = owner.select(F.col("i").alias("j"), F.col("part").alias("_to"))
    own = rows.select("i", "js").join(owner, "i")
    met = own.select("i", "part", "local", F.explode("js").alias("j")).join(to, "j", "left")
    return met.groupBy("part", "local", "i").agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("part") == F.col("_to")).alias("inside"))
