"""Queries on row arrays and tiles of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows as R, sparse as M, tiles as T
from .iterate import cut
from .registry import _COUNTS, _QTY, query, r
from .tables import counts, entries, quantities, table


@query(f"WITH {_QTY} SELECT i, round(sum(v * p_retailprice), 2) + 0.0 AS y FROM q JOIN part ON j = p_partkey GROUP BY 1")
def array_spmv(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return R.times(R.columns_of(quantities(spark, sf)), x).select("i", r("y", 2).alias("y"))


@query(f"WITH {_QTY} SELECT j AS i, round(sum(v * s_acctbal), 2) + 0.0 AS y FROM q JOIN supplier ON i = s_suppkey GROUP BY 1")
def array_spmv_transpose(spark, sf):
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return R.times_transposed(R.to_rows(quantities(spark, sf)), x).select("i", r("y", 2).alias("y"))


@query(f"WITH {_COUNTS} SELECT row_number() OVER (ORDER BY i, j) - 1 AS at, i, j, v FROM c")
def array_compressed(spark, sf):
    """Compressed rows of the supplier-part counts: every entry at its place."""
    return R.compressed(cut(R.to_rows(counts(spark, sf))))


@query(f"WITH {_COUNTS} SELECT i, CAST(sum(count(*)) OVER (ORDER BY i) - count(*) AS BIGINT) AS start, count(*) AS nnz FROM c GROUP BY i")
def array_offsets(spark, sf):
    return R.offsets(R.to_rows(counts(spark, sf))).select("i", "start", "nnz")


@query(f"WITH {_QTY} SELECT i, count(*) AS nnz, sum(v) AS total, max(abs(v)) AS largest FROM q GROUP BY 1")
def array_row_sums(spark, sf):
    return R.row_sums(R.to_rows(quantities(spark, sf)))


@query(f"WITH {_COUNTS} SELECT i % 16 AS part, i // 16 AS local, i, count(*) AS nnz, count(*) FILTER (WHERE j % 16 = i % 16) AS inside FROM c GROUP BY i")
def array_parts(spark, sf):
    """Suppliers' rows dealt round-robin, with how many of their columns lie in the same part."""
    own = counts(spark, sf)
    ids = own.select("i").union(own.select("j")).distinct()
    return R.dealt(R.to_rows(own), M.round_robin(ids, "i", 16).withColumnRenamed("key", "i"))


@query(f"WITH {_QTY} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM q a JOIN q b ON a.j = b.j GROUP BY 1, 2")
def tiled_gram(spark, sf):
    """Suppliers by suppliers: the quantities of the parts that both move, by tiles."""
    return T.gram(entries(spark, sf, F.col("l_quantity")))
