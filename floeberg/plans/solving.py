"""Queries that solve systems made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import solve as V
from .iterate import cut
from .registry import query, r
from .tables import SHIFT, raw_edges

#: How much the diagonal outweighs a row.
WEIGHT = 4.0


def system(spark, sf):
    """A x = b on suppliers and parts: A = 4 (1 + degree) on the diagonal, minus one for each link; b = number mod 7 + 1."""
    links = cut(raw_edges(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j")))  # counted once, written once
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j")))
    diagonal = cut(both.groupBy("i").agg(F.count(F.lit(1)).alias("n")).select("i", F.col("i").alias("j"), (WEIGHT * (1 + F.col("n"))).alias("v")))
    a = both.withColumn("v", F.lit(-1.0)).unionByName(diagonal)
    a._written = links._written  # no more than reads of what was written
    return a, diagonal.select("i", (F.col("i") % 7 + 1.0).alias("x"))


def _jacobi_sql(steps: int) -> str:
    out = [f"l AS MATERIALIZED (SELECT DISTINCT l_suppkey AS i, l_partkey + {SHIFT} AS j FROM lineitem)", "o AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l)", f"d AS MATERIALIZED (SELECT i, {WEIGHT} * (1 + count(*)) AS d, i % 7 + 1.0 AS b FROM o GROUP BY i)", "x0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS x FROM d)"]
    for k in range(1, steps + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT d.i, (b + coalesce(s, 0)) / d AS x FROM d LEFT JOIN (SELECT o.i, sum(x) AS s FROM o JOIN x{k - 1} y ON y.i = o.j GROUP BY o.i) z ON z.i = d.i)")
    return f"WITH {', '.join(out)} SELECT i, round(x, 9) + 0.0 AS x FROM x{steps}"


@query(_jacobi_sql(6))
def jacobi_supplier_part(spark, sf):
    return V.jacobi(*system(spark, sf), iterations=6).select("i", r("x", 9).alias("x"))


@query(_jacobi_sql(24))
def relaxation_supplier_part(spark, sf):
    """Residual-driven relaxation to the end: what Jacobi's iteration converges to."""
    return V.relax(*system(spark, sf), bound=1e-13).select("i", r("x", 9).alias("x"))
