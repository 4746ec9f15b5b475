"""Graph and matrix views of the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import graph as G
from .iterate import cut

SHIFT = 1_000_000
PARTS = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """supplier -> part, weight = line items."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + SHIFT).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def two_way(spark: SparkSession, sf: str) -> DataFrame:
    """Links of parts back to suppliers for even parts only: odd parts dangle."""
    e = raw_edges(spark, sf)
    return _both_ways(e)


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(G.reverse(e).where("src % 2 = 0"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def entries(spark: SparkSession, sf: str, v: Column) -> DataFrame:
    """One entry a line item, for operators that add the entries that repeat: nothing is shuffled to add them before."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), v.alias("v"))


def quantities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def ranked(spark: SparkSession, sf: str, iterations: int, both: bool = True):
    """Rates, and the normalised edges where they lie by their source, as the rates do by their node."""
    own = cut(raw_edges(spark, sf))  # counted once, written once
    edges = G.proper_edges(_both_ways(own) if both else own)
    edges._written = own._written
    nodes = G.teleport_weights(cut(G.vertices(edges)).withColumn("node_weight", F.lit(1.0)))
    linked = G.link(edges, normal=True)
    return G.pagerank(nodes, linked, iterations), linked.edges.select("src", "dst", "w")


def flow(spark: SparkSession, sf: str, iterations: int = 3) -> G.Flow:
    rates, edges = ranked(spark, sf, iterations)
    return G.flow(rates, edges)


def by_tens(df: DataFrame) -> DataFrame:
    return df.select("id", (F.col("id") % PARTS).alias("mod"))


EDGES = f"""e0 AS MATERIALIZED (SELECT l_suppkey AS src, l_partkey + {SHIFT} AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"""
TWO_WAY = EDGES + """, e1 AS MATERIALIZED (SELECT src, dst, w FROM e0 UNION ALL SELECT dst, src, w FROM e0 WHERE dst % 2 = 0)"""


def rank_sql(iterations: int, both: bool = True) -> str:
    """CTEs up to ``p``: (id, tau, dg, p)."""
    out = [TWO_WAY if both else EDGES + ", e1 AS MATERIALIZED (SELECT * FROM e0)"]
    out.append("e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e1)")
    out.append("n AS MATERIALIZED (SELECT id, 1.0::DOUBLE / count(*) OVER () AS tau, NOT EXISTS (SELECT 1 FROM e WHERE e.src = id) AS dg FROM (SELECT src AS id FROM e UNION SELECT dst FROM e))")
    out.append("p0 AS MATERIALIZED (SELECT id, tau, dg, tau AS p FROM n)")
    for k in range(1, iterations + 1):
        a = f"p{k - 1}"
        out.append(f"q{k} AS MATERIALIZED (SELECT id, tau, dg, (0.15 + 0.85 * (SELECT coalesce(sum(p), 0) FROM {a} WHERE dg)) * tau + 0.85 * coalesce(s, 0) AS p FROM {a} LEFT JOIN (SELECT dst, sum(w * p) AS s FROM e JOIN {a} ON src = id GROUP BY dst) x ON x.dst = {a}.id)")
        out.append(f"p{k} AS MATERIALIZED (SELECT id, tau, dg, p / (SELECT sum(p) FROM q{k}) AS p FROM q{k})")
    out.append(f"p AS MATERIALIZED (SELECT * FROM p{iterations})")
    return ", ".join(out)


def flow_sql(iterations: int = 3) -> str:
    """CTEs up to fn (id, p, tau, d, mod), f (src, dst, f, m1, m2) and m (modules)."""
    return rank_sql(iterations) + f""", fn AS MATERIALIZED (SELECT id, p, tau, CASE WHEN dg THEN p ELSE 0 END AS d, id % {PARTS} AS mod FROM p),
 f AS MATERIALIZED (SELECT src, dst, p * w AS f, src % {PARTS} AS m1, dst % {PARTS} AS m2 FROM e JOIN p ON src = id),
 m AS MATERIALIZED (SELECT mod, p, tau, d, members, 0.15 * (1 - tau) * p + 0.85 * (coalesce(o, 0) + (1 - tau) * d) AS ex FROM (SELECT mod, sum(p) AS p, sum(tau) AS tau, sum(d) AS d, count(*) AS members FROM fn GROUP BY mod) a LEFT JOIN (SELECT m1, sum(f) AS o FROM f WHERE m1 <> m2 GROUP BY m1) b ON m1 = mod)"""


def laplace_sql(n: int) -> str:
    return f"""a AS MATERIALIZED (SELECT i, j, v FROM (SELECT CAST(k AS BIGINT) AS i, CAST(unnest([k, k - 1, k + 1, k - {n}, k + {n}]) AS BIGINT) AS j, unnest([4.0, -1.0, -1.0, -1.0, -1.0])::DOUBLE AS v, unnest([true, k % {n} > 0, k % {n} < {n - 1}, k >= {n}, k < {n * n - n}]) AS ok FROM range({n * n}) r(k)) WHERE ok)"""
