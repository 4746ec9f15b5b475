"""Queries that transform the whole events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from .registry import query, r
from .tables import table


def _signal(spark, sf):
    """(k, v) of every event's value at its number, and the length."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("value").alias("v"))
    return e, (e.agg(F.max("k")).first()[0] or 0) + 1


@query("SELECT event_id AS t, round(value, 6) + 0.0 AS x FROM events")
def fft_round_trip(spark, sf):
    """The whole signal transformed and back."""
    e, n = _signal(spark, sf)
    there = S.fft_long(e.select(F.col("k").alias("t"), F.col("v").alias("re"), F.lit(0.0).alias("im")), n)
    return S.fft_long(there.withColumnRenamed("k", "t"), n, inverse=True).select(F.col("k").alias("t"), r("re", 6).alias("x"))


@query("WITH n AS (SELECT max(event_id) + 1 AS n FROM events), b AS (SELECT * FROM (VALUES (0, 3.0), (1, -1.0), (5, 2.0)) t(j, w)) SELECT (event_id + j) % n AS k, round(sum(value * w), 5) + 0.0 AS v FROM events, b, n GROUP BY 1")
def fft_convolution(spark, sf):
    """The whole signal convolved with a kernel by transforms of its full length."""
    e, n = _signal(spark, sf)
    kernel = spark.createDataFrame([(0, 3.0), (1, -1.0), (5, 2.0)], "k long, v double")
    return S.convolve_long(e, kernel, n).select("k", r("v", 5).alias("v"))


@query("""WITH s AS (SELECT event_id % 64 AS i, event_id // 64 % 64 AS j, sum(value) AS x FROM events GROUP BY 1, 2), t AS (SELECT sum(x * x) AS own, sum(x) AS total FROM s)
SELECT round(own, 4) + 0.0 AS energy, round(total, 4) + 0.0 AS mean FROM t""")
def fft_2d_energy(spark, sf):
    """Energy and mean of a 64 x 64 histogram of the events, read off its transform."""
    e = table(spark, sf, "events")
    cells = e.groupBy((F.col("event_id") % 64).alias("i"), (F.floor(F.col("event_id") / 64) % 64).alias("j")).agg(F.sum("value").alias("re")).withColumn("im", F.lit(0.0))
    f = S.fft_image(cells, 64, 64)
    return f.agg(r(F.sum(F.col("re") ** 2 + F.col("im") ** 2) / (64 * 64), 4).alias("energy"), r(F.sum(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("re"))), 4).alias("mean"))
