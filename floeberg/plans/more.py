"""Registered queries of short floats, exact sums, small systems, dependencies and transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import floats as H, posit as P, signal as S
from ..operators import graph as G, solve as V, sparse as M
from . import posit_sql as X
from .registry import _LAB, _bins, _cg_sql, _jacobi_sql, _levels_sql, _ones, _QTY, query, r
from .tables import PARTS, TWO_WAY, by_tens, laplace_sql, quantities, table, two_way

# --------------------------------------------------------------------- short floats


def _round_sql(x: str, form: tuple[int, int], how: str = "round_even({0}, 0)") -> str:
    bits, least = form
    unit = f"pow(2.0, greatest(floor(log2(abs({x}))), {least}) - {bits - 1})"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE {how.format(f'({x}) / {unit}')} * {unit} END"


def _floats_sql(form: tuple[int, int], scale: str) -> str:
    near = lambda x: _round_sql(x, form)
    a = f"SELECT event_id, {near('x')} AS a, {near('y')} AS b FROM (SELECT event_id, value AS x, (event_id % 97 + 1) {scale} AS y FROM events)"
    ops = {"plus": "a + b", "minus": "a - b", "times": "a * b", "ratio": "a / b", "root": "sqrt(abs(a))"}
    raw = f"SELECT *, {', '.join(f'{e} AS r_{n}' for n, e in ops.items())} FROM ({a})"
    return f"SELECT event_id, a + 0.0 AS a, b + 0.0 AS b, {', '.join(f'{near(f'r_{n}')} + 0.0 AS {n}' for n in ops)}, a < b AS lt, least(a, b) + 0.0 AS low, greatest(a, b) + 0.0 AS high FROM ({raw})"


def _floats(spark, sf, form, scale: float) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", H.rounded(F.col("value"), form).alias("a"), H.rounded((F.col("event_id") % 97 + 1) * scale, form).alias("b"))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    f = lambda name, *v: (H.op(name, form, *v) + zero)
    return e.select("event_id", (a + zero).alias("a"), (b + zero).alias("b"), f("add", a, b).alias("plus"), f("subtract", a, b).alias("minus"), f("multiply", a, b).alias("times"), f("divide", a, b).alias("ratio"), f("sqrt", F.abs(a)).alias("root"), (a < b).alias("lt"), f("min", a, b).alias("low"), f("max", a, b).alias("high"))


@query(_floats_sql(H.BFLOAT16, "* 0.37"))
def bfloat16_arithmetic(spark, sf):
    return _floats(spark, sf, H.BFLOAT16, 0.37)


@query(_floats_sql(H.HALF, "* 0.37"))
def half_arithmetic(spark, sf):
    return _floats(spark, sf, H.HALF, 0.37)


@query("SELECT event_id, " + ", ".join(f"{_round_sql('value', H.HALF, how)} + 0.0 AS {name}" for name, how in (("nearest", "round_even({0}, 0)"), ("zero", "trunc({0})"), ("up", "ceil({0})"), ("down", "floor({0})"))) + " FROM events")
def half_styles(spark, sf):
    """The four rounding styles."""
    return table(spark, sf, "events").select("event_id", *((H.half(F.col("value"), s) + F.lit(0.0)).alias(s) for s in ("nearest", "zero", "up", "down")))


@query("""WITH h AS (SELECT CAST(k AS BIGINT) AS k, k * pow(2.0, -24) AS x FROM range(4096) t(k))
SELECT k, x, CASE WHEN x = 0 THEN 'zero' WHEN x < pow(2.0, -14) THEN 'subnormal' ELSE 'normal' END AS class, CASE WHEN x > 0 THEN CAST(floor(log2(k + 0.25)) - 24 AS INTEGER) END AS e,
 x + pow(2.0, greatest(CASE WHEN k = 0 THEN 0 ELSE floor(log2(k + 0.25)) - 10 END, 0) - 24) AS above, CASE WHEN x = 0 THEN -pow(2.0, -24) ELSE x - pow(2.0, greatest(floor(log2(k - 0.5)) - 10, 0) - 24) END AS below,
 trunc(x * 1000) AS whole, x * 1000 - trunc(x * 1000) AS part FROM h WHERE k < 2048""")
def half_fields(spark, sf):
    """Class, exponent, neighbours and parts of the smallest halves."""
    x = F.col("x")
    whole, part = H.modf(x * 1000)
    return spark.range(2048).select(F.col("id").alias("k"), (F.col("id") * 2.0**-24).alias("x")).select("k", "x", H.classify(x).alias("class"), H.ilogb(x).alias("e"), H.nextafter(x).alias("above"), H.nextafter(x, False).alias("below"), whole.alias("whole"), part.alias("part"))


def _trig_sql() -> str:
    parts = "SELECT event_id AS k, 32 AS w, sin(value) AS s, cos(value) AS c, sqrt(abs(value)) AS q FROM events"
    rel = X.of_double(X.of_double(X.of_double(parts, "s", "x"), "c", "y"), "q", "v")
    rel = X.encode(X.encode(X.encode(rel, "x", "sine", "w", 2), "y", "cosine", "w", 2), "v", "root", "w", 2)
    return f"SELECT k, sine, cosine, root FROM ({rel})"


@query(_trig_sql())
def posit32_functions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"), "value")
    f = P.column("from_double", 32)
    return e.select("k", f(F.sin("value")).alias("sine"), f(F.cos("value")).alias("cosine"), f(F.sqrt(F.abs("value"))).alias("root"))


@query(f"SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS single, {_round_sql('value', H.BFLOAT16)} + 0.0 AS brain, {_round_sql(_round_sql('value', H.BFLOAT16), H.HALF)} + 0.0 AS twice FROM events")
def format_casts(spark, sf):
    v = F.col("value")
    brain = H.bfloat16(v)
    return table(spark, sf, "events").select("event_id", v.cast("float").cast("double").alias("single"), (brain + F.lit(0.0)).alias("brain"), (H.half(brain) + F.lit(0.0)).alias("twice"))


@query("SELECT round(sum(advantage * n) / sum(n), 9) + 0.0 AS mean FROM (SELECT 5 - least(CASE WHEN k >= 0 THEN k + 2 ELSE 1 - k END, 31) AS advantage, count(*) AS n FROM (SELECT floor(log2(abs(l_extendedprice)) / 4) AS k FROM lineitem WHERE l_extendedprice <> 0) GROUP BY 1)")
def posit_mean_advantage(spark, sf):
    return table(spark, sf, "lineitem").select(P.advantage(F.col("l_extendedprice")).alias("a")).where("a is not null").agg(r(F.avg("a"), 9).alias("mean"))


@query("SELECT CAST(w AS INTEGER) AS width, pow(pow(2.0, 4), w - 2) AS largest, pow(pow(2.0, 4), 2 - w) AS smallest FROM range(3, 33) t(w)")
def posit_ranges(spark, sf):
    return spark.createDataFrame([(w, P.largest(w, 2), P.smallest(w, 2)) for w in range(3, 33)], "width int, largest double, smallest double")


# -------------------------------------------------------------- exact sums and solvers


@query("SELECT l_suppkey AS i, round(sum(l_quantity * p_retailprice), 2) + 0.0 AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv_exact(spark, sf):
    """Row sums exact, rounded once."""
    mat = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return M.spmv_exact(mat, table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))).select("i", r("y", 2).alias("y"))


@query("SELECT round(sum(s_acctbal * s_acctbal), 4) + 0.0 AS dot FROM supplier")
def inner_product(spark, sf):
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return M.inner_product(x, x).select(r("dot", 4).alias("dot"))


@query("SELECT s_suppkey AS i, round(2 * s_acctbal - 0.5 * s_nationkey, 6) + 0.0 AS x FROM supplier")
def linear_combination(spark, sf):
    s = table(spark, sf, "supplier")
    x, y = s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("x"))
    return M.combination(2.0, x, -0.5, y).select("i", r("x", 6).alias("x"))


@query(f"WITH {_cg_sql(10, 10)} SELECT i, round(x, 7) + 0.0 AS x FROM c10")
def cg_exact_10(spark, sf):
    return V.conjugate_gradient(M.laplace_5pt(spark, 10), _ones(spark, 100), 0.0, 10, exact=True).select("i", r("x", 7).alias("x"))


@query(f"WITH {_cg_sql(10, 6)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, round(sqrt(sum(r * r)), 7) + 0.0 AS residual FROM c{k}" for k in range(6)))
def cg_residuals(spark, sf):
    trace: list = []
    V.conjugate_gradient(M.laplace_5pt(spark, 10), _ones(spark, 100), 0.0, 6, trace=trace)
    return spark.createDataFrame(trace, "step int, residual double").select("step", r("residual", 7).alias("residual"))


@query(f"WITH {_jacobi_sql(3, 80)} SELECT i, round(x, 6) + 0.0 AS x FROM x80")
def jacobi_fixed_point(spark, sf):
    """What the asynchronous solvers end at: Gauss-Seidel inside blocks, Jacobi between them."""
    return V.block_gauss_seidel(M.laplace_5pt(spark, 3), _ones(spark, 9), 3, 40).select("i", r("x", 6).alias("x"))


@query(f"WITH {_levels_sql(5)} SELECT 24 - i AS i, round(x, 12) + 0.0 AS x FROM y8")
def back_substitution(spark, sf):
    return V.triangular_solve(M.laplace_5pt(spark, 5, "upper"), _ones(spark, 25), lower=False).select("i", r("x", 12).alias("x"))


@query("SELECT CAST(k AS BIGINT) AS i, CAST(9 - k % 10 + 9 - k // 10 AS BIGINT) AS level FROM range(100) r(k)")
def upper_levels(spark, sf):
    return M.level_sets(M.laplace_5pt(spark, 10), lower=False).select("i", F.col("level").cast("long").alias("level"))


@query("SELECT CAST(19 AS BIGINT) AS levels, CAST(10 AS BIGINT) AS widest")
def level_parallelism(spark, sf):
    return M.parallelism(M.level_sets(M.laplace_5pt(spark, 10)))


@query(f"WITH {laplace_sql(30)}, d AS (SELECT i, j FROM a WHERE j < i) SELECT CAST(k AS BIGINT) AS i, (SELECT count(*) FROM d WHERE d.i = k) AS back, (SELECT count(*) FROM d WHERE d.j = k) AS forward FROM range(900) r(k)")
def dependency_profile(spark, sf):
    return M.dependency_profile(M.laplace_5pt(spark, 30))


#: Small symmetric systems, one for each supplier: [[4 + x, 1], [1, 3]] with x = |balance| / 1000.
_SMALL2 = "x AS (SELECT s_suppkey AS g, abs(s_acctbal) / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS b FROM supplier)"


def _small_systems(spark, sf, corner=None) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"), (F.abs("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("b"))
    entry = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.cast("double").alias("v"))
    one = F.lit(1.0) if corner is None else corner
    a = s.select("g", F.explode(F.array(entry(0, 0, 4 + F.col("x")), entry(0, 1, one), entry(1, 0, one), entry(1, 1, F.lit(3.0)))).alias("e")).select("g", "e.*")
    b = s.select("g", F.posexplode(F.array("b", F.lit(1.0))).alias("i", "x")).select("g", F.col("i").cast("long").alias("i"), "x")
    return a, b


@query(f"WITH {_SMALL2} SELECT g, n.name, CAST(n.i AS BIGINT) AS i, CAST(n.j AS BIGINT) AS j, round(CASE n.name || n.i || n.j WHEN 'L10' THEN 1 / (4 + x) WHEN 'U00' THEN 4 + x WHEN 'U11' THEN 3 - 1 / (4 + x) ELSE 1 END, 9) + 0.0 AS v FROM x, (VALUES ('L', 0, 0), ('L', 1, 0), ('L', 1, 1), ('U', 0, 0), ('U', 0, 1), ('U', 1, 1)) n(name, i, j)")
def lu_by_supplier(spark, sf):
    return V.factor(_small_systems(spark, sf)[0]).select("g", "name", "i", "j", r("v", 9).alias("v"))


@query(f"WITH {_SMALL2} SELECT g, CAST(n.i AS BIGINT) AS i, CAST(n.j AS BIGINT) AS j, round(CASE n.i * 2 + n.j WHEN 0 THEN sqrt(4 + x) WHEN 1 THEN 1 / sqrt(4 + x) ELSE sqrt(3 - 1 / (4 + x)) END, 9) + 0.0 AS v FROM x, (VALUES (0, 0), (0, 1), (1, 1)) n(i, j)")
def cholesky_by_supplier(spark, sf):
    return V.factor(_small_systems(spark, sf)[0], "cholesky").select("g", "i", "j", r("v", 9).alias("v"))


_CRAMER = f"WITH {_SMALL2}, d AS (SELECT *, (4 + x) * 3 - 1 AS det FROM x) SELECT g, CAST(k AS BIGINT) AS i, round(CASE k WHEN 0 THEN (3 * b - 1) / det ELSE (4 + x - b) / det END, 9) + 0.0 AS x FROM d, range(2) t(k)"


@query(_CRAMER)
def solve_by_supplier(spark, sf):
    """Direct solves, one for each group."""
    return V.solve(*_small_systems(spark, sf)).select("g", "i", r("x", 9).alias("x"))


@query(_CRAMER)
def solve_mixed(spark, sf):
    """Factors in single precision, refined in double."""
    return V.solve(*_small_systems(spark, sf), low="float32").select("g", "i", r("x", 9).alias("x"))


@query(_CRAMER)
def solve_cholesky_mixed(spark, sf):
    return V.solve(*_small_systems(spark, sf), how="cholesky", low="float32", high="longdouble").select("g", "i", r("x", 9).alias("x"))


@query("SELECT s_suppkey AS g, 3 - pow(s_nationkey / 4.0, 2) / (4 + abs(s_acctbal) / 1000) >= 0 AS spd FROM supplier")
def positive_definite(spark, sf):
    corner = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"), (F.col("s_nationkey") / 4).cast("double").alias("c"))
    a = _small_systems(spark, sf)[0].join(corner, "g").select("g", "i", "j", F.when(F.col("i") != F.col("j"), F.col("c")).otherwise(F.col("v")).alias("v"))
    return V.positive_definite(a)


_SCALES = {
    "max": "(SELECT max(abs(v)) FROM q WHERE i = j)", "geometric": "(SELECT exp(avg(ln(abs(v)))) FROM q WHERE i = j AND v <> 0)",
    "entries": "(SELECT exp(avg(ln(abs(v)))) FROM q WHERE v <> 0)", "norm": "(SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM q GROUP BY i))",
}


def _scale_sql(how: str) -> str:
    return f"WITH {_QTY} SELECT i, j, v / pow(2.0, round(log2({_SCALES[how]}))) AS v FROM q"


@query(_scale_sql("max"))
def scale_max(spark, sf):
    return M.scale_by_diagonal(quantities(spark, sf), "max")


@query(_scale_sql("geometric"))
def scale_geometric(spark, sf):
    return M.scale_by_diagonal(quantities(spark, sf), "geometric")


@query(_scale_sql("entries"))
def scale_entries(spark, sf):
    return M.scale_by_diagonal(quantities(spark, sf), "entries")


@query(_scale_sql("norm"))
def scale_norm(spark, sf):
    return M.scale_by_diagonal(quantities(spark, sf), "norm")


@query(f"WITH {_QTY}, s0 AS MATERIALIZED (SELECT q.i, q.j, v / sqrt(a.m) / sqrt(coalesce(b.m, 1)) AS v FROM q JOIN (SELECT i, max(abs(v)) AS m FROM q GROUP BY i) a ON a.i = q.i JOIN (SELECT i, max(abs(v)) AS m FROM q GROUP BY i) b ON b.i = q.j) SELECT i, j, round(v, 9) + 0.0 AS v FROM s0")
def equilibrate_symmetric(spark, sf):
    """One step; columns that are no rows fall away."""
    return M.equilibrate_symmetric(quantities(spark, sf), 1).select("i", "j", r("v", 9).alias("v"))


@query(f"WITH {_QTY} SELECT i - CASE WHEN i > 3 THEN 1 ELSE 0 END AS i, j - CASE WHEN j > 50 THEN 1 ELSE 0 END AS j, v FROM q WHERE i <> 3 AND j <> 50")
def cofactor_matrix(spark, sf):
    return M.without(quantities(spark, sf), 3, 50)


@query(f"WITH {_QTY} SELECT i, j, v FROM q WHERE i >= j")
def lower_triangle(spark, sf):
    return M.triangle(quantities(spark, sf))


@query("SELECT CAST(k AS BIGINT) AS i, CAST(7 AS BIGINT) AS entries, CAST(7 AS BIGINT) AS columns, true AS inside FROM range(500) t(k)")
def random_row_counts(spark, sf):
    """Rows of a matrix with a fixed number of normally distributed entries."""
    return M.random_rows(spark, 500, 7).groupBy("i").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("j").alias("columns"), F.min((F.col("j") >= 0) & (F.col("j") < 500) & F.col("v").isNotNull()).alias("inside"))


# ------------------------------------------------------------------ graphs and signals


@query(f"WITH {TWO_WAY}, {_LAB} SELECT round(sum(c), 9) + 0.0 AS c FROM (SELECT mod, avg(CASE WHEN m1 <> m2 THEN 1.0 ELSE 0.0 END) AS c FROM (SELECT m1 AS mod, m1, m2 FROM l UNION ALL SELECT m2, m1, m2 FROM l) GROUP BY 1)")
def conductance_sum(spark, sf):
    e = two_way(spark, sf)
    return G.conductance_sum(e, by_tens(G.vertices(e))).select(r("c", 9).alias("c"))


@query(f"WITH {TWO_WAY} SELECT id % {PARTS} AS mod, min(id) AS first, max(id) AS last, CAST(sum(id) AS BIGINT) AS total FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) GROUP BY 1")
def module_members_span(spark, sf):
    return by_tens(G.vertices(two_way(spark, sf))).groupBy("mod").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum("id").alias("total"))


_GRID = "s AS MATERIALIZED (SELECT event_id % 8 AS i, event_id // 8 % 8 AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def _grid(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy((F.col("event_id") % 8).alias("i"), (F.floor(F.col("event_id") / 8) % 8).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("g", F.lit(0).cast("long"))


@query(f"WITH {_GRID} SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, round(sum(v * cos(-2 * pi() * (s.i * a + s.j * b) / 8)), 4) + 0.0 AS re, round(sum(v * sin(-2 * pi() * (s.i * a + s.j * b) / 8)), 4) + 0.0 AS im FROM s, range(8) p(a), range(8) q(b) GROUP BY 1, 2")
def fft_2d_events(spark, sf):
    return S.fft_2d(_grid(spark, sf), 8, 8).select("i", "j", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query(f"WITH {_GRID} SELECT i, j, round(v, 6) + 0.0 AS v FROM s")
def fft_2d_round_trip(spark, sf):
    there = S.fft_2d(_grid(spark, sf), 8, 8).withColumnsRenamed({"re": "v", "im": "w"})
    return S.fft_2d(there, 8, 8, inverse=True).select("i", "j", r("re", 6).alias("v"))


@query(f"WITH {_GRID}, b AS (SELECT * FROM (VALUES (0, 0, 2), (1, 3, -1)) t(x, y, w)) SELECT CAST((i + x) % 8 AS BIGINT) AS i, CAST((j + y) % 8 AS BIGINT) AS j, round(sum(v * w), 6) + 0.0 AS v FROM s, b GROUP BY 1, 2")
def convolution_by_fft_2d(spark, sf):
    b = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 3, -1.0)], "g long, i long, j long, v double")
    return S.convolve_fft(_grid(spark, sf), b, 8, 8).select("i", "j", r("v", 6).alias("v"))


@query("SELECT event_id % 64 AS k, round(sum(value), 4) + 0.0 AS re, 0.0 AS im FROM events GROUP BY 1")
def fft_round_trip(spark, sf):
    x = _bins(spark, sf).select(F.lit(0).cast("long").alias("g"), "t", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    there = S.fft(x).withColumnRenamed("k", "t")
    return S.fft(there, inverse=True).select("k", r("re", 4).alias("re"), r("im", 6).alias("im"))


@query("WITH h AS (SELECT pi() / 10000 AS h), c AS (SELECT k, k * h AS x, h FROM range(10001) t(k), h), f AS (SELECT k, h, x" + "".join(f" + sin({1 << k} * x) / {1 << k}" for k in range(1, 11)) + " AS y FROM c), d AS (SELECT h, y - lag(y) OVER (ORDER BY k) AS dy FROM f) SELECT round(fsum(sqrt(h * h + dy * dy)), 9) + 0.0 AS s FROM d WHERE dy IS NOT NULL")
def arc_length_exact(spark, sf):
    return S.arc_length(spark, 10_000, exact=True).select(r("s", 9).alias("s"))


@query("""WITH RECURSIVE n AS (SELECT list_sort(list(n)) AS w, 0::BIGINT AS cost FROM (SELECT count(*) AS n FROM lineitem GROUP BY CAST(l_quantity AS INTEGER) % 12)),
 m AS (SELECT w, cost FROM n UNION ALL SELECT list_sort(list_append(w[3:], w[1] + w[2])), cost + w[1] + w[2] FROM m WHERE len(w) > 1)
SELECT CAST(max(cost) AS BIGINT) AS bits FROM m""")
def huffman_cost(spark, sf):
    """Bits of all quantities modulo 12 in their best prefix code: the same for every choice among ties."""
    li = table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("int") % 12).cast("string").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    lengths = S.huffman_lengths({x[0]: x[1] for x in li.collect()})  # 12 symbols
    return li.join(spark.createDataFrame(list(lengths.items()), "sym string, len int"), "sym").agg(F.sum(F.col("n") * F.col("len")).alias("bits"))
