"""Registered queries of the posit formats: arithmetic, conversions and quires."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import posit as P
from ..functions.quire import Quire
from . import posit_sql as X
from .registry import query
from .tables import table

N = 16_384


def _patterns(n: int, width: str) -> tuple[list[list[str]], str]:
    """Bit patterns a, b, c of short and long regimes and both signs, b often near -a:
    as stages of Spark expressions and as SQL, from one text."""
    stages = [
        [f"CAST({width} AS INT) AS w"],
        ["(k * 2654435761) % POW(w) AS a0", "(k * 2246822519 + 374761393) % POW(w) AS b0", "(k * 3266489917 + 668265263) % POW(w) AS c0"],
        ["DOWN(a0, k % w) AS a1", "DOWN(b0, DIV(k, 7) % w) AS b1", "DOWN(c0, DIV(k, 11) % w) AS c1"],
        ["CASE WHEN k % 2 = 1 THEN (POW(w) - a1) % POW(w) ELSE a1 END AS a", "CASE WHEN k % 3 = 1 THEN (POW(w) - c1) % POW(w) ELSE c1 END AS c"],
        ["CASE WHEN k % 5 = 0 THEN (2 * POW(w) - a + k % 3 - 1) % POW(w) WHEN k % 4 = 1 THEN (POW(w) - b1) % POW(w) ELSE b1 END AS b"],
    ]
    duck = f"SELECT CAST(t.k AS BIGINT) AS k FROM range({n}) t(k)"
    for cols in stages:
        duck = f"SELECT *, {', '.join(cols)} FROM ({duck})"
    duck = re.sub(r"POW\(w\)", "CAST(pow(2, w) AS BIGINT)", duck)
    duck = re.sub(r"DOWN\((\w+), (k % w|DIV\(k, \d+\) % w)\)", r"(\1 // CAST(pow(2, \2) AS BIGINT))", duck)
    duck = re.sub(r"DIV\(k, (\d+)\)", r"(k // \1)", duck)
    spark = [[re.sub(r"DIV\(k, (\d+)\)", r"(k div \1)", re.sub(r"DOWN\((\w+), (k % w|DIV\(k, \d+\) % w)\)", r"shiftright(\1, cast(\2 as int))", c.replace("POW(w)", "shiftleft(1L, w)"))) for c in cols] for cols in stages]
    return spark, f"SELECT k, w, a, b, c FROM ({duck})"


def _rows(spark, n: int, width: str) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "k")
    for cols in _patterns(n, width)[0]:
        df = df.selectExpr("*", *cols)
    return df.select("k", "w", "a", "b", "c")


def _arithmetic_sql(width: str, es: int, n: int = N) -> str:
    d = X.decode(X.decode(X.decode("SELECT * FROM p", "a", "x", "w", es), "b", "y", "w", es), "c", "v", "w", es)
    ops = {
        "plus": X.add("SELECT * FROM d", "x", "y", "e"), "minus": X.add("SELECT * FROM d", "x", "y", "e", minus=True), "times": X.multiply("SELECT * FROM d", "x", "y", "e"),
        "ratio": X.divide("SELECT * FROM d", "x", "y", "e"), "fma": X.add(X.multiply("SELECT * FROM d", "x", "y", "m"), "m", "v", "e"),
    }
    made = ", ".join(f"q_{o} AS MATERIALIZED (SELECT k, {o} FROM ({X.encode(sql, 'e', o, 'w', es)}))" for o, sql in ops.items())
    joins = " ".join(f"JOIN q_{o} USING (k)" for o in ops)
    signed = lambda b: f"(CASE WHEN {b} >= CAST(pow(2, w - 1) AS BIGINT) THEN {b} - CAST(pow(2, w) AS BIGINT) ELSE {b} END)"
    return f"WITH p AS MATERIALIZED ({_patterns(n, width)[1]}), d AS MATERIALIZED ({d}), {made} SELECT k, w, a, b, c, {', '.join(ops)}, {signed('a')} < {signed('b')} AS lt, {signed('a')} <= {signed('b')} AS le, a = b AS eq FROM p {joins}"


def _arithmetic(spark, width: str, es: int, n: int = N) -> DataFrame:
    p = _rows(spark, n, width)
    f = lambda op, *c: P.column(op, None, es)("w", *c)
    half, full = F.expr("shiftleft(1L, w - 1)"), F.expr("shiftleft(1L, w)")
    signed = lambda b: F.when(F.col(b) >= half, F.col(b) - full).otherwise(F.col(b))
    return p.select(
        "k", "w", "a", "b", "c", f("add", "a", "b").alias("plus"), f("subtract", "a", "b").alias("minus"), f("multiply", "a", "b").alias("times"), f("divide", "a", "b").alias("ratio"), f("fused", "a", "b", "c").alias("fma"),
        (signed("a") < signed("b")).alias("lt"), (signed("a") <= signed("b")).alias("le"), (F.col("a") == F.col("b")).alias("eq"))


@query(_arithmetic_sql("8", 0))
def posit8_arithmetic(spark, sf):
    return _arithmetic(spark, "8", 0)


@query(_arithmetic_sql("16", 1))
def posit16_arithmetic(spark, sf):
    return _arithmetic(spark, "16", 1)


@query(_arithmetic_sql("32", 2))
def posit32_arithmetic(spark, sf):
    return _arithmetic(spark, "32", 2)


@query(_arithmetic_sql("2 + k % 31", 1))
def positx1_arithmetic(spark, sf):
    """One exponent bit, every width from 2 to 32."""
    return _arithmetic(spark, "2 + k % 31", 1)


@query(_arithmetic_sql("2 + k % 31", 2))
def positx2_arithmetic(spark, sf):
    return _arithmetic(spark, "2 + k % 31", 2)


_INTS = {"i32": (32, True), "i64": (64, True), "u32": (32, False), "u64": (64, False)}


def _range(bits: int, signed: bool) -> tuple[int, int]:
    return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)


def _unary_sql(width: str, es: int, n: int = N) -> str:
    d = X.whole(X.whole(X.decode("SELECT * FROM p", "a", "x", "w", es), "x", "near"), "x", "cut", True)
    kept = X.of_integer("SELECT * EXCLUDE (xt) FROM d", "near", "n", "xg")
    rounded = X.stage(kept, **{f"e{c}": f"CASE WHEN xs >= 60 THEN {old} ELSE n{c} END" for c, old in (("s", "xs"), ("f", "xf"), ("t", "false"), ("z", "xz"), ("g", "xg"))}, er="xr")
    rounded = X.encode(rounded, "e", "rounded", "w", es)
    rt = X.encode(X.root("SELECT * FROM d", "x", "u"), "u", "root", "w", es)
    ints = ", ".join(f"CAST({X.limited('near', 'x', *_range(*v))} AS {'VARCHAR' if k == 'u64' else 'BIGINT'}) AS {k}" for k, v in _INTS.items())
    cut = f"CAST({X.limited('cut', 'x', *_range(64, True))} AS BIGINT) AS cut64"
    return f"WITH p AS MATERIALIZED ({_patterns(n, width)[1]}), d AS MATERIALIZED ({d}), q AS MATERIALIZED (SELECT k, rounded FROM ({rounded})), s AS MATERIALIZED (SELECT k, root FROM ({rt})) SELECT k, w, a, root, rounded, {ints}, {cut}, {X.value('x')} AS value FROM d JOIN q USING (k) JOIN s USING (k)"


def _unary(spark, width: str, es: int, n: int = N) -> DataFrame:
    f = lambda op, **o: P.column(op, None, es, **o)("w", "a")
    ints = [f("to_integer", bits=b, signed=s).alias(k) for k, (b, s) in _INTS.items()]
    got = _rows(spark, n, width).select("k", "w", "a", f("sqrt").alias("root"), f("round").alias("rounded"), *ints, f("to_integer", truncate=True).alias("cut64"), f("to_double").alias("value"))
    return got.withColumn("u64", P.unsigned(F.col("u64")).cast("string")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query(_unary_sql("8", 0))
def posit8_unary(spark, sf):
    return _unary(spark, "8", 0)


@query(_unary_sql("16", 1, 65_536))
def posit16_unary(spark, sf):
    """Square root, rounding, integers (nearest, truncated, unsigned) and the value as a double."""
    return _unary(spark, "16", 1, 65_536)


@query(_unary_sql("32", 2))
def posit32_unary(spark, sf):
    return _unary(spark, "32", 2)


@query(_unary_sql("2 + k % 31", 1))
def positx1_unary(spark, sf):
    return _unary(spark, "2 + k % 31", 1)


@query(_unary_sql("2 + k % 31", 2))
def positx2_unary(spark, sf):
    return _unary(spark, "2 + k % 31", 2)


#: Target formats: name, width (an expression of w), exponent bits.
_TO = (("p8", "8", 0), ("p16", "16", 1), ("p32", "32", 2), ("x1", "w", 1), ("x2", "w", 2))


def _each_target(rel: str, p: str) -> tuple[str, str]:
    made = ", ".join(f"t_{n} AS MATERIALIZED (SELECT k, {n} FROM ({X.encode(rel, p, n, w, es)}))" for n, w, es in _TO)
    return made, " ".join(f"JOIN t_{n} USING (k)" for n, _, _ in _TO)


def _conversion_sql(width: str, to: str, es: int) -> str:
    source = f"SELECT k, w AS from_w, CAST({to} AS INT) AS w, a FROM ({_patterns(N, width)[1]})"
    made, joins = _each_target("SELECT * FROM d", "x")
    return f"WITH p AS MATERIALIZED ({source}), d AS MATERIALIZED ({X.decode('SELECT * FROM p', 'a', 'x', 'from_w', es)}), {made} SELECT k, from_w, w, a, {', '.join(n for n, _, _ in _TO)} FROM p {joins}"


def _conversions(spark, width: str, to: str, es: int) -> DataFrame:
    p = _rows(spark, N, width).selectExpr("k", "w as from_w", f"cast({to.replace('//', 'div')} as int) as w", "a")
    return p.select("k", "from_w", "w", "a", *(P.convert_column(None, es, None, e)("from_w", F.expr(w), "a").alias(n) for n, w, e in _TO))


_ANY = "2 + (k // 3) % 31"


@query(_conversion_sql("8", _ANY, 0))
def posit8_conversions(spark, sf):
    """To every other format, the variable ones at all widths."""
    return _conversions(spark, "8", _ANY, 0)


@query(_conversion_sql("16", _ANY, 1))
def posit16_conversions(spark, sf):
    return _conversions(spark, "16", _ANY, 1)


@query(_conversion_sql("32", _ANY, 2))
def posit32_conversions(spark, sf):
    return _conversions(spark, "32", _ANY, 2)


@query(_conversion_sql("2 + k % 31", _ANY, 1))
def positx1_conversions(spark, sf):
    return _conversions(spark, "2 + k % 31", _ANY, 1)


@query(_conversion_sql("2 + k % 31", _ANY, 2))
def positx2_conversions(spark, sf):
    return _conversions(spark, "2 + k % 31", _ANY, 2)


def _integers_sql(bits: int, signed: bool) -> str:
    source = f"SELECT CAST(t.k AS BIGINT) AS k, CAST(2 + t.k % 31 AS INT) AS w, ((t.k * 2654435761)::HUGEINT * 4294967291 + t.k) % {X.p2(bits)} // {X.p2(f't.k // 31 % {bits}')} AS m FROM range({N}) t(k)"
    n = f"CASE WHEN m >= {1 << (bits - 1)}::HUGEINT THEN m - {1 << bits}::HUGEINT WHEN k % 2 = 1 THEN -m ELSE m END" if signed else "m"
    rel = X.of_integer(f"SELECT *, abs(n) AS size FROM (SELECT *, {n} AS n FROM ({source}))", "size", "x", "n < 0")
    made, joins = _each_target("SELECT * FROM d", "x")
    return f"WITH d AS MATERIALIZED ({rel}), {made} SELECT k, w, CAST(n AS VARCHAR) AS n, {', '.join(n for n, _, _ in _TO)} FROM d {joins}"


def _integers(spark, bits: int, signed: bool) -> DataFrame:
    d = "decimal(38,0)"
    m = F.floor(((F.col("k") * 2654435761).cast("decimal(19,0)") * F.lit(4294967291).cast("decimal(10,0)") + F.col("k")).cast(d) % F.lit(str(1 << bits)).cast(d))
    df = spark.range(N).withColumnRenamed("id", "k").withColumn("w", F.expr("cast(2 + k % 31 as int)")).withColumn("m0", m.cast(d))
    by = F.pow(F.lit(2.0), F.expr(f"k div 31 % {bits}")).cast("decimal(20,0)")
    df = df.withColumn("m", F.expr("m0").cast("decimal(20,0)")).withColumn("by", by).withColumn("m", F.expr("cast((m - m % by) / by as decimal(20,0))"))
    n = F.col("m")
    if signed:
        top = F.lit(str(1 << (bits - 1))).cast("decimal(20,0)")
        n = F.when(F.col("m") >= top, F.col("m") - F.lit(str(1 << bits)).cast("decimal(21,0)")).when(F.col("k") % 2 == 1, -F.col("m")).otherwise(F.col("m"))
    df = df.withColumn("n", n.cast("decimal(21,0)"))
    held = F.col("n").cast("long") if signed else P.as_long(F.col("n").cast("decimal(20,0)"))
    f = lambda w, es: P.column("from_integer", None, es, unsigned=not signed)(F.expr(w), "held")
    return df.withColumn("held", held).select("k", "w", F.col("n").cast("string").alias("n"), *(f(w, es).alias(name) for name, w, es in _TO))


@query(_integers_sql(32, True))
def posit_from_i32(spark, sf):
    return _integers(spark, 32, True)


@query(_integers_sql(32, False))
def posit_from_u32(spark, sf):
    return _integers(spark, 32, False)


@query(_integers_sql(64, True))
def posit_from_i64(spark, sf):
    return _integers(spark, 64, True)


@query(_integers_sql(64, False))
def posit_from_u64(spark, sf):
    return _integers(spark, 64, False)


def _doubles_sql(x: str) -> str:
    rel = X.of_double(f"SELECT event_id AS k, CAST(2 + event_id % 31 AS INT) AS w, {x} AS x FROM events", "x", "x")
    made, joins = _each_target("SELECT * FROM d", "x")
    back = ", ".join(f"b_{n} AS MATERIALIZED (SELECT k, {X.value('y')} AS {n}_value FROM ({X.decode(f'SELECT k, w, {n} FROM d JOIN t_{n} USING (k)', n, 'y', w, es)}))" for n, w, es in _TO)
    names = [c for n, _, _ in _TO for c in (n, f"{n}_value")]
    return f"WITH d AS MATERIALIZED ({rel}), {made}, {back} SELECT k, w, {', '.join(names)} FROM d {joins} {' '.join(f'JOIN b_{n} USING (k)' for n, _, _ in _TO)}"


def _doubles(spark, sf, x) -> DataFrame:
    df = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.expr("cast(2 + event_id % 31 as int)").alias("w"), x.alias("x"))
    df = df.select("k", "w", *(P.column("from_double", None, es)(F.expr(w), "x").alias(n) for n, w, es in _TO))
    return df.select("k", "w", *(n for n, _, _ in _TO), *(P.column("to_double", None, es)(F.expr(w), n).alias(f"{n}_value") for n, w, es in _TO))


@query(_doubles_sql("value"))
def posit_doubles(spark, sf):
    """Event values in every format, and back."""
    return _doubles(spark, sf, F.col("value"))


@query(_doubles_sql("CAST(CAST(value AS FLOAT) AS DOUBLE)"))
def posit_floats(spark, sf):
    return _doubles(spark, sf, F.col("value").cast("float").cast("double"))


def _quire_sql(width: int, es: int) -> str:
    """Rows of line items: sums of quantity * price less quantity^2, as an integer of units of the quire."""
    rel = X.of_double(X.of_double("SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey AS grp, l_quantity AS q, l_extendedprice / 4096 AS p FROM lineitem", "q", "x"), "p", "y")
    enc = X.encode(X.encode(rel, "x", "a", width, es), "y", "b", width, es)
    dec = X.decode(X.decode(f"SELECT k, grp, a, b FROM ({enc})", "a", "x", width, es), "b", "y", width, es)
    # Both factors as multiples of 2^-40, which is below every bit they have.
    fixed = lambda p: f"(CASE WHEN {p}z THEN 0 ELSE ({X.ONE} + {p}f) // {X.p2(f'20 - {p}s')} END)"
    total = f"SELECT grp, sum(u * v)::HUGEINT AS dot, sum(u * v - u * u)::HUGEINT AS less FROM (SELECT grp, {fixed('x')} AS u, {fixed('y')} AS v FROM ({dec})) GROUP BY grp"
    parts = X.of_integer(X.of_integer(f"SELECT *, abs(dot) AS d1, abs(less) AS d2, {width} AS w FROM ({total})", "d1", "x", "dot < 0"), "d2", "y", "less < 0")
    parts = f"SELECT * REPLACE (xs - 80 AS xs, ys - 80 AS ys) FROM ({parts})"
    out = X.encode(X.encode(parts, "x", "dot_posit", "w", es), "y", "less_posit", "w", es)
    negated = f"CASE WHEN less_posit = 0 THEN 0 ELSE {1 << width} - less_posit END"
    return f"SELECT grp, dot_posit, less_posit, CAST({negated} AS BIGINT) AS negated FROM ({out})"


def _quire(spark, sf, width: int) -> DataFrame:
    q = Quire(width)
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), P.column("from_double", width)("l_quantity").alias("a"), P.column("from_double", width)(F.col("l_extendedprice") / 4096).alias("b"))
    both = q.dot(li, ["grp"], "a", "b", "ab").join(q.dot(li, ["grp"], "a", "a", "aa"), "grp")
    return both.withColumn("less", q.merge(F.col("ab"), q.negate(F.col("aa")))).select("grp", q.to_posit(F.col("ab")).alias("dot_posit"), q.to_posit(F.col("less")).alias("less_posit"), q.to_posit(q.negate(F.col("less"))).alias("negated"))


@query(_quire_sql(8, 0))
def quire8_dot(spark, sf):
    """Exact sums of posit products by supplier, rounded once."""
    return _quire(spark, sf, 8)


@query(_quire_sql(16, 1))
def quire16_dot(spark, sf):
    return _quire(spark, sf, 16)


@query(_quire_sql(32, 2))
def quire32_dot(spark, sf):
    return _quire(spark, sf, 32)


def _quire_steps_sql(width: str, es: int) -> str:
    """c + a * b - b * c - a, rounded once, for patterns near one."""
    near = lambda c: f"(CAST(pow(2, w - 2) AS BIGINT) + ({c} % CAST(greatest(pow(2, w - 6), 1) AS BIGINT)) - CAST(floor(pow(2, w - 7)) AS BIGINT))"
    p = f"SELECT k, w, {near('a')} AS a, {near('b')} AS b, {near('c')} AS c FROM ({_patterns(4096, width)[1]})"
    d = X.decode(X.decode(X.decode(p, "a", "x", "w", es), "b", "y", "w", es), "c", "v", "w", es)
    fixed = lambda p: f"({X.ONE} + {p}f) // {X.p2(f'20 - {p}s')}"
    total = f"SELECT k, w, a, b, c, v1 * {X.p2(40)} + x1 * y1 - y1 * v1 - x1 * {X.p2(40)} AS n FROM (SELECT k, w, a, b, c, {fixed('x')} AS x1, {fixed('y')} AS y1, {fixed('v')} AS v1 FROM ({d}))"
    parts = X.of_integer(f"SELECT *, abs(n) AS size FROM ({total})", "size", "e", "n < 0")
    parts = f"SELECT * REPLACE (es - 80 AS es) FROM ({parts})"
    return f"SELECT k, w, a, b, c, posit FROM ({X.encode(parts, 'e', 'posit', 'w', es)})"


def _quire_steps(spark, width: int, es: int) -> DataFrame:
    q = Quire(width, es)
    near = lambda c: (F.lit(1 << (width - 2)) + F.col(c) % F.lit(1 << (width - 6)) - F.lit(1 << (width - 7))).alias(c)
    p = _rows(spark, 4096, str(width)).select("k", "w", near("a"), near("b"), near("c"))
    a, b, c, one = F.col("a"), F.col("b"), F.col("c"), F.lit(1 << (width - 2))
    acc = q.subtract(q.subtract(q.add(q.of_posit(c), a, b), b, c), a, one)
    return p.select("k", "w", "a", "b", "c", q.to_posit(acc).alias("posit"))


@query(_quire_steps_sql("8", 0))
def quire8_steps(spark, sf):
    return _quire_steps(spark, 8, 0)


@query(_quire_steps_sql("16", 1))
def quire16_steps(spark, sf):
    return _quire_steps(spark, 16, 1)


@query(_quire_steps_sql("32", 2))
def quire32_steps(spark, sf):
    return _quire_steps(spark, 32, 2)


@query(_quire_steps_sql("20", 2))
def quirex2_steps(spark, sf):
    return _quire_steps(spark, 20, 2)


@query(f"SELECT k, w, a, lpad(bin(a), 16, '0') AS binary, '0x' || lpad(lower(printf('%x', a)), 4, '0') AS hex, a * 65536 AS aligned, (a + 1) % 65536 AS after, (a + 65535) % 65536 AS before FROM ({_patterns(4096, '16')[1]})")
def posit_prints(spark, sf):
    a = F.col("a")
    return _rows(spark, 4096, "16").select("k", "w", "a", P.binary_text(a, 16).alias("binary"), P.hex_text(a, 16).alias("hex"), P.left_aligned(a, 16).alias("aligned"), P.successor(a, 16).alias("after"), P.predecessor(a, 16).alias("before"))
