from fractions import Fraction

import __spark_entry__
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from floeberg.functions import posit as P, signal as S

#: Decimal, 8-bit, 16-bit and 32-bit patterns.
GOLDEN = [
    ("1", 0x40, 0x4000, 0x40000000), ("-2", 0xA0, 0xB000, 0xB8000000), ("1.5", 0x50, 0x4800, 0x44000000), ("123", 0x7F, 0x79D8, 0x6BB00000), ("436", 0x7F, 0x7CB4, 0x71680000),
    ("0.0032", 0x01, 0x03A3, 0x0F46DC5D), ("35", 0x7E, 0x7460, 0x64600000), ("-12", 0x86, 0x9400, 0xA4000000), ("0.05", 0x03, 0x0E66, 0x1E666666), ("94.5786", 0x7F, 0x78F5, 0x69E941F2), ("7.3", 0x77, 0x669A, 0x5699999A),
]


@pytest.mark.parametrize("text,p8,p16,p32", GOLDEN)
def test_encode(text, p8, p16, p32):
    assert [P.from_decimal(text, w, P.ES[w]) for w in (8, 16, 32)] == [p8, p16, p32]


@pytest.mark.parametrize("width,es", [(8, 0), (16, 1), (9, 2), (5, 1)])
def test_round_trip(width, es):
    assert all(P.encode_exact(P.decode_exact(b, width, es), width, es) == b for b in range(1 << width))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 32) - 1), st.integers(0, (1 << 32) - 1))
def test_arithmetic_rounds_once(a, b):
    x, y = P.decode_exact(a, 32, 2), P.decode_exact(b, 32, 2)
    if x is None or y is None:
        assert P.add(a, b, 32, 2) == P.nar(32)
        return
    assert P.add(a, b, 32, 2) == P.encode_exact(x + y, 32, 2) == P.add(b, a, 32, 2)
    assert P.fused(a, b, 0, 32, 2) == P.multiply(a, b, 32, 2)
    if y:
        assert P.divide(P.multiply(a, 1 << 30, 32, 2), 1 << 30, 32, 2) == a
    assert P.subtract(a, a, 32, 2) == 0


def test_special_values():
    assert P.divide(0x4000, 0, 16, 1) == P.nar(16) and P.square_root(0xC000, 16, 1) == P.nar(16)
    assert P.square_root(P.from_integer(9, 16, 1), 16, 1) == P.from_integer(3, 16, 1)
    assert P.to_integer(P.from_decimal("2.5", 16, 1), 16, 1) == 2 and P.to_integer(P.from_decimal("-2.75", 16, 1), 16, 1, truncate=True) == -2
    assert P.encode_exact(Fraction(10) ** 30, 8, 0) == 0x7F and P.encode_exact(Fraction(1, 10**30), 8, 0) == 1
    assert P.quire_dot([0x40, 0x40, 0x80 + 1], [0x7F, 0x01, 0x40], 8, 0) == P.encode_exact(Fraction(64) + Fraction(1, 64) - 64, 8, 0)


def test_columns(spark):
    rows = spark.range(1 << 8).select("id", P.decode(F.col("id"), 8).alias("x"), P.column("add", 8)("id", F.lit(0x40)).alias("plus"), P.negate(F.col("id"), 8).alias("minus")).collect()
    for r in rows:
        x = P.decode_exact(r.id, 8, 0)
        assert r.x == (None if x is None else float(x)) and r.plus == P.add(r.id, 0x40, 8, 0)
        assert x is None or P.decode_exact(r.minus, 8, 0) == -x
    assert spark.sql("select 1.1D as v").select(P.half(F.col("v"))).first()[0] == float(np.float16(1.1))
    dot = spark.createDataFrame([(0x40, 0x50)] * 4, "a long, b long").agg(P.quire(8)("a", "b")).first()[0]
    assert dot == P.encode_exact(Fraction(6), 8, 0)


def test_signals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=16)
    d = spark.createDataFrame([(0, i, float(v), 0.0) for i, v in enumerate(x)], "g long, t long, re double, im double")
    got = S.fft(d).orderBy("k").collect()
    assert np.allclose([complex(r.re, r.im) for r in got], np.fft.fft(x))
    back = S.dft(d.select("t", F.col("re").alias("x")), 16).orderBy("k").collect()
    assert np.allclose([complex(r.re, r.im) for r in back], np.fft.fft(x))
    a, b = rng.integers(0, 5, (4, 4)), np.zeros((4, 4))
    b[1, 2] = 1
    rows = lambda m: spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(4) for j in range(4)], "g long, i long, j long, v double")
    shifted = {(r.i, r.j): round(r.v, 6) for r in S.convolve_fft(rows(a), rows(b), 4, 4).collect()}
    assert shifted == {(i, j): a[i - 1, j - 2] for i in range(4) for j in range(4)}
    peak = max(S.correlate_fft(rows(np.roll(a, (1, 2), (0, 1))), rows(a), 4, 4).collect(), key=lambda r: r.v)
    assert (peak.i, peak.j) == (1, 2)


def test_codes():
    lengths = S.huffman_lengths({"a": 5, "b": 9, "c": 12, "d": 13, "e": 16, "f": 45})
    assert lengths == {"a": 4, "b": 4, "c": 3, "d": 3, "e": 3, "f": 1}
    codes = S.huffman_codes({"a": 5, "b": 9, "c": 12})
    assert all(not y.startswith(x) for s, x in codes.items() for t, y in codes.items() if s != t)


def test_gray_and_arc(spark):
    g = [r[0] for r in spark.range(8).select(S.gray_encode(F.col("id"))).collect()]
    assert g == [0, 1, 3, 2, 6, 7, 5, 4]
    assert S.arc_length(spark, 1000).first()[0] == pytest.approx(6.866909521655, abs=1e-9)


def test_other_layouts():
    #: Recorded strings of the fixed-regime layout.
    assert P.encode_fixed_regime(Fraction(123)) == "01100001011101100000000000000000"
    assert P.encode_fixed_regime(Fraction(436)) == "01110000010110100000000000000000"
    for a, b in ((123, 436), (8745, 34), (-12, -6), (235, 43), (78, 34), (1334, 443), (-1256, -23)):
        x, y = P.encode_fixed_regime(Fraction(a)), P.encode_fixed_regime(Fraction(b))
        assert P.decode_fixed_regime(P.fixed_regime("add", x, y)) == a + b and P.decode_fixed_regime(P.fixed_regime("subtract", x, y)) == a - b
    for v in (Fraction(-3, 2), Fraction(0), Fraction(100)):
        assert P.decode_sign_magnitude(P.encode_sign_magnitude(v, 32, 2), 32, 2) == v


def test_clock_of_message_passing():
    from floeberg.operators.messages import cannon_clock

    one = cannon_clock([[5]], [[4]])
    assert one["finish"] == 20 and one["messages"] == 0
    four = cannon_clock([[1, 1], [1, 1]], [[1, 1], [1, 1]])
    assert four["messages"] == 8 and four["finish"] > 20


#: Formats (width, exponent bits) whose whole columns are compared with exact fractions.
FORMATS = [(8, 0), (16, 1), (32, 2), (2, 1), (5, 1), (13, 2), (24, 2), (31, 1)]


@pytest.mark.parametrize("width,es", FORMATS)
def test_arrays_equal_the_fractions(width, es):
    rng = np.random.default_rng(width)
    shift = rng.integers(0, width, 900)
    a = (rng.integers(0, 1 << width, 900) >> shift) * rng.choice([1, -1], 900) % (1 << width)
    b, c = rng.permutation(a), rng.permutation(a)
    b[::3] = (-(a[::3] + rng.integers(-2, 3, 300))) % (1 << width)
    a[:4], b[1:4] = [0, 1 << (width - 1), 1, (1 << (width - 1)) - 1], 0
    for name, one in (("add", P.add), ("subtract", P.subtract), ("multiply", P.multiply), ("divide", P.divide)):
        assert P._OPS[name](a, b, width, es).tolist() == [one(int(x), int(y), width, es) for x, y in zip(a, b, strict=True)]
    c[::2] = (-P._OPS["multiply"](a, b, width, es)[::2]) % (1 << width)
    assert P._OPS["fused"](a, b, c, width, es).tolist() == [P.fused(*map(int, v), width, es) for v in zip(a, b, c, strict=True)]
    for name, one in (("sqrt", P.square_root), ("round", P.round_to_integer)):
        assert P._OPS[name](a, width, es).tolist() == [one(int(x), width, es) for x in a]
    for bits in (32, 64):
        for signed in (True, False):
            low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
            for cut in (False, True):
                want = [P.to_integer(int(x), width, es, cut, low, high) for x in a]
                assert [v % (1 << 64) for v in P._OPS["to_integer"](a, width, es, bits, signed, cut).tolist()] == [v % (1 << 64) for v in want]
    n = np.concatenate([[0, 1, -1, (1 << 63) - 1, -(1 << 63)], rng.integers(-(1 << 62), 1 << 62, 200) >> rng.integers(0, 62, 200)])
    assert P._OPS["from_integer"](n, width, es).tolist() == [P.from_integer(int(x), width, es) for x in n]
    assert P._OPS["from_integer"](n, width, es, True).tolist() == [P.from_integer(int(x) % (1 << 64), width, es) for x in n]
    x = np.concatenate([[0.0, -0.0, np.nan, np.inf, 5e-324, 1e300], rng.normal(size=300) * 10.0 ** rng.integers(-40, 40, 300)])
    assert P._OPS["from_double"](x, width, es).tolist() == [P.from_double(float(v), width, es) for v in x]
    assert all(g == P.to_double(int(v), width, es) or P.to_double(int(v), width, es) != g != g for g, v in zip(P._OPS["to_double"](a, width, es), a, strict=True))


def test_widths_that_differ_by_row(spark):
    rows = [(w, (977 * w + 5) % (1 << w), (313 * w) % (1 << w)) for w in range(2, 33)] + [(1, 1, 1), (40, 3, 3), (None, 1, 1), (8, None, 1)]
    df = spark.createDataFrame(rows, "w int, a long, b long")
    got = df.select("w", "a", "b", P.column("add", None, 1)("w", "a", "b").alias("s"), P.convert_column(None, 1, None, 2)("w", F.lit(16), "a").alias("c")).collect()
    for r in got:
        if r.w is None or r.a is None:
            assert r.s is None and r.c is None
        else:
            assert r.s == (P.add(r.a, r.b, r.w, 1)) and (not 2 <= r.w <= 32 or r.c == P.convert(r.a, r.w, 1, 16, 2))


def test_quires_as_values(spark):
    from floeberg.functions.quire import Quire, exact_dots, exact_sums

    rng = np.random.default_rng(4)
    for width in (8, 16, 32):
        q = Quire(width)
        rows = [(int(k % 3), int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, 1 << width, (60, 2))) if 1 << (width - 1) not in (a, b)]
        df = spark.createDataFrame(rows, "k long, a long, b long")
        sums = {r.k: (bytes(r.quire), r.p) for r in q.dot(df, ["k"], "a", "b").withColumn("p", q.to_posit(F.col("quire"))).collect()}
        for k in range(3):
            total = sum(P.decode_exact(a, width, q.es) * P.decode_exact(b, width, q.es) for j, a, b in rows if j == k)
            assert q.from_bytes(sums[k][0]) * Fraction(2) ** q.low == total and sums[k][1] == P.encode_exact(total, width, q.es)
        one = df.select("a", "b", q.subtract(q.add(q.zero(), F.col("a"), F.col("b")), F.col("b"), F.col("b")).alias("q"))
        for r in one.select("a", "b", "q", q.to_posit(q.negate(F.col("q"))).alias("m"), q.to_posit(q.merge(F.col("q"), q.negate(F.col("q")))).alias("z")).collect():
            x, y = (P.decode_exact(v, width, q.es) for v in (r.a, r.b))
            assert r.m == P.encode_exact(y * y - x * y, width, q.es) and r.z == 0
        odd = spark.createDataFrame([(1 << (width - 1), 1)], "a long, b long").select(q.to_posit(q.add(q.zero(), F.col("a"), F.col("b"))).alias("p"))
        assert odd.first().p == P.nar(width)
    values = [(0, 1e308), (0, 1.0), (0, -1e308), (1, 5e-324), (1, 2.0**-60), (1, 1.0), (1, -1.0), (2, float("inf")), (3, float("inf")), (3, float("-inf")), (4, 1e308), (4, 1e308), (5, float("nan")), (5, None)]
    got = {r.k: r.s for r in exact_sums(spark.createDataFrame(values, "k long, x double"), ["k"], "x", "s").collect()}
    assert got[0] == 1.0 and got[1] == 2.0**-60 and got[2] == got[4] == float("inf") and got[3] != got[3] and got[5] != got[5]
    pairs = [(float(a), float(b)) for a, b in rng.normal(size=(200, 2)) * 10.0 ** rng.integers(-9, 9, (200, 2))]
    exact = float(sum(Fraction(a) * Fraction(b) for a, b in pairs))
    assert exact_dots(spark.createDataFrame([(0, *p) for p in pairs], "k long, a double, b double"), ["k"], "a", "b").first().dot == exact


def test_posit_operators(spark):
    x, y = P.Posit("a", 16), P.Posit("b", 16)
    a, b = P.from_double(2.5, 16, 1), P.from_double(-0.75, 16, 1)
    row = spark.createDataFrame([(a, b)], "a long, b long").select(
        (x + y).value().alias("add"), (x - y).value().alias("sub"), (x * y).value().alias("mul"), (x / 2).value().alias("div"), (-x).value().alias("neg"), abs(y).value().alias("abs"),
        (x < y).alias("lt"), (x >= y).alias("ge"), (x == x).alias("eq"), x.fused(y, 1).value().alias("fma"), x.next().bits.alias("next"), x.previous().bits.alias("prev"),
        ((x << 1) >> 1).bits.alias("shift"), (~x).bits.alias("inv"), ((x & y) | (x ^ y)).bits.alias("bits"), P.Posit.of(F.lit(4.0), 16).sqrt().value().alias("root"), P.Posit.of(F.lit(0.0), 16).cos().value().alias("cos"),
    ).first()
    assert row[:10] == (1.75, 3.25, -1.875, 1.25, -2.5, 0.75, False, True, True, -0.875)
    assert row[10:] == (a + 1, a - 1, (a << 1 & 0xFFFF) >> 1, 0xFFFF - a, a | b, 2.0, 1.0)


def test_quires_hold_few_rows_as_objects(monkeypatch):
    """A batch of any size becomes Python objects 256 rows at a time."""
    import pyarrow as pa

    from floeberg.functions import quire as Q

    parts = list(Q.in_parts(pa.array(range(1000)), pa.array([None] * 1000, pa.int64())))
    assert [len(a) for a, _ in parts] == [256, 256, 256, 232] and [x for a, _ in parts for x in a] == list(range(1000))
    assert not list(Q.in_parts(pa.array([], pa.int64())))


def test_many_groups_of_exact_sums(spark):
    from floeberg.functions import quire as Q

    df = spark.range(2000).select((F.col("id") % 700).alias("k"), (F.col("id") * 0.1).alias("v"))
    want = {}
    for k in range(2000):
        want.setdefault(k % 700, []).append(k * 0.1)
    import math

    assert {r.k: r.s for r in Q.exact_sums(df, ["k"], "v", "s").collect()} == {k: math.fsum(v) for k, v in want.items()}


def test_prices_go_to_python_once(spark):
    """posit32_encode: the rows that wait for Python hold the price and its argument, not a copy for each use of the pattern."""
    plan = __spark_entry__.queries()["posit32_encode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    after = plan[plan.index("ArrowEvalPython") :].splitlines()[1]
    assert 1 <= after.count("l_extendedprice#") <= 4
