"""Long transforms in short steps against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeberg.functions import signal as S


def frame(spark, x):
    return spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(x)], "t long, re double, im double").repartition(3)


def values(df, n, at="k"):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r[at]] = complex(r.re, r.im)
    return out


@pytest.mark.parametrize("n, first", [(1, None), (7, None), (60, None), (64, 4), (360, 20)])
def test_four_steps(spark, n, first):
    x = np.random.default_rng(n).normal(size=n) + 1j * np.random.default_rng(n + 1).normal(size=n)
    there = S.fft_long(frame(spark, x), n, first=first)
    assert np.allclose(values(there, n), np.fft.fft(x))
    assert np.allclose(values(S.fft_long(frame(spark, x), n, inverse=True, first=first), n), np.fft.ifft(x))


def test_missing_and_repeated_places(spark):
    df = spark.createDataFrame([(3, 1.0, 0.0), (3, 1.0, 0.5), (10, -2.0, 0.0)], "t long, re double, im double")
    x = np.zeros(12, complex)
    x[3], x[10] = 2 + 0.5j, -2
    assert np.allclose(values(S.fft_long(df, 12), 12), np.fft.fft(x))
    with pytest.raises(ValueError):
        S.fft_long(df, 12, first=5)


def test_two_dimensions(spark):
    x = np.random.default_rng(3).normal(size=(6, 10))
    df = spark.createDataFrame([(i, j, float(v), 0.0) for (i, j), v in np.ndenumerate(x)], "i long, j long, re double, im double")
    out = np.zeros((6, 10), complex)
    for r in S.fft_image(df, 6, 10).collect():
        out[r.i, r.j] = complex(r.re, r.im)
    assert np.allclose(out, np.fft.fft2(x))


def test_long_kernels(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=48), rng.normal(size=48)
    df = lambda x: spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, v double")
    got = {r.k: r.v for r in S.convolve_long(df(a), df(b), 48).collect()}
    want = [sum(a[j] * b[(k - j) % 48] for j in range(48)) for k in range(48)]
    assert [got[k] for k in range(48)] == pytest.approx(want)


def test_the_transform_of_a_short_kernel_is_not_broadcast(spark):
    """A kernel of three rows has a transform as long as the signal."""
    n = 64
    signal = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 5 * 1.0).alias("v"))
    kernel = spark.createDataFrame([(0, 3.0), (1, -1.0), (5, 2.0)], "k long, v double")
    out = S.convolve_long(signal, kernel, n)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {k: 3.0 * (k % 5) - (k - 1) % n % 5 + 2.0 * ((k - 5) % n % 5) for k in range(n)}
    assert {r.k: r.v for r in out.collect()} == pytest.approx(want)
