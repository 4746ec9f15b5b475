"""Signal transforms and codes."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .quire import exact_sums


def dft(signal: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(k, re, im) of signal (t, x): the transform as a join with its kernel.

    Any length; the kernel of n frequencies is generated, not stored."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    rows = signal.select("t", "x", k)
    angle = (1 if inverse else -1) * 2 * math.pi * F.pmod(F.col("t") * F.col("k"), F.lit(n)) / n
    out = rows.groupBy("k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return out.select("k", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im")) if inverse else out


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def fft(signals: DataFrame, inverse: bool = False) -> DataFrame:
    """(g, k, re, im) of every group's complex signal (g, t, re, im); lengths are powers of two."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("t")
        if not power_of_two(len(x)):
            raise ValueError("the length isn't a power of two")
        y = (np.fft.ifft if inverse else np.fft.fft)(x.re.to_numpy() + 1j * x.im.to_numpy())
        return pd.DataFrame({"g": x.g.iloc[0], "k": np.arange(len(y)), "re": y.real, "im": y.imag})

    return signals.groupBy("g").applyInPandas(one, "g long, k long, re double, im double")


def near_root(n: int) -> int:
    """The largest divisor of n up to its root."""
    return next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)


def _short_transforms(cells: DataFrame, size: int, inverse: bool, number, twiddle: int = 0) -> DataFrame:
    """(g, at, re, im): every group's transform of ``size`` places, each result at the place that ``number`` gives; with
    ``twiddle`` (the whole length) turned by group times place.  Places without a row are 0, rows at one place are added."""
    sign = 1 if inverse else -1

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g, x, k = int(part.g.iloc[0]), np.zeros(size, complex), np.arange(size)
        np.add.at(x, part["at"].to_numpy(), part.re.to_numpy() + 1j * part.im.to_numpy())
        y = np.fft.ifft(x) * size if inverse else np.fft.fft(x)
        if twiddle:
            y *= np.exp(sign * 2j * np.pi * (k * g % twiddle) / twiddle)
        to, at = number(g, k)
        return pd.DataFrame({"g": to, "at": at, "re": y.real, "im": y.imag})

    return cells.groupBy("g").applyInPandas(one, "g long, at long, re double, im double")


def fft_long(signal: DataFrame, n: int, inverse: bool = False, first: int | None = None) -> DataFrame:
    """(k, re, im) of one long complex signal (t, re, im) of length n, in four steps: short transforms by column, a
    turn of each result, a transposition by the shuffle, short transforms by row.

    With ``first`` columns' places (the divisor of n next to its root if not given) no task holds more than
    ``first`` or n / ``first`` places at once, so n should have a divisor near its root, as powers of two do."""
    a = first or near_root(n)
    b = n // a
    if a * b != n:
        raise ValueError("the first length must divide the whole")
    cells = signal.select((F.col("t") % b).alias("g"), F.floor(F.col("t") / b).alias("at"), "re", "im")
    turned = _short_transforms(cells, a, inverse, lambda g, k: (k, np.full(len(k), g)), n)
    out = _short_transforms(turned, b, inverse, lambda g, k: (g + a * k, np.zeros(len(k), np.int64)))
    scale = 1.0 / n if inverse else 1.0
    return out.select(F.col("g").alias("k"), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def fft_image(image: DataFrame, rows: int, cols: int, inverse: bool = False) -> DataFrame:
    """(i, j, re, im) of an image (i, j, re, im): transforms of all rows, then of all columns."""
    by_row = _short_transforms(image.select(F.col("i").alias("g"), F.col("j").alias("at"), "re", "im"), cols, inverse, lambda g, k: (k, np.full(len(k), g)))
    by_column = _short_transforms(by_row, rows, inverse, lambda g, k: (np.full(len(k), g), k))
    scale = 1.0 / (rows * cols) if inverse else 1.0
    return by_column.select(F.col("at").alias("i"), F.col("g").alias("j"), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def convolve_long(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(k, v): circular convolution of two signals (k, v) of length n, both as long as they like."""
    x, y = (fft_long(s.select(F.col("k").alias("t"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), n) for s in (a, b))
    y = y.select("k", F.col("re").alias("_re"), F.col("im").alias("_im"))
    # The planner takes the transform of a short kernel for a short table; it has n rows, so it is never broadcast.
    both = x.join(y.hint("merge"), "k").select(F.col("k").alias("t"), (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))
    return fft_long(both, n, inverse=True).select("k", F.col("re").alias("v"))


def _small(kernel: DataFrame) -> DataFrame:
    if kernel.limit(1_000_001).count() > 1_000_000:
        raise ValueError("use convolve_fft for kernels of over a million entries")
    return F.broadcast(kernel)


def convolve(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(k, v): circular convolution of a (k, v) and a short kernel b (k, v) of length n.

    The kernel's size is checked before it is broadcast."""
    kernel = _small(b.select(F.col("k").alias("_k"), F.col("v").alias("_v")))
    return a.crossJoin(kernel).groupBy(F.pmod(F.col("k") + F.col("_k"), F.lit(n)).alias("k")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def convolve_2d(a: DataFrame, b: DataFrame, rows: int, cols: int) -> DataFrame:
    """(i, j, v): 2-D circular convolution with a broadcast kernel (i, j, v)."""
    kernel = _small(b.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v")))
    return a.crossJoin(kernel).groupBy(F.pmod(F.col("i") + F.col("_i"), F.lit(rows)).alias("i"), F.pmod(F.col("j") + F.col("_j"), F.lit(cols)).alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def _grid(part: pd.DataFrame, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols))
    out[part.i, part.j] = part.v
    return out


def _by_fft(f):
    def apply(a: DataFrame, b: DataFrame, rows: int, cols: int) -> DataFrame:
        def one(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out = np.fft.ifft2(f(np.fft.fft2(_grid(x, rows, cols)), np.fft.fft2(_grid(y, rows, cols)))).real
            i, j = np.indices((rows, cols))
            return pd.DataFrame({"g": x.g.iloc[0], "i": i.ravel(), "j": j.ravel(), "v": out.ravel()})

        return a.groupBy("g").cogroup(b.groupBy("g")).applyInPandas(one, "g long, i long, j long, v double")

    return apply


#: 2-D circular convolution of each group's pair of grids (g, i, j, v), by FFT.
convolve_fft = _by_fft(lambda x, y: x * y)
#: Phase correlation: the peak of the result is the shift between the grids.
correlate_fft = _by_fft(lambda x, y: (p := x * np.conj(y)) / np.maximum(np.abs(p), 1e-300))


def fft_2d(grids: DataFrame, rows: int, cols: int, inverse: bool = False) -> DataFrame:
    """(g, i, j, re, im) of every group's grid (g, i, j, v and, if there, w for the imaginary part)."""

    def one(x: pd.DataFrame) -> pd.DataFrame:
        grid = _grid(x, rows, cols).astype(complex)
        if "w" in x:
            grid[x.i, x.j] += 1j * x.w.to_numpy()
        out = (np.fft.ifft2 if inverse else np.fft.fft2)(grid)
        i, j = np.indices((rows, cols))
        return pd.DataFrame({"g": x.g.iloc[0], "i": i.ravel(), "j": j.ravel(), "re": out.real.ravel(), "im": out.imag.ravel()})

    return grids.groupBy("g").applyInPandas(one, "g long, i long, j long, re double, im double")


def huffman_lengths(frequencies: dict[str, int]) -> dict[str, int]:
    """Code length of each symbol; ties join the symbols seen first."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(frequencies.items()))]
    heapq.heapify(heap)
    out = dict.fromkeys(frequencies, 0 if len(frequencies) > 1 else 1)
    tick = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            out[s] += 1
        heapq.heappush(heap, (n + m, tick, a + b))
        tick += 1
    return out


def huffman_codes(frequencies: dict[str, int]) -> dict[str, str]:
    """Canonical prefix codes for the lengths."""
    out, code, before = {}, 0, 0
    for s, n in sorted(huffman_lengths(frequencies).items(), key=lambda x: (x[1], x[0])):
        code <<= n - before
        out[s], code, before = format(code, f"0{n}b"), code + 1, n
    return out


def gray_encode(n: Column) -> Column:
    return n.bitwiseXOR(F.shiftright(n, 1))


def gray_decode(g: Column, bits: int = 64) -> Column:
    step = 1
    while step < bits:
        g = g.bitwiseXOR(F.shiftrightunsigned(g, step))
        step *= 2
    return g


def to_binary(n: Column, width: int) -> Column:
    return F.lpad(F.bin(n), width, "0")


def arc_length(spark, n: int, exact: bool = False) -> DataFrame:
    """Length of an irregular curve on [0, pi] from n chords.

    The curve is x plus sines of doubling frequency and halving height.  ``exact``:
    the chords are summed exactly and rounded once, where a plain sum drifts."""
    h = math.pi / n
    curve = lambda x: x + sum((F.sin((1 << k) * x) / (1 << k) for k in range(1, 11)), F.lit(0.0))
    t = (F.col("id") + 1) * h
    rise = curve(t) - curve(t - h)
    chords = spark.range(n).select(F.lit(0).alias("k"), F.sqrt(F.lit(h * h) + rise**2).alias("c"))
    return exact_sums(chords, ["k"], "c", "s").select("s") if exact else chords.agg(F.sum("c").alias("s"))
