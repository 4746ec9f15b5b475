"""Exact accumulators: quires of posits, and sums of doubles.

A quire is a binary column: a big-endian two's complement fixed-point number
whose unit is the square of the smallest posit; 100...0 is NaR.  Products go in
without rounding, and one rounding makes a posit of it.

Sums over groups are distributed: every term becomes three 32-bit pieces at a
multiple of 32 bits, the pieces are summed as longs by (key, chunk) with partial
sums before the shuffle, and a key's few dozen chunk sums are put together at the
end.  So the order of rows doesn't matter and a hot key is no hot task."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import posit_arrays as A
from .posit import ES, decode_exact, encode_exact, nar

#: Bits of the quires of the standard widths; others have 512.
BITS = {8: 32, 16: 128, 32: 512}
#: Rows of a batch that are Python objects at a time.
ROWS = 256
_PIECES = "chunk long, lo long, mid long, hi long, odd long"


def unit(width: int, es: int) -> int:
    """The exponent of a quire's lowest bit."""
    return -2 * ((width - 2) << es)


def in_parts(*columns: pa.Array):
    """The columns' values as lists, ROWS rows at a time, whatever the batch's size."""
    for lo in range(0, len(columns[0]), ROWS):
        yield [c.slice(lo, ROWS).to_pylist() for c in columns]


class Quire:
    """Functions on columns of one quire format."""

    def __init__(self, width: int, es: int | None = None):
        self.width, self.es = width, ES[width] if es is None else es
        self.bits, self.low = BITS.get(width, 512), unit(width, ES[width] if es is None else es)

    # one value

    def to_bytes(self, n: int | None) -> bytes:
        """n units (None for NaR); what overflows is cut, as in a register."""
        n = 1 << (self.bits - 1) if n is None else n % (1 << self.bits)
        return n.to_bytes(self.bits // 8, "big")

    def from_bytes(self, raw: bytes) -> int | None:
        n = int.from_bytes(raw, "big", signed=True)
        return None if n == -(1 << (self.bits - 1)) else n

    def units(self, a: int, b: int | None = None) -> int | None:
        """a, or a * b, in units."""
        x = decode_exact(int(a), self.width, self.es)
        y = Fraction(1) if b is None else decode_exact(int(b), self.width, self.es)
        if x is None or y is None:
            return None
        scaled = x * y / Fraction(2) ** self.low
        return scaled.numerator // scaled.denominator

    def round(self, n: int | None) -> int:
        return nar(self.width) if n is None else encode_exact(n * Fraction(2) ** self.low, self.width, self.es)

    # columns

    def zero(self) -> Column:
        return F.lit(bytearray(self.bits // 8))

    def _map(self, kind: str, f):
        @F.arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            to, out = pa.binary() if kind == "binary" else pa.int64(), []
            for part in in_parts(*columns):
                out.append(pa.array([None if None in row else f(*row) for row in zip(*part, strict=True)], to))
            return pa.concat_arrays(out or [pa.array([], to)])

        return run

    def add(self, quire: Column, a: Column, b: Column) -> Column:
        """quire + a * b, exactly."""
        return self._map("binary", lambda q, x, y: self._plus(q, self.units(x, y)))(quire, a, b)

    def subtract(self, quire: Column, a: Column, b: Column) -> Column:
        """quire - a * b, exactly."""

        def step(q, x, y):
            n = self.units(x, y)
            return self._plus(q, None if n is None else -n)

        return self._map("binary", step)(quire, a, b)

    def merge(self, one: Column, other: Column) -> Column:
        return self._map("binary", lambda q, r: self._plus(q, self.from_bytes(r)))(one, other)

    def _plus(self, raw: bytes, n: int | None) -> bytes:
        q = self.from_bytes(raw)
        return self.to_bytes(None if q is None or n is None else q + n)

    def negate(self, quire: Column) -> Column:
        def step(q):
            n = self.from_bytes(q)
            return self.to_bytes(None if n is None else -n)

        return self._map("binary", step)(quire)

    def of_posit(self, a: Column) -> Column:
        return self._map("binary", lambda x: self.to_bytes(self.units(x)))(a)

    def to_posit(self, quire: Column) -> Column:
        return self._map("long", lambda q: self.round(self.from_bytes(q)))(quire)

    # groups

    def dot(self, df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "quire") -> DataFrame:
        """(keys, quire): the exact sum of products of each group; null pairs are left out."""
        width, es, low = self.width, self.es, self.low

        @F.arrow_udf(_PIECES)
        def pieces(x: pa.Array, y: pa.Array) -> pa.Array:
            chunk, lo, mid, hi, odd = A.product_chunks(x.cast(pa.int64()).to_numpy(zero_copy_only=False), y.cast(pa.int64()).to_numpy(zero_copy_only=False), width, es, low)
            return _pieces(chunk, lo, mid, hi, odd)

        def finish(n: int, odd: int) -> bytes:
            return self.to_bytes(None if odd else n)

        return _sum_pieces(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, pieces(F.col(a), F.col(b)), finish, pa.binary(), name)


def _pieces(chunk, lo, mid, hi, odd) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (chunk, lo, mid, hi, odd)], ["chunk", "lo", "mid", "hi", "odd"])


def _sum_pieces(df: DataFrame, keys: Sequence[str], piece: Column, finish, kind: pa.DataType, name: str) -> DataFrame:
    sums = [F.sum(f"_p.{c}").alias(c) for c in ("lo", "mid", "hi", "odd")]
    per = df.select(*keys, piece.alias("_p")).groupBy(*keys, F.col("_p.chunk").alias("chunk")).agg(*sums)
    few = per.groupBy(*keys).agg(F.collect_list(F.struct("chunk", "lo", "mid", "hi", "odd")).alias("_all"))  # at most 66 chunks a key

    @F.arrow_udf("binary" if pa.types.is_binary(kind) else "double")
    def whole(groups: pa.Array) -> pa.Array:
        out = []
        for group in (g for (part,) in in_parts(groups) for g in part):
            n = sum((g["lo"] + (g["mid"] << 32) + (g["hi"] << 64)) << 32 * g["chunk"] for g in group)
            out.append(finish(n, sum(g["odd"] for g in group)))
        return pa.array(out, kind)

    return few.select(*keys, whole("_all").alias(name))


# --------------------------------------------------------------------------- doubles

#: The exponent of the least double.
_LEAST = -1074


def exact_sums(df: DataFrame, keys: Sequence[str], value: str, name: str = "sum") -> DataFrame:
    """(keys, sum): the correctly rounded sum of each group's doubles, in any order.

    Nulls are left out.  Infinities and NaNs give what adding them gives."""

    @F.arrow_udf(_PIECES)
    def pieces(x: pa.Array) -> pa.Array:
        x = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        fine = np.isfinite(x)
        m, e = np.frexp(np.where(fine, np.abs(x), 0.0))
        zero = m == 0
        parts = A.Parts(np.signbit(x) & fine, e.astype(np.int64) - 1, (m * 2.0**53).astype(np.uint64) << np.uint64(10), zero, zero, np.zeros(len(x), bool))
        chunk, lo, mid, hi = A.chunks(parts, _LEAST)
        chunk = np.where(fine, chunk, np.where(np.isnan(x), -3, np.where(x > 0, -1, -2)))  # what isn't finite has chunks of its own
        return _pieces(chunk, np.where(fine, lo, 0), np.where(fine, mid, 0), np.where(fine, hi, 0), np.where(fine, 0, 1))

    per = df.where(F.col(value).isNotNull()).select(*keys, pieces(F.col(value)).alias("_p")).groupBy(*keys, F.col("_p.chunk").alias("chunk")).agg(*(F.sum(f"_p.{c}").alias(c) for c in ("lo", "mid", "hi")))
    few = per.groupBy(*keys).agg(F.collect_list(F.struct("chunk", "lo", "mid", "hi")).alias("_all"))

    @F.arrow_udf("double")
    def whole(groups: pa.Array) -> pa.Array:
        out = []
        for group in (g for (part,) in in_parts(groups) for g in part):
            odd = {g["chunk"] for g in group if g["chunk"] < 0}
            n = sum((g["lo"] + (g["mid"] << 32) + (g["hi"] << 64)) << 32 * g["chunk"] for g in group if g["chunk"] >= 0)
            if -3 in odd or {-1, -2} <= odd:
                out.append(float("nan"))
            elif odd:
                out.append(float("inf") if -1 in odd else float("-inf"))
            else:
                try:
                    out.append(n / (1 << -_LEAST))  # one rounding
                except OverflowError:
                    out.append(float("inf") if n > 0 else float("-inf"))
        return pa.array(out, pa.float64())

    return few.select(*keys, whole("_all").alias(name))


def exact_dots(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "dot") -> DataFrame:
    """(keys, dot): the correctly rounded sum of products of doubles.

    A product is split into its rounded value and its error, both exact (factors
    between 2^-480 and 2^480), so the sum of both is exact."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    half = lambda v: v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)  # noqa: E731  the upper 26 bits
    xh, yh = half(x), half(y)
    xl, yl = x - xh, y - yh
    p = x * y
    error = ((xh * yh - p) + xh * yl + xl * yh) + xl * yl
    terms = df.where(x.isNotNull() & y.isNotNull()).select(*keys, F.explode(F.array(p, error)).alias("_term"))
    return exact_sums(terms, keys, "_term", name)
