"""Posit numbers as columns of bit patterns.

Comparison, fields and decoding are plain column expressions.  Encoding and
arithmetic are exact: operands become integer significands times powers of
two, one integer result is formed, and it is rounded once, to the nearest bit
pattern, ties to even; nothing overflows to NaR or underflows to zero.  On columns
they run as Arrow functions over whole numpy arrays (posit_arrays); the functions
on single values go through exact fractions and are what these are tested with."""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import posit_arrays as A

#: Exponent bits of the standard widths.
ES = {8: 0, 16: 1, 32: 2}


def nar(width: int) -> int:
    return 1 << (width - 1)


# --------------------------------------------------------------- exact, one value


def decode_exact(bits: int, width: int, es: int) -> Fraction | None:
    """The value of a bit pattern; None for NaR."""
    bits &= (1 << width) - 1
    if bits == 0:
        return Fraction(0)
    if bits == nar(width):
        return None
    sign = bits >> (width - 1)
    if sign:
        bits = (1 << width) - bits
    body = format(bits, f"0{width}b")[1:]
    run = len(body) - len(body.lstrip(body[0]))
    k = run - 1 if body[0] == "1" else -run
    rest = body[run + 1 :]
    exponent = int((rest[:es] + "0" * es)[:es] or "0", 2)
    fraction = rest[es:]
    significand = Fraction(int("1" + fraction, 2), 1 << len(fraction))
    scale = (k << es) + exponent
    value = significand * (Fraction(2) ** scale)
    return -value if sign else value


def encode_exact(x: Fraction | None, width: int, es: int, sticky: bool = False) -> int:
    """The nearest posit, ties to the even pattern; ``sticky``: x is a little larger in magnitude."""
    if x is None:
        return nar(width)
    if x == 0:
        return 0
    sign, x = x < 0, abs(x)
    num, den = x.numerator, x.denominator
    scale = num.bit_length() - den.bit_length()
    if Fraction(num, den) < Fraction(2) ** scale:
        scale -= 1
    k, exponent = scale >> es, scale & ((1 << es) - 1)
    regime = [1] * (k + 1) + [0] if k >= 0 else [0] * -k + [1]
    if len(regime) > width:  # beyond the range: the largest or smallest magnitude
        bits = (1 << (width - 1)) - 1 if k >= 0 else 1
        return (1 << width) - bits if sign else bits
    pattern, used = 0, 0
    for b in regime:
        pattern, used = pattern << 1 | b, used + 1
    pattern, used = pattern << es | exponent, used + es
    # Fraction bits: enough for the width and one more, the rest is sticky.
    more = width + 2
    part = Fraction(num, den) / Fraction(2) ** scale - 1
    whole = part * (1 << more)
    digits = whole.numerator // whole.denominator
    tail = sticky or whole.denominator != 1
    pattern, used = pattern << more | digits, used + more
    drop = used - (width - 1)
    kept, cut = pattern >> drop, pattern & ((1 << drop) - 1)
    half = 1 << (drop - 1)
    if cut > half or (cut == half and (tail or kept & 1)):
        kept += 1
    kept = min(max(kept, 1), (1 << (width - 1)) - 1)
    return (1 << width) - kept if sign else kept


def _valid(width: int) -> bool:
    return 2 <= width <= 32


def _binary(f, width: int, es: int):
    def run(a: int, b: int) -> int:
        if not _valid(width):
            return nar(32)
        x, y = decode_exact(a, width, es), decode_exact(b, width, es)
        return nar(width) if x is None or y is None else encode_exact(f(x, y), width, es)

    return run


def add(a: int, b: int, width: int, es: int) -> int:
    return _binary(lambda x, y: x + y, width, es)(a, b)


def subtract(a: int, b: int, width: int, es: int) -> int:
    return _binary(lambda x, y: x - y, width, es)(a, b)


def multiply(a: int, b: int, width: int, es: int) -> int:
    return _binary(lambda x, y: x * y, width, es)(a, b)


def divide(a: int, b: int, width: int, es: int) -> int:
    return _binary(lambda x, y: None if y == 0 else x / y, width, es)(a, b)


def fused(a: int, b: int, c: int, width: int, es: int) -> int:
    """a * b + c with one rounding."""
    x, y, z = (decode_exact(v, width, es) for v in (a, b, c))
    return nar(width) if None in (x, y, z) else encode_exact(x * y + z, width, es)


def square_root(a: int, width: int, es: int) -> int:
    x = decode_exact(a, width, es)
    if x is None or x < 0:
        return nar(width)
    if x == 0:
        return 0
    shift = 2 * (width + 8)
    big = (x.numerator << 2 * shift) // x.denominator
    root = isqrt(big)
    exact = root * root == big and (x.numerator << 2 * shift) % x.denominator == 0
    return encode_exact(Fraction(root, 1 << shift), width, es, sticky=not exact)


def _even(x: Fraction) -> int:
    return round(x)  # Python rounds Fractions half to even


def round_to_integer(a: int, width: int, es: int) -> int:
    x = decode_exact(a, width, es)
    return nar(width) if x is None else encode_exact(Fraction(_even(x)), width, es)


def to_integer(a: int, width: int, es: int, truncate: bool = False, low: int = -(1 << 63), high: int = (1 << 63) - 1) -> int:
    """Nearest (or truncated) integer, held to [low, high]; NaR gives 0."""
    x = decode_exact(a, width, es)
    if x is None:
        return 0
    n = int(x) if truncate else _even(x)
    return min(max(n, low), high)


def from_integer(n: int, width: int, es: int) -> int:
    return encode_exact(Fraction(int(n)), width, es)


def convert(a: int, width: int, es: int, to_width: int, to_es: int) -> int:
    return encode_exact(decode_exact(a, width, es), to_width, to_es)


def from_double(x: float, width: int, es: int) -> int:
    return nar(width) if x != x or x in (float("inf"), float("-inf")) else encode_exact(Fraction(x), width, es)


def from_decimal(text: str, width: int, es: int) -> int:
    return encode_exact(Fraction(text), width, es)


def to_double(a: int, width: int, es: int) -> float:
    x = decode_exact(a, width, es)
    return float("nan") if x is None else float(x)


def quire_dot(xs, ys, width: int, es: int, start: Fraction = Fraction(0)) -> int:
    """Sum of products with one rounding at the end; NaR absorbs."""
    total = start
    for a, b in zip(xs, ys, strict=True):
        x, y = decode_exact(int(a), width, es), decode_exact(int(b), width, es)
        if x is None or y is None:
            return nar(width)
        total += x * y
    return encode_exact(total, width, es)


# ------------------------------------------------------------------- whole columns

_OPS = {
    "add": A.add, "subtract": A.subtract, "multiply": A.multiply, "divide": A.divide, "fused": A.fused, "fused_subtract": A.fused_subtract, "sqrt": A.square_root,
    "round": A.round_to_integer, "to_integer": A.to_integer, "from_integer": A.from_integer, "from_double": A.from_double, "to_double": A.to_double,
}


def _int64(a) -> np.ndarray:
    return a.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _filled(out: np.ndarray, columns) -> pa.Array:
    """out, null where any of the columns is."""
    gone = np.zeros(len(out), bool)
    for c in columns:
        if c.null_count:
            gone |= c.is_null().to_numpy(zero_copy_only=False)
    return pa.array(out, mask=gone)


def column(op: str, width: int | None = None, es: int | None = None, **options):
    """A column function: posit bits in, bits (or integers, or doubles) out, null for null.

    Without ``width`` the first argument is a column of widths (2 to 32, others
    give NaR) and ``es`` must be given.  Options are those of posit_arrays, such as
    bits, signed and truncate of to_integer, unsigned of from_integer."""
    es = ES[width] if es is None else es

    @F.arrow_udf("double" if op == "to_double" else "long")
    def run(*columns: pa.Array) -> pa.Array:
        values = [c.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) if op == "from_double" and k == len(columns) - 1 else _int64(c) for k, c in enumerate(columns)]
        size = values.pop(0) if width is None else width
        return _filled(_OPS[op](*values, size, es, **options), columns)

    return run


def convert_column(width: int | None, es: int, to_width: int | None, to_es: int):
    """Width changes; with None the widths are columns before the bits (from, then to)."""

    @F.arrow_udf("long")
    def run(*columns: pa.Array) -> pa.Array:
        values = [_int64(c) for c in columns]
        size = values.pop(0) if width is None else width
        to = values.pop(0) if to_width is None else to_width
        return _filled(A.convert(values[0], size, es, to, to_es), columns)

    return run


def unsigned(bits: Column) -> Column:
    """The number in a long that holds an unsigned 64-bit one."""
    return F.when(bits < 0, bits.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(bits.cast("decimal(20,0)")).cast("decimal(20,0)")


def as_long(number: Column) -> Column:
    """An unsigned 64-bit number (decimal) as the long with the same bits."""
    return F.when(number >= F.lit("9223372036854775808").cast("decimal(20,0)"), number - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(number).cast("long")


def from_decimal_column(width: int, es: int | None = None):
    """Exact encoding of decimals or decimal strings of any length."""
    es = ES[width] if es is None else es

    @F.arrow_udf("long")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else from_decimal(str(t), width, es) for t in text.to_pylist()], pa.int64())

    return run


def binary_text(bits: Column, width: int) -> Column:
    """All bits as 0 and 1."""
    return F.lpad(F.bin(bits), width, "0")


def hex_text(bits: Column, width: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(bits)), -(-width // 4), "0"))


def left_aligned(bits: Column, width: int) -> Column:
    """A short posit's bits in the upper end of 32, as some libraries keep them."""
    return F.shiftleft(bits.cast("long"), 32 - width)


def successor(bits: Column, width: int) -> Column:
    """The next larger posit's pattern (after the largest comes NaR)."""
    return F.pmod(bits.cast("long") + 1, F.lit(1 << width))


def predecessor(bits: Column, width: int) -> Column:
    return F.pmod(bits.cast("long") - 1, F.lit(1 << width))


class Posit:
    """A column of posits with operators: + - * /, unary -, abs, comparisons, and
    & | ^ ~ << >> on the bits.  Numbers on the right are encoded first."""

    def __init__(self, bits: Column | str, width: int = 32, es: int | None = None):
        self.bits = F.col(bits) if isinstance(bits, str) else bits
        self.width, self.es = width, ES[width] if es is None else es

    @classmethod
    def of(cls, value: Column, width: int = 32, es: int | None = None) -> Posit:
        es = ES[width] if es is None else es
        return cls(column("from_double", width, es)(value.cast("double")), width, es)

    def _new(self, bits: Column) -> Posit:
        return Posit(bits, self.width, self.es)

    def _other(self, other) -> Column:
        return other.bits if isinstance(other, Posit) else F.lit(from_double(float(other), self.width, self.es)).cast("long")

    def _op(self, name: str, *others) -> Posit:
        return self._new(column(name, self.width, self.es)(self.bits, *(self._other(o) for o in others)))

    def __add__(self, other):
        return self._op("add", other)

    def __sub__(self, other):
        return self._op("subtract", other)

    def __mul__(self, other):
        return self._op("multiply", other)

    def __truediv__(self, other):
        return self._op("divide", other)

    def __neg__(self):
        return self._new(negate(self.bits, self.width))

    def __abs__(self):
        return self._new(absolute(self.bits, self.width))

    def __lt__(self, other):
        return less(self.bits, self._other(other), self.width)

    def __le__(self, other):
        return less_equal(self.bits, self._other(other), self.width)

    def __gt__(self, other):
        return less(self._other(other), self.bits, self.width)

    def __ge__(self, other):
        return less_equal(self._other(other), self.bits, self.width)

    def __eq__(self, other):
        return self.bits == self._other(other)

    def __ne__(self, other):
        return self.bits != self._other(other)

    __hash__ = None

    def __and__(self, other):
        return self._new(self.bits.bitwiseAND(self._other(other)))

    def __or__(self, other):
        return self._new(self.bits.bitwiseOR(self._other(other)))

    def __xor__(self, other):
        return self._new(self.bits.bitwiseXOR(self._other(other)))

    def __invert__(self):
        return self._new(F.lit((1 << self.width) - 1) - self.bits)

    def __lshift__(self, by: int):
        return self._new(F.pmod(F.shiftleft(self.bits.cast("long"), by), F.lit(1 << self.width)))

    def __rshift__(self, by: int):
        return self._new(F.shiftright(self.bits.cast("long"), by))

    def fused(self, by, plus) -> Posit:
        """self * by + plus with one rounding."""
        return self._op("fused", by, plus)

    def sqrt(self) -> Posit:
        return self._op("sqrt")

    def sin(self) -> Posit:
        return Posit.of(F.sin(self.value()), self.width, self.es)

    def cos(self) -> Posit:
        return Posit.of(F.cos(self.value()), self.width, self.es)

    def next(self) -> Posit:
        return self._new(successor(self.bits, self.width))

    def previous(self) -> Posit:
        return self._new(predecessor(self.bits, self.width))

    def value(self) -> Column:
        """The number as a double; NaN for NaR."""
        return column("to_double", self.width, self.es)(self.bits)


def quire(width: int, es: int | None = None):
    """Grouped aggregate: exact dot product of two bit columns."""
    es = ES[width] if es is None else es

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> int:
        return quire_dot(a, b, width, es)

    return run


# ----------------------------------------------------------- pure column expressions


def signed(bits: Column, width: int) -> Column:
    """Bits as a two's complement number: the order of posits; NaR is least."""
    return F.when(bits >= (1 << (width - 1)), bits - (1 << width)).otherwise(bits).cast("long")


def less(a: Column, b: Column, width: int) -> Column:
    return signed(a, width) < signed(b, width)


def less_equal(a: Column, b: Column, width: int) -> Column:
    return signed(a, width) <= signed(b, width)


def equal(a: Column, b: Column) -> Column:
    return a == b


def negate(bits: Column, width: int) -> Column:
    return F.pmod(-bits.cast("long"), F.lit(1 << width))


def absolute(bits: Column, width: int) -> Column:
    return F.when(signed(bits, width) < 0, negate(bits, width)).otherwise(bits.cast("long"))


def _size(bits: Column, width: int) -> Column:
    return absolute(bits, width).bitwiseAND((1 << (width - 1)) - 1)


def run_length(bits: Column, width: int) -> Column:
    """How many equal bits the regime starts with."""
    body = _size(bits, width)
    ones = body >= (1 << (width - 2))
    flipped = F.when(ones, F.lit((1 << (width - 1)) - 1) - body).otherwise(body)
    return F.when(flipped == 0, F.lit(width - 1)).otherwise(F.lit(width - 1) - F.length(F.bin(flipped))).cast("int")


def regime(bits: Column, width: int) -> Column:
    n = run_length(bits, width)
    return F.when(_size(bits, width) >= (1 << (width - 2)), n - 1).otherwise(-n)


def fraction_bits(bits: Column, width: int, es: int) -> Column:
    return F.greatest(F.lit(width - 2) - run_length(bits, width) - es, F.lit(0))


def exponent(bits: Column, width: int, es: int) -> Column:
    """The exponent field; bits that the regime pushed out count as zero."""
    left = F.greatest(F.lit(width - 2) - run_length(bits, width), F.lit(0))
    if es == 0:
        return F.lit(0)
    rest = _size(bits, width) % F.pow(F.lit(2.0), left).cast("long")
    return F.when(left >= es, F.floor(rest / F.pow(F.lit(2.0), left - es))).otherwise(F.floor(rest * F.pow(F.lit(2.0), F.lit(es) - left))).cast("int")


def fraction(bits: Column, width: int, es: int) -> Column:
    n = fraction_bits(bits, width, es)
    return (_size(bits, width) % F.pow(F.lit(2.0), n).cast("long")).cast("long")


def decode(bits: Column, width: int, es: int | None = None) -> Column:
    """The value as a double (exact up to 32 bits); null for NaR."""
    es = ES[width] if es is None else es
    scale = regime(bits, width) * (1 << es) + exponent(bits, width, es)
    value = (1 + fraction(bits, width, es) / F.pow(F.lit(2.0), fraction_bits(bits, width, es))) * F.pow(F.lit(2.0), scale)
    value = F.when(signed(bits, width) < 0, -value).otherwise(value)
    return F.when(bits == 0, F.lit(0.0)).when(bits != nar(width), value)


def largest(width: int, es: int) -> float:
    return float(2 ** ((width - 2) << es))


def smallest(width: int, es: int) -> float:
    return 1 / largest(width, es)


def advantage(value: Column, width: int = 32, es: int = 2) -> Column:
    """Fraction bits a posit of this value has beyond a float's: 8 - (1 + es + regime bits)."""
    k = F.floor(F.log2(F.abs(value)) / (1 << es))
    bits = F.when(k >= 0, k + 2).otherwise(1 - k)
    return F.when(value == 0, F.lit(None).cast("int")).otherwise((F.lit(8 - 1 - es) - F.least(bits, F.lit(width - 1))).cast("int"))


def bfloat16(value: Column) -> Column:
    """Nearest number with 8 significant bits, ties to even."""
    e = F.floor(F.log2(F.abs(value)))
    unit = F.pow(F.lit(2.0), e - 7)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value / unit) * unit)


def half(value: Column) -> Column:
    """The nearest IEEE half-precision number."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return x.astype("float16").astype("float64")

    return run(value)


# ------------------------------------------------- other layouts and accumulators


def encode_sign_magnitude(x: Fraction | None, width: int, es: int) -> int:
    """The variant without complement: a sign bit before the magnitude's pattern."""
    if x is None:
        return nar(width)
    return encode_exact(abs(x), width, es) | (1 << (width - 1) if x < 0 else 0)


def decode_sign_magnitude(bits: int, width: int, es: int) -> Fraction | None:
    if bits == nar(width):
        return None
    x = decode_exact(bits & ((1 << (width - 1)) - 1), width, es)
    return -x if bits >> (width - 1) else x


#: The fixed-regime teaching layout: sign, 6 regime bits, 2 exponent bits, 23 fraction bits.
_REGIME, _EXP, _FRACTION = 6, 2, 23


def encode_fixed_regime(x: Fraction) -> str:
    """Bit string with the regime run left-aligned in a field of fixed width; fractions are cut."""
    if x == 0:
        return "0" * 32
    size = abs(x)
    scale = size.numerator.bit_length() - size.denominator.bit_length()
    if size < Fraction(2) ** scale:
        scale -= 1
    k, e = scale >> _EXP, scale & 3
    run = "1" * (k + 1) + "0" if k >= 0 else "0" * -k + "1"
    if len(run) > _REGIME + (k >= 0):
        raise OverflowError("the regime doesn't fit its field")
    digits = int((size / Fraction(2) ** scale - 1) * (1 << _FRACTION))
    return ("1" if x < 0 else "0") + run.ljust(_REGIME, "0")[:_REGIME] + format(e, "02b") + format(digits, f"0{_FRACTION}b")


def decode_fixed_regime(bits: str) -> Fraction:
    if "1" not in bits:
        return Fraction(0)
    run = bits[1 : 1 + _REGIME]
    first = run[0]
    n = len(run) - len(run.lstrip(first))
    k = n - 1 if first == "1" else -n
    e = int(bits[1 + _REGIME : 1 + _REGIME + _EXP], 2)
    part = Fraction(int(bits[1 + _REGIME + _EXP :], 2), 1 << _FRACTION)
    x = (1 + part) * Fraction(2) ** (4 * k + e)
    return -x if bits[0] == "1" else x


def fixed_regime(op: str, a: str, b: str) -> str:
    x, y = decode_fixed_regime(a), decode_fixed_regime(b)
    return encode_fixed_regime({"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y, "divide": lambda: x / y}[op]())


def exact_sum():
    """Grouped aggregate: the correctly rounded sum of doubles, whatever their order."""
    from math import fsum

    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        return fsum(x.dropna())

    return run


def regime_traffic(value: Column, es: int = 2, width: int = 32) -> Column:
    """Regime bits that a value needs: the key of the traffic histogram."""
    k = F.floor(F.log2(F.abs(value)) / (1 << es))
    return F.when(value == 0, F.lit(None)).otherwise(F.least(F.when(k >= 0, k + 2).otherwise(1 - k), F.lit(width - 1))).cast("int")


def nearest_power_of_four(x: Column) -> Column:
    return F.pow(F.lit(4.0), F.rint(F.log2(F.abs(x)) / 2))


def precision_envelope(spark, width: int = 32, es: int = 2):
    """(k, fraction_bits) of every regime value: how precise each magnitude is."""
    k = F.col("id") - (width - 2)
    bits = F.when(k >= 0, k + 2).otherwise(1 - k)
    return spark.range(2 * (width - 2) + 1).select(k.alias("k"), F.greatest(F.lit(width - 1 - es) - bits, F.lit(0)).cast("int").alias("fraction_bits"))
