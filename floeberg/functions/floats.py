"""Short binary floats as double columns: bfloat16 and IEEE half.

A value is held as the double that it equals, so all of this is plain column
arithmetic.  The double result of + - * / and sqrt of short floats, rounded once
more, is the correctly rounded one, since a double has over twice their bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Significant bits and least normal exponent of the formats.
BFLOAT16, HALF = (8, -126), (11, -14)
_MOST = {BFLOAT16: (2.0 - 2.0**-7) * 2.0**127, HALF: 65504.0}


def _exponent(x: Column) -> Column:
    """floor(log2|x|), put right where the logarithm is a hair off."""
    e = F.floor(F.log2(F.abs(x)))
    scaled = F.abs(x) / F.pow(F.lit(2.0), e)
    return e + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)


def rounded(x: Column, form: tuple[int, int], style: str = "nearest") -> Column:
    """Nearest (ties to even), zero, up or down; beyond the largest number the style
    decides between it and infinity.  NaN and infinities stay."""
    bits, least = form
    x = x.cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(_exponent(x), F.lit(least)) - (bits - 1))
    q = x / unit
    whole = {"nearest": F.rint(q), "zero": F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)), "up": F.ceil(q), "down": F.floor(q)}[style]
    y = whole.cast("double") * unit
    most, inf = F.lit(_MOST[form]), F.lit(float("inf"))
    over = {"nearest": inf, "zero": most, "up": inf, "down": most}[style]
    under = {"nearest": -inf, "zero": -most, "up": -most, "down": -inf}[style]
    y = F.when(y > most, over).when(y < -most, under).otherwise(y)
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == inf), x).otherwise(y)


def bfloat16(x: Column, sticky: Column | None = None, strict: bool = False) -> Column:
    """Nearest bfloat16, ties to even; where ``sticky`` holds, ties go towards zero.

    ``strict``: NaN and infinities raise an error."""
    out = rounded(x, BFLOAT16)
    if sticky is not None:
        cut = rounded(x, BFLOAT16, "zero")
        away = rounded(x, BFLOAT16, "up") + rounded(x, BFLOAT16, "down") - cut
        out = F.when(sticky & (F.abs(x - cut) == F.abs(away - x)), cut).otherwise(out)
    if strict:
        out = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.raise_error(F.lit("not a finite number"))).otherwise(out)
    return out


def half(x: Column, style: str = "nearest") -> Column:
    return rounded(x, HALF, style)


_OPS = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a, b), "sqrt": lambda a: F.sqrt(a), "sin": lambda a: F.sin(a), "cos": lambda a: F.cos(a),
    "abs": lambda a: F.abs(a), "negate": lambda a: -a, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b), "fused": lambda a, b, c: a * b + c,
    "ceil": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "rint": lambda a: F.rint(a),
    "trunc": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"), "round": lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5),
    "exp": lambda a: F.exp(a), "log": lambda a: F.ln(a), "log2": lambda a: F.log2(a), "log10": lambda a: F.log10(a), "pow": lambda a, b: F.pow(a, b), "tan": lambda a: F.tan(a), "atan": lambda a: F.atan(a),
    "tanh": lambda a: F.tanh(a), "sinh": lambda a: F.sinh(a), "cosh": lambda a: F.cosh(a), "asin": lambda a: F.asin(a), "acos": lambda a: F.acos(a), "cbrt": lambda a: F.cbrt(a), "hypot": lambda a, b: F.hypot(a, b),
}


def op(name: str, form: tuple[int, int], *values: Column) -> Column:
    """An operation on short floats: in doubles, then rounded once."""
    return rounded(_OPS[name](*values), form)


def classify(x: Column, form: tuple[int, int] = HALF) -> Column:
    """nan, infinite, zero, subnormal or normal."""
    return F.when(F.isnan(x), "nan").when(F.abs(x) == F.lit(float("inf")), "infinite").when(x == 0, "zero").when(F.abs(x) < 2.0 ** form[1], "subnormal").otherwise("normal")


def frexp(x: Column) -> tuple[Column, Column]:
    """Fraction in [0.5, 1) and exponent."""
    e = F.when(x == 0, F.lit(0)).otherwise(_exponent(x) + 1).cast("int")
    return F.when(x == 0, x).otherwise(x / F.pow(F.lit(2.0), e)), e


def ldexp(x: Column, by: Column | int, form: tuple[int, int] = HALF) -> Column:
    return rounded(x * F.pow(F.lit(2.0), by if isinstance(by, Column) else F.lit(by)), form)


def modf(x: Column) -> tuple[Column, Column]:
    """Whole and fractional part, both with the sign of x."""
    whole = _OPS["trunc"](x)
    return whole, x - whole


def ilogb(x: Column) -> Column:
    return F.when(x != 0, _exponent(x)).cast("int")


def copysign(x: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(x)).otherwise(F.abs(x))


def nextafter(x: Column, up: bool = True, form: tuple[int, int] = HALF) -> Column:
    """The neighbouring number above (or below)."""
    bits, least = form
    small = 2.0 ** (least - bits + 1)
    step = F.when(x == 0, F.lit(small)).otherwise(F.pow(F.lit(2.0), F.greatest(_exponent(x), F.lit(least)) - (bits - 1)))
    toward = F.when(x == 0, step).otherwise(F.greatest(step / 2, F.lit(small)))
    power = (x != 0) & (F.abs(x) == F.pow(F.lit(2.0), F.greatest(_exponent(x), F.lit(least))))
    inward = F.when(power, toward).otherwise(step)
    return x + F.when(x >= 0, step).otherwise(inward) if up else x - F.when(x <= 0, step).otherwise(inward)
