"""Posit arithmetic on whole numpy arrays of bit patterns.

A pattern becomes (negative, scale, significand), the significand a 63-bit
integer whose top bit stands for one.  Every operation forms one such result with
a flag for what lies below its last bit, and it is rounded once, to the nearest
pattern, ties to even.  Widths may differ from row to row (2 to 32; others give
the NaR of 32 bits)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64
_TOP = 62
_ONE = _U(1 << _TOP)


class Parts(NamedTuple):
    negative: np.ndarray
    scale: np.ndarray
    sig: np.ndarray
    sticky: np.ndarray
    zero: np.ndarray
    nar: np.ndarray


def _u(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each uint64."""
    x = _u(x)
    high = x >> _U(32)
    part = np.where(high > 0, high, x & _U(0xFFFFFFFF)).astype(np.float64)
    return np.frexp(part)[1].astype(np.int64) + np.where(high > 0, 32, 0)


def normalise(value: np.ndarray, scale: np.ndarray, sticky=False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value (any uint64, its bit 62 stands for 2^scale) with its top bit at 62."""
    shift = bit_length(value) - 1 - _TOP
    down, up = np.maximum(shift, 0).astype(np.uint64), np.maximum(-shift, 0).astype(np.uint64)
    lost = (value & ((_U(1) << down) - _U(1))) != 0
    return np.where(value == 0, value, (value >> down) << np.minimum(up, _U(63))), scale + shift, sticky | lost


def decode(bits, width, es: int) -> Parts:
    width = np.broadcast_to(np.asarray(width, np.int64), np.shape(bits)).copy()
    ok = (width >= 2) & (width <= 32)
    width[~ok] = 32
    w = _u(width)
    bits = _u(np.asarray(bits, np.int64)) & ((_U(1) << w) - _U(1))
    half = _U(1) << (w - _U(1))
    negative = bits >= half
    body = np.where(negative, (_U(1) << w) - bits, bits) & (half - _U(1))
    zero, nar = bits == 0, (bits == half) | ~ok
    ones = (body << _U(1)) >= half
    run = width - 1 - bit_length(np.where(ones, half - _U(1) - body, body))
    k = np.where(ones, run - 1, -run)
    rest = np.maximum(width - 2 - run, 0)
    tail = body & ((_U(1) << _u(rest)) - _U(1))
    nf = np.maximum(rest - es, 0)
    exponent = np.where(rest >= es, tail >> _u(nf), tail << _u(np.maximum(es - rest, 0))).astype(np.int64)
    fraction = tail & ((_U(1) << _u(nf)) - _U(1))
    sig = _ONE | fraction << _u(_TOP - nf)
    plain = ~(zero | nar)
    return Parts(negative & plain, np.where(plain, k * (1 << es) + exponent, 0), np.where(plain, sig, _U(0)), np.zeros(len(bits), bool), zero & ~nar, nar)


def encode(p: Parts, width, es: int) -> np.ndarray:
    width = np.broadcast_to(np.asarray(width, np.int64), np.shape(p.sig)).copy()
    ok = (width >= 2) & (width <= 32)
    width[~ok] = 32
    k = p.scale >> es
    exponent = p.scale - (k << es)
    regime = np.where(k >= 0, k + 2, 1 - k)
    beyond = regime > width
    k, regime = np.clip(k, -31, 30), np.minimum(regime, 32)
    run = np.where(k >= 0, (_U(1) << _u(np.maximum(k, 0) + 2)) - _U(2), _U(1))
    used = _u(regime + es)
    fraction = p.sig & (_ONE - _U(1))
    pattern = run << _u(_TOP - regime) | _u(exponent) << (_U(_TOP) - used) | fraction >> used
    drop = _u(_TOP + 1 - width)
    kept, cut, half = pattern >> drop, pattern & ((_U(1) << drop) - _U(1)), _U(1) << (drop - _U(1))
    more = p.sticky | ((fraction & ((_U(1) << used) - _U(1))) != 0)
    kept = kept + ((cut > half) | ((cut == half) & (more | ((kept & _U(1)) == 1)))).astype(np.uint64)
    most = (_U(1) << _u(width - 1)) - _U(1)
    kept = np.where(beyond, np.where(p.scale >= 0, most, _U(1)), np.clip(kept, _U(1), most))
    out = np.where(p.negative, (_U(1) << _u(width)) - kept, kept)
    out = np.where(p.zero, _U(0), out)
    return np.where(p.nar | ~ok, _U(1) << _u(width - 1), out).astype(np.int64)


def _sum(x: Parts, y: Parts) -> Parts:
    """x + y of exact parts."""
    swap = (y.scale > x.scale) | ((y.scale == x.scale) & (y.sig > x.sig))
    swap = (swap & ~y.zero) | x.zero
    a = Parts(*(np.where(swap, q, p) for p, q in zip(x, y, strict=True)))
    b = Parts(*(np.where(swap, p, q) for p, q in zip(x, y, strict=True)))
    away = np.where(b.zero, 63, np.clip(a.scale - b.scale, 0, 63)).astype(np.uint64)
    small = np.where(b.zero, _U(0), b.sig >> away)
    lost = ~b.zero & ((b.sig & ((_U(1) << away) - _U(1))) != 0)
    minus = a.negative != b.negative
    total = np.where(minus, a.sig - small - lost.astype(np.uint64), a.sig + small)
    sig, scale, sticky = normalise(total, a.scale, lost)
    nothing = (x.zero & y.zero) | (total == 0)
    return Parts(a.negative & ~nothing, scale, sig, sticky, nothing, x.nar | y.nar)


def _negated(x: Parts) -> Parts:
    return x._replace(negative=~x.negative & ~x.zero)


def _product(x: Parts, y: Parts) -> Parts:
    sig, scale, sticky = normalise((x.sig >> _U(32)) * (y.sig >> _U(32)), x.scale + y.scale + 2)
    zero = x.zero | y.zero
    return Parts((x.negative != y.negative) & ~zero, scale, sig, sticky, zero, x.nar | y.nar)


def _quotient(x: Parts, y: Parts) -> Parts:
    top, by = (x.sig >> _U(32)) << _U(33), np.maximum(y.sig >> _U(32), _U(1))
    whole = top // by
    sig, scale, sticky = normalise(whole, x.scale - y.scale + 29, top % by != 0)
    return Parts((x.negative != y.negative) & ~x.zero, scale, sig, sticky, x.zero, x.nar | y.nar | y.zero)


def _root(x: Parts) -> Parts:
    odd = (x.scale & 1) == 1
    square = ((x.sig >> _U(32)) << odd.astype(np.uint64)) << _U(32)
    root = np.minimum(np.floor(np.sqrt(square.astype(np.float64))), 2.0**32 - 1).astype(np.uint64)
    root -= (root * root > square).astype(np.uint64)
    up = np.minimum(root + _U(1), _U(0xFFFFFFFF))
    root = np.where(up * up <= square, up, root)
    sig, scale, _ = normalise(root << _U(31), (x.scale - odd) // 2)
    return Parts(np.zeros(len(root), bool), scale, sig, root * root != square, x.zero, x.nar | x.negative)


def _whole(x: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Nearest integer of |x| below 2^62, ties to even, and whether |x| is 2^62 or more."""
    shift = np.clip(_TOP - x.scale, 0, 63)
    down = _u(shift)
    kept, cut = x.sig >> down, x.sig & ((_U(1) << down) - _U(1))
    half = np.where(shift > 0, _U(1) << _u(np.maximum(shift - 1, 0)), _U(0))
    up = (shift > 0) & ((cut > half) | ((cut == half) & (x.sticky | ((kept & _U(1)) == 1))))
    n = np.where(x.zero | (x.scale < -1), _U(0), kept + up.astype(np.uint64))
    return n, x.scale >= _TOP


def _of_integer(n: np.ndarray, negative: np.ndarray) -> Parts:
    sig, scale, sticky = normalise(n, np.full(len(n), _TOP))
    zero = n == 0
    return Parts(negative & ~zero, np.where(zero, 0, scale), sig, sticky, zero, np.zeros(len(n), bool))


# ------------------------------------------------------------------ on bit patterns


def add(a, b, width, es):
    return encode(_sum(decode(a, width, es), decode(b, width, es)), width, es)


def subtract(a, b, width, es):
    return encode(_sum(decode(a, width, es), _negated(decode(b, width, es))), width, es)


def multiply(a, b, width, es):
    return encode(_product(decode(a, width, es), decode(b, width, es)), width, es)


def divide(a, b, width, es):
    return encode(_quotient(decode(a, width, es), decode(b, width, es)), width, es)


def fused(a, b, c, width, es):
    """a * b + c with one rounding."""
    return encode(_sum(_product(decode(a, width, es), decode(b, width, es)), decode(c, width, es)), width, es)


def fused_subtract(a, b, c, width, es):
    """a * b - c with one rounding."""
    return encode(_sum(_product(decode(a, width, es), decode(b, width, es)), _negated(decode(c, width, es))), width, es)


def square_root(a, width, es):
    return encode(_root(decode(a, width, es)), width, es)


def round_to_integer(a, width, es):
    x = decode(a, width, es)
    n, large = _whole(x)
    near = _of_integer(n, x.negative)
    out = Parts(*(np.where(large, p, q) for p, q in zip(x, near, strict=True)))
    return encode(out._replace(nar=x.nar), width, es)


def convert(a, width, es, to_width, to_es):
    return encode(decode(a, width, es), to_width, to_es)


def to_integer(a, width, es, bits: int = 64, signed: bool = True, truncate: bool = False) -> np.ndarray:
    """Nearest (or truncated) integer, held to the range; NaR gives 0.

    Unsigned 64-bit results come as the long with the same bits."""
    x = decode(a, width, es)
    n, large = _whole(x)
    if truncate:
        n = np.where(x.zero | (x.scale < 0), _U(0), x.sig >> _u(np.clip(_TOP - x.scale, 0, 63)))
    n = np.where(large, np.where(x.scale == _TOP, x.sig, np.where(x.scale == _TOP + 1, x.sig << _U(1), _U(0xFFFFFFFFFFFFFFFF))), n)
    if signed:
        most = np.where(x.negative, _U(1 << (bits - 1)), _U((1 << (bits - 1)) - 1))
        n = np.minimum(n, most)
        out = np.where(x.negative, _U(0) - n, n)
    else:
        out = np.where(x.negative, _U(0), np.minimum(n, _U((1 << bits) - 1)))
    return np.where(x.nar, _U(0), out).view(np.int64)


def from_integer(n, width, es, unsigned: bool = False) -> np.ndarray:
    """Nearest posit; with ``unsigned`` a negative long stands for itself plus 2^64."""
    n = np.asarray(n, np.int64)
    negative = np.zeros(len(n), bool) if unsigned else n < 0
    size = n.view(np.uint64)
    return encode(_of_integer(np.where(negative, _U(0) - size, size), negative), width, es)


def from_double(x, width, es) -> np.ndarray:
    x = np.asarray(x, np.float64)
    nar = ~np.isfinite(x)
    m, e = np.frexp(np.where(nar, 0.0, np.abs(x)))
    zero = (m == 0) & ~nar
    sig = (m * 2.0**53).astype(np.uint64) << _U(10)
    return encode(Parts(np.signbit(x) & ~zero, e.astype(np.int64) - 1, sig, np.zeros(len(x), bool), zero, nar), width, es)


def to_double(a, width, es) -> np.ndarray:
    """The value (exact for es up to 3); NaN for NaR."""
    x = decode(a, width, es)
    out = np.ldexp((x.sig >> _U(32)).astype(np.float64), np.where(x.zero | x.nar, 0, x.scale - 30))
    return np.where(x.nar, np.nan, np.where(x.negative, -out, out))


# ------------------------------------------------------------- exact accumulators


def chunks(p: Parts, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact parts as signed 32-bit pieces of a fixed-point number with unit 2^low.

    (chunk, lo, mid, hi): the value is (lo + 2^32 mid + 2^64 hi) * 2^(32 chunk + low).
    Sums of 2^31 such pieces fit a long, so they may be added in any order."""
    place = np.where(p.zero | p.nar, 0, p.scale - _TOP - low)
    short = np.clip(-place, 0, 62)  # bits below the unit are zero in exact parts
    sig, place = p.sig >> _u(short), place + short
    chunk, by = place >> 5, _u(place & 31)
    mask = _U(0xFFFFFFFF)
    lo = (sig << by) & mask
    rest = sig >> (_U(32) - by)
    sign = np.where(p.negative, -1, 1)
    return chunk, lo.astype(np.int64) * sign, (rest & mask).astype(np.int64) * sign, (rest >> _U(32)).astype(np.int64) * sign


def product_chunks(a, b, width, es, low: int):
    x, y = decode(a, width, es), decode(b, width, es)
    p = _product(x, y)
    return *chunks(p, low), p.nar
