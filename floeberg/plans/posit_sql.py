"""Posit decoding, exact steps and rounding written as DuckDB SQL, the oracle of the
format queries.  A number is (z zero, r NaR, g negative, s scale, f 60 fraction
bits, t something below them), its column names led by a prefix; arithmetic is on
128-bit integers.  Each stage is one more SELECT around the one before."""

from __future__ import annotations


def p2(n) -> str:
    return f"CAST(pow(2.0, {n}) AS HUGEINT)"


def stage(rel: str, **cols: str) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM ({rel})"


def _length(x: str) -> str:
    """Position of the top bit."""
    return f"length(bin({x})) - 1"


ONE = str(1 << 60)


def decode(rel: str, b: str, p: str, w, es: int) -> str:
    rel = stage(rel, _h=p2(f"{w} - 1"))
    rel = stage(rel, **{f"{p}z": f"{b} = 0", f"{p}r": f"{b} = _h", f"{p}g": f"{b} > _h", f"{p}t": "false"}, _body=f"(CASE WHEN {b} > _h THEN 2 * _h - {b} ELSE {b} END) % _h")
    rel = stage(rel, _one="_body * 2 >= _h", _fl="CASE WHEN _body * 2 >= _h THEN _h - 1 - _body ELSE _body END")
    rel = stage(rel, _run=f"{w} - 1 - CASE WHEN _fl = 0 THEN 0 ELSE length(bin(_fl)) END")
    rel = stage(rel, _k="CASE WHEN _one THEN _run - 1 ELSE -_run END", _rest=f"greatest({w} - 2 - _run, 0)")
    rel = stage(rel, _tail=f"_body % {p2('_rest')}", _nf=f"greatest(_rest - {es}, 0)")
    rel = stage(rel, **{f"{p}s": f"CAST(_k * {1 << es} + CASE WHEN _rest >= {es} THEN _tail // {p2('_nf')} ELSE _tail * {p2(f'{es} - _rest')} END AS BIGINT)", f"{p}f": f"(_tail % {p2('_nf')}) * {p2('60 - _nf')}"})
    return f"SELECT * EXCLUDE (_h, _body, _one, _fl, _run, _k, _rest, _tail, _nf) FROM ({rel})"


def encode(rel: str, p: str, out: str, w, es: int) -> str:
    rel = stage(rel, _k0=f"CAST(floor({p}s / {float(1 << es)}) AS BIGINT)")
    rel = stage(rel, _e=f"{p}s - _k0 * {1 << es}", _kk="greatest(least(_k0, 40), -40)", _rl0="CASE WHEN _k0 >= 0 THEN _k0 + 2 ELSE 1 - _k0 END")
    rel = stage(rel, _rl="CASE WHEN _kk >= 0 THEN _kk + 2 ELSE 1 - _kk END", _reg=f"CASE WHEN _kk >= 0 THEN {p2('greatest(_kk, 0) + 2')} - 2 ELSE 1 END")
    rel = stage(rel, _pat=f"(_reg * {1 << es} + _e) * {ONE} + {p}f", _drop=f"_rl + {es} + 61 - {w}")
    rel = stage(rel, _kept=f"_pat // {p2('_drop')}", _cut=f"_pat % {p2('_drop')}", _half=p2("_drop - 1"), _most=p2(f"{w} - 1") + " - 1")
    rel = stage(rel, _rd=f"_kept + CASE WHEN _cut > _half OR (_cut = _half AND ({p}t OR _kept % 2 = 1)) THEN 1 ELSE 0 END")
    rel = stage(rel, _mag=f"CASE WHEN _rl0 > {w} THEN (CASE WHEN {p}s >= 0 THEN _most ELSE 1 END) ELSE greatest(least(_rd, _most), 1) END")
    rel = stage(rel, **{out: f"CAST(CASE WHEN {p}r THEN _most + 1 WHEN {p}z THEN 0 WHEN {p}g THEN 2 * _most + 2 - _mag ELSE _mag END AS BIGINT)"})
    return f"SELECT * EXCLUDE (_k0, _e, _kk, _rl0, _rl, _reg, _pat, _drop, _kept, _cut, _half, _most, _rd, _mag) FROM ({rel})"


def _packed(rel: str, o: str, t: str, scale: str, sticky: str = "false") -> str:
    """A positive integer column t, its top bit at ``scale`` above its length, as scale and fraction."""
    rel = stage(rel, _len=_length(t))
    rel = stage(rel, _q=p2("greatest(_len - 60, 0)"))
    rel = stage(rel, **{f"{o}s": f"CAST({scale} + _len AS BIGINT)", f"{o}f": f"CASE WHEN _len >= 60 THEN {t} // _q ELSE {t} * {p2('greatest(60 - _len, 0)')} END - {ONE}", f"{o}t": f"({sticky}) OR {t} % _q <> 0"})
    return f"SELECT * EXCLUDE (_len, _q) FROM ({rel})"


def add(rel: str, x: str, y: str, o: str, minus: bool = False) -> str:
    yg = f"NOT {y}g AND NOT {y}z" if minus else f"{y}g"
    rel = stage(rel, _sw=f"NOT {y}z AND ({x}z OR {y}s > {x}s OR ({y}s = {x}s AND {y}f > {x}f))", _yg=yg)
    pick = lambda c, d=None: f"CASE WHEN _sw THEN {d or y + c} ELSE {x}{c} END"
    other = lambda c, d=None: f"CASE WHEN _sw THEN {x}{c} ELSE {d or y + c} END"
    rel = stage(rel, _ag=pick("g", "_yg"), _as=pick("s"), _af=pick("f"), _bg=other("g", "_yg"), _bs=other("s"), _bf=other("f"), _bz=other("z"))
    rel = stage(rel, _d="CASE WHEN _bz THEN 0 ELSE _as - _bs END")
    rel = stage(rel, _lost="NOT _bz AND _d > 62", _big=f"({ONE} + _af) * {p2(62)}", _small=f"CASE WHEN _bz OR _d > 62 THEN 0 ELSE ({ONE} + _bf) * {p2('62 - least(_d, 62)')} END")
    rel = stage(rel, _sum="CASE WHEN _ag <> _bg AND NOT _bz THEN _big - _small - CASE WHEN _lost THEN 1 ELSE 0 END ELSE _big + _small END")
    rel = stage(rel, **{f"{o}z": f"({x}z AND {y}z) OR _sum = 0", f"{o}r": f"{x}r OR {y}r", f"{o}g": "_ag"})
    rel = _packed(rel, o, "_sum", "_as - 122", "_lost")
    return f"SELECT * EXCLUDE (_sw, _yg, _ag, _as, _af, _bg, _bs, _bf, _bz, _d, _lost, _big, _small, _sum) FROM ({rel})"


def _short(p: str) -> str:
    return f"({1 << 30} + {p}f // {1 << 30})"


def multiply(rel: str, x: str, y: str, o: str) -> str:
    rel = stage(rel, _m=f"{_short(x)} * {_short(y)}", **{f"{o}z": f"{x}z OR {y}z", f"{o}r": f"{x}r OR {y}r", f"{o}g": f"{x}g <> {y}g"})
    return f"SELECT * EXCLUDE (_m) FROM ({_packed(rel, o, '_m', f'{x}s + {y}s - 60')})"


def divide(rel: str, x: str, y: str, o: str) -> str:
    rel = stage(rel, _n=f"{_short(x)} * {p2(64)}", **{f"{o}z": f"{x}z", f"{o}r": f"{x}r OR {y}r OR {y}z", f"{o}g": f"{x}g <> {y}g"})
    rel = stage(rel, _m=f"_n // {_short(y)}", _l=f"_n % {_short(y)} <> 0")
    return f"SELECT * EXCLUDE (_m, _n, _l) FROM ({_packed(rel, o, '_m', f'{x}s - {y}s - 64', '_l')})"


def root(rel: str, x: str, o: str) -> str:
    rel = stage(rel, _odd=f"abs({x}s) % 2", **{f"{o}z": f"{x}z", f"{o}r": f"{x}r OR {x}g", f"{o}g": "false"})
    rel = stage(rel, _n=f"{_short(x)} * (1 + _odd) * {p2(62)}")
    rel = stage(rel, _m0="CAST(floor(sqrt(CAST(_n AS DOUBLE))) AS HUGEINT)")
    rel = stage(rel, _m="CASE WHEN _m0 * _m0 > _n THEN _m0 - 1 WHEN (_m0 + 1) * (_m0 + 1) <= _n THEN _m0 + 1 ELSE _m0 END")
    return f"SELECT * EXCLUDE (_odd, _n, _m0, _m) FROM ({_packed(rel, o, '_m', f'({x}s - _odd) // 2 - 46', '_m * _m <> _n')})"


def whole(rel: str, x: str, out: str, cut: bool = False) -> str:
    """|x| as the nearest integer (ties to even) or, with ``cut``, without its fraction; 2^100 where it is beyond 2^64."""
    rel = stage(rel, _v=f"{ONE} + {x}f", _u=p2(f"greatest(least(60 - {x}s, 61), 0)"))
    rel = stage(rel, _i="_v // _u", _c="_v % _u")
    up = "0" if cut else "CASE WHEN _u > 1 AND (_c * 2 > _u OR (_c * 2 = _u AND _i % 2 = 1)) THEN 1 ELSE 0 END"
    rel = stage(rel, **{out: f"CASE WHEN {x}z OR {x}r OR {x}s < -1 THEN 0 WHEN {x}s > 64 THEN {p2(100)} WHEN {x}s > 60 THEN _v * {p2(f'greatest(least({x}s - 60, 4), 0)')} ELSE _i + {up} END"})
    return f"SELECT * EXCLUDE (_v, _u, _i, _c) FROM ({rel})"


def of_integer(rel: str, n: str, o: str, negative: str = "false") -> str:
    """A column of sizes (HUGEINT) as parts."""
    rel = stage(rel, **{f"{o}z": f"{n} = 0", f"{o}r": "false", f"{o}g": negative})
    return _packed(rel, o, n, "0")


def of_double(rel: str, x: str, o: str) -> str:
    rel = stage(rel, _s0=f"CASE WHEN {x} = 0 THEN 0 ELSE floor(log2(abs({x}))) END")
    rel = stage(rel, _m0=f"abs({x}) / pow(2.0, _s0)")
    rel = stage(rel, _s=f"_s0 + CASE WHEN _m0 >= 2 THEN 1 WHEN _m0 < 1 AND {x} <> 0 THEN -1 ELSE 0 END")
    rel = stage(rel, **{f"{o}z": f"{x} = 0", f"{o}r": "false", f"{o}g": f"{x} < 0", f"{o}t": "false", f"{o}s": "CAST(_s AS BIGINT)", f"{o}f": f"CASE WHEN {x} = 0 THEN 0 ELSE CAST((abs({x}) / pow(2.0, _s) - 1) * pow(2.0, 60) AS HUGEINT) END"})
    return f"SELECT * EXCLUDE (_s0, _m0, _s) FROM ({rel})"


def value(p: str) -> str:
    """Parts as a double; NULL for NaR."""
    return f"CASE WHEN {p}r THEN NULL WHEN {p}z THEN 0.0 ELSE (CASE WHEN {p}g THEN -1 ELSE 1 END) * (1 + CAST({p}f AS DOUBLE) / pow(2.0, 60)) * pow(2.0, {p}s) END::DOUBLE"


def limited(n: str, p: str, low: int, high: int) -> str:
    """A signed integer from a size, held to the range; NaR gives 0."""
    signed = f"CASE WHEN {p}r THEN 0 WHEN {p}g THEN -{n} ELSE {n} END"
    return f"greatest(least({signed}, {high}::HUGEINT), ({low})::HUGEINT)"
