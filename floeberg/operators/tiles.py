"""Matrices in square tiles, and their products.

tiles(bi, bj, at, v): places inside the tile in ascending order, row by row, and values
as arrays, one record a tile.

Products of entries (``product``, ``gram``): the entries of one inner index lie in one
task, which cuts them into chunks by squares' sides of SPAN tiles, and sends a chunk to
the squares of the result where it meets another one, to no others.  So an entry is sent
at most as often as its inner index has chunks on the other side: never more often than
it has products, nor than the result has squares in a row, and as often as before for
each entry when the matrix gets more rows and more inner indexes.  Chunks travel as
bytes of the narrowest kind that holds their numbers.  The squares of A A' on one side of
the diagonal are made, and give those on the other.

Products of stored tiles (``multiply``): the result is made in squares of GROUP x GROUP
tiles.  Every tile of A goes to the squares of its block row whose inner block B has, and
every tile of B likewise; the tiles of one square then lie sorted by inner block in one
task.

In both, a task multiplies entries in numpy in steps of bounded size and holds one square."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE = 256
#: Tiles on a side of the square of the result that is made at once of stored tiles.
GROUP = 4
#: The same of entries, at most, and rows on a side if tiles are large.
SPAN, SIDE = 8, 4096
#: Entries that are dealt to squares at once, and entries that are sent in one batch.
DEALT, SENT = 1 << 17, 1 << 20
#: Products of two entries in one numpy step.
STEP = 1 << 20
#: Keys of tiles that are broadcast at most; more are joined by a shuffle of the tiles.
KEYS = 1 << 20
_TILES = "bi long, bj long, at array<int>, v array<double>"
_CHUNKS = "gi long, gj long, kinds string, n binary, m binary, i binary, j binary, v binary, w binary"
_KINDS = ("u1", "u2", "i4", "f8")


def _tile(bi: int, bj: int, at: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bi]), pa.array([bj]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([v], pa.list_(pa.float64()))], ["bi", "bj", "at", "v"])


def to_tiles(a: DataFrame, size: int = TILE) -> DataFrame:
    """Entries (i, j, v) as tiles; entries that repeat are added."""
    place = F.pmod("i", F.lit(size)) * size + F.pmod("j", F.lit(size))
    cells = a.select(F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), place.cast("int").alias("at"), F.col("v").cast("double").alias("v"))

    def pack(batches):
        # A tile's rows may go on in the next batch.
        key, at, v = None, [], []

        def told():
            places, values = np.concatenate(at), np.concatenate(v)
            first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            return _tile(*key, places[first], np.add.reduceat(values, first))

        for batch in batches:
            bi, bj, place, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(bi):
                continue
            starts = np.flatnonzero(np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            for lo, hi in zip(starts, [*starts[1:], len(bi)]):
                if (now := (int(bi[lo]), int(bj[lo]))) != key:
                    if key is not None:
                        yield told()
                    key, at, v = now, [], []
                at.append(place[lo:hi])
                v.append(value[lo:hi])
        if key is not None:
            yield told()

    laid = cells.where("at is not null and v is not null").repartition("bi", "bj").sortWithinPartitions("bi", "bj", "at")
    return laid.mapInArrow(pack, _TILES)


def to_entries(tiles: DataFrame, size: int = TILE) -> DataFrame:
    cells = tiles.select("bi", "bj", F.inline(F.arrays_zip(F.col("at").alias("at"), F.col("v").alias("v"))))
    return cells.select((F.col("bi") * size + F.floor(F.col("at") / size)).alias("i"), (F.col("bj") * size + F.col("at") % size).alias("j"), "v")


def transposed(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """The tiles of A' from those of A: nothing is shuffled."""
    cells = F.array_sort(F.transform(F.arrays_zip("at", "v"), lambda e: F.struct((e["at"] % size * size + F.floor(e["at"] / size)).cast("int").alias("at"), e["v"].alias("v"))))
    turned = tiles.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), cells.alias("_e"))
    return turned.select("bi", "bj", F.col("_e.at").alias("at"), F.col("_e.v").alias("v"))


def _keys(tiles: DataFrame, *columns: str) -> DataFrame:
    """The tiles' places on the other side: short rows, so that the tiles need not be shuffled to meet them."""
    keys = tiles.select(*columns).distinct()
    return F.broadcast(keys) if keys.limit(KEYS + 1).count() <= KEYS else keys


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gi, gj, bk, side, block, at, v): the tiles of A (side 0) and of B (1) for every square of the result, dealt and sorted by it;
    ``block`` is the tile's block row, on side 1 its block column."""
    square = lambda c: F.floor(F.col(c) / GROUP)
    left = a.select(square("bi").alias("gi"), F.col("bj").alias("bk"), F.col("bi").alias("block"), "at", "v")
    right = b.select(square("bj").alias("gj"), F.col("bi").alias("bk"), F.col("bj").alias("block"), "at", "v")
    columns = ("gi", "gj", "bk", "side", "block", "at", "v")
    to_left = left.join(_keys(right, "bk", "gj"), "bk").withColumn("side", F.lit(0)).select(*columns)
    to_right = right.join(_keys(left, "bk", "gi"), "bk").withColumn("side", F.lit(1)).select(*columns)
    return to_left.unionByName(to_right).repartition("gi", "gj").sortWithinPartitions("gi", "gj", "bk", "side")


def _add_products(total: np.ndarray, seen: np.ndarray, left: list, right: list) -> None:
    """Adds the products of entries (row, inner, value) and (inner, column, value) that meet, STEP at a time."""
    row, inner, v = (np.concatenate(c) for c in zip(*left))
    own, column, w = (np.concatenate(c) for c in zip(*right))
    order = np.argsort(own, kind="stable")
    own, column, w = own[order], column[order], w[order]
    start = np.searchsorted(own, inner)
    n = np.searchsorted(own, inner, "right") - start
    met = n > 0
    row, v, start, n = row[met], v[met], start[met], n[met]
    width, ends = total.shape[1], np.cumsum(n)
    flat, found = total.reshape(-1), seen.reshape(-1)
    lo = 0
    while lo < len(n):
        done = ends[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + STEP, "right")))
        which = np.repeat(np.arange(lo, hi), n[lo:hi])
        at = np.arange(len(which)) + done - (ends - n)[which] + start[which]
        cell = row[which] * width + column[at]
        np.add.at(flat, cell, v[which] * w[at])
        found[cell] = True
        lo = hi


def multiply(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """The tiles of A B; an entry of the result is kept where any product meets it, also if they sum to 0."""
    side_of = size * GROUP

    def run(batches):
        now, total, seen, inner, left, right = None, None, None, None, [], []

        def told():
            for x in range(GROUP):
                for y in range(GROUP):
                    part = np.s_[x * size : (x + 1) * size, y * size : (y + 1) * size]
                    at = np.flatnonzero(seen[part])
                    if len(at):
                        yield _tile(now[0] * GROUP + x, now[1] * GROUP + y, at, total[part].reshape(-1)[at])

        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(5)]
            lists = [batch.column(k) for k in (5, 6)]
            for k, (gi, gj, bk, side, block) in enumerate(zip(*keys)):
                if (gi, gj) != now or bk != inner:
                    if left and right:
                        _add_products(total, seen, left, right)
                    left, right, inner = [], [], bk
                if (gi, gj) != now:
                    if now is not None:
                        yield from told()
                    now, total, seen = (gi, gj), np.zeros((side_of, side_of)), np.zeros((side_of, side_of), bool)
                at, v = (c[k].values.to_numpy() for c in lists)
                i, j, shift = at // size, at % size, block % GROUP * size
                if side == 0:
                    left.append((i + shift, j, v))
                else:
                    right.append((i, j + shift, v))
        if left and right:
            _add_products(total, seen, left, right)
        if now is not None:
            yield from told()

    return meeting(a, b).mapInArrow(run, _TILES)


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of the narrowest kind that holds all numbers as they are, and the numbers in it."""
    with np.errstate(invalid="ignore"):
        for kind, name in enumerate(_KINDS[:-1]):
            if (own := x.astype(name)).size == 0 or (own == x).all():
                return kind, own
    return len(_KINDS) - 1, x.astype("f8")


def _merged(k: np.ndarray, other: np.ndarray, i: np.ndarray, v: np.ndarray):
    """Sorted entries; those of one place are added."""
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (other[1:] != other[:-1]) | (i[1:] != i[:-1])])
    return (k, other, i, v) if len(first) == len(k) else (k[first], other[first], i[first], np.add.reduceat(v, first))


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``start`` and are ``n`` long."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - start, n)


def _bytes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``x`` as one binary for each range that ends at ``ends``."""
    at = np.r_[0, ends].astype("i4") * np.int32(x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _chunks(k: np.ndarray, i: np.ndarray, side: int):
    """Runs of entries of one inner index and one side of a square: (inner index, square, start, length)."""
    g = i // side
    start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]) if len(k) else np.zeros(0, int)
    return k[start], g[start], start, np.diff(np.r_[start, len(k)])


def _dealt(left, right, side: int):
    """Whole inner indexes, (k, i, v) sorted, dealt to the squares where two chunks meet; without ``right`` the entries meet themselves."""
    same = right is None
    right = left if same else right
    (ka, ga, start_a, n_a), (kb, gb, start_b, n_b) = _chunks(*left[:2], side), _chunks(*right[:2], side)
    first, last = np.searchsorted(kb, ka), np.searchsorted(kb, ka, "right")
    if same:
        first = np.arange(len(ka))  # chunks before have met this one
    met, before = last - first, np.r_[0, np.cumsum(n_b)]
    ends = np.cumsum(n_a * met + before[last] - before[first])
    kinds, numbers = zip(*(_narrow(x) for x in (left[1] % side, right[1] % side, left[2], right[2])))
    lo = 0
    while lo < len(ka):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SENT, "right")))
        a, b = np.repeat(np.arange(lo, hi), met[lo:hi]), _places(first[lo:hi], met[lo:hi])
        lo = hi
        if not len(a):
            continue
        order = np.lexsort((gb[b], ga[a]))
        a, b = a[order], b[order]
        x, y, n, m = ga[a], gb[b], n_a[a], n_b[b]
        if same:
            m = np.where(x == y, 0, m)  # on the diagonal once
        to = np.flatnonzero(np.r_[(x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
        at, over = _places(start_a[a], n), _places(start_b[b], m)
        (kind_n, small_n), (kind_m, small_m) = _narrow(n), _narrow(m)
        told = "".join(map(str, (kind_n, kind_m, *kinds)))
        own, other = np.cumsum(n)[to], np.cumsum(m)[to]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[to]), pa.array(y[to]), pa.array([told] * len(to)), _bytes(small_n, to + 1), _bytes(small_m, to + 1), _bytes(numbers[0][at], own), _bytes(numbers[1][over], other), _bytes(numbers[2][at], own), _bytes(numbers[3][over], other)],
            ["gi", "gj", "kinds", "n", "m", "i", "j", "v", "w"],
        )


def _sent(entries: DataFrame, same: bool, side: int) -> DataFrame:
    """(gi, gj, ..): the chunks of entries (k, other, i, v) that meet in a square of the result, dealt and sorted by it.  A record holds
    whole pairs of chunks: lengths ``n`` and ``m``, places ``i`` and ``j`` in the square, values ``v`` and ``w``."""

    def run(batches):
        def deal(k, other, i, v):
            if same:
                return _dealt((k, i, v), None, side)
            return _dealt(*((k[s], i[s], v[s]) for s in (~other, other)), side)

        held, size, most = [], 0, DEALT
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < most:
                continue
            now = _merged(*map(np.concatenate, zip(*held)))
            cut = np.searchsorted(now[0], now[0][-1])  # the last inner index may go on in the next batch
            if cut:
                yield from deal(*(c[:cut] for c in now))
            held = [[c[cut:] for c in now]]
            size = len(held[0][0])
            most = max(DEALT, 2 * size)
        if size:
            yield from deal(*_merged(*map(np.concatenate, zip(*held))))

    laid = entries.where("k is not null and i is not null and v is not null").repartition("k").sortWithinPartitions("k", "other", "i")
    return laid.mapInArrow(run, _CHUNKS).repartition("gi", "gj").sortWithinPartitions("gi", "gj")


def _squares(sent: DataFrame, same: bool, size: int, span: int) -> DataFrame:
    """The tiles of the result, one square after the other."""
    side = size * span

    def run(batches):
        now, total, seen = None, None, None

        def told():
            for x in range(span):
                for y in range(span):
                    part = np.s_[x * size : (x + 1) * size, y * size : (y + 1) * size]
                    own, found = total[part], seen[part]
                    bi, bj = now[0] * span + x, now[1] * span + y
                    turns = [(bi, bj, own, found), (bj, bi, own.T, found.T)] if same and now[0] != now[1] else [(bi, bj, own, found)]
                    for bi, bj, own, found in turns:
                        at = np.flatnonzero(found)
                        if len(at):
                            yield _tile(bi, bj, at, own.reshape(-1)[at])

        for batch in batches:
            for gi, gj, kinds, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if (gi, gj) != now:
                    if now is not None:
                        yield from told()
                    now, total, seen = (gi, gj), np.zeros((side, side)), np.zeros((side, side), bool)
                n, m, i, j, v, w = (np.frombuffer(x, _KINDS[int(kind)]) for x, kind in zip(numbers, kinds))
                inner = np.arange(len(n))
                left = np.repeat(inner, n)
                right = (left, i, v) if same and gi == gj else (np.repeat(inner, m), j, w)
                _add_products(total, seen, [(i.astype(int), left, v.astype(float))], [(right[0], right[1].astype(int), right[2].astype(float))])
        if now is not None:
            yield from told()

    return sent.mapInArrow(run, _TILES)


def _span(size: int) -> int:
    return max(1, min(SPAN, SIDE // size))


def _side(a: DataFrame, inner: str, outer: str, other: bool) -> DataFrame:
    return a.select(F.col(inner).cast("long").alias("k"), F.lit(other).alias("other"), F.col(outer).cast("long").alias("i"), F.col("v").cast("double").alias("v"))


def product(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """Entries of A B; entries that repeat are added."""
    span = _span(size)
    entries = _side(a, "j", "i", False).unionByName(_side(b, "i", "j", True))
    return to_entries(_squares(_sent(entries, False, size * span), False, size, span), size)


def gram(a: DataFrame, size: int = TILE) -> DataFrame:
    """Entries of A A'; entries that repeat are added."""
    span = _span(size)
    return to_entries(_squares(_sent(_side(a, "j", "i", False), True, size * span), True, size, span), size)
