"""Hard negatives against a loop over all pairs, bounds that prune, and the cases of the docstring."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from floeberg.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, q string, cell int, dist double"


def plain(rows):
    held = []
    for i, v, k in rows:
        if i is None or v is None or k is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * x) for x in v], int(math.fmod(k + 1, 10)) if i % 7 == 0 else k))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, done = Counter(), set()
    for i, q, k in held:
        if i % 100 or (i, tuple(q), k) in done:
            continue
        done.add((i, tuple(q), k))
        others = sorted((-dot(q, w), j, m == k) for j, w, m in held if j != i)
        for s, p, _ in [x for x in others if x[2]][:5]:
            fit = [x for x in others if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            for n, (t, j, _) in enumerate(fit, 1):
                out[(i, p, n, j, -s, -t)] += 1
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, k, "x", 1, 0.5) for i, v, k in rows], SCHEMA).repartition(4)
    got = H.hard_negatives(df, **more).collect()
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def clustered(n, dim, seed, scale=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        v = [round(scale * (x + rng.gauss(0, 0.4)) / 4, 2) for x in m]
        rows.append((i, v, rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(H, "BLOCK_VALUES", 6 * 32)  # many blocks
    rows = clustered(900, 6, 1, scale)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = clustered(400, 4, 2)
    same = rows[205][1]
    rows += [(1000 + i, same, 1) for i in range(300)]  # ties
    rows += [(None, same, 1), (1400, None, 1), (1500, same, None), (1600, [None, 1.0], 1), (1700, [math.nan] * 4, 1), (1800, [math.inf, 0.0, 0.0, 0.0], 1), (1900, [], 2), (2000, [0.5, 0.5], 2), (2100, [-9.0] * 4, 77), (2101, [9.0] * 4, 77)]
    rows += [rows[200], rows[200], rows[7], rows[7], (300, [0.25] * 4, 2), (-100, [0.5] * 4, -3), (-7, [0.5] * 4, -14)]
    assert mined(spark, rows) == plain(rows)


def test_tables_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(H, "BLOCK_VALUES", 5 * 16)
    monkeypatch.setattr(H, "GROUP", 16)
    monkeypatch.setattr(H, "MOST_HELD", 1)
    rows = [(100 * i if i % 3 == 0 else i, v, k) for i, v, k in clustered(600, 5, 3)]
    assert mined(spark, rows) == plain(rows)


def test_bounds_leave_out_far_blocks(spark):
    """Clusters far apart: a group is served few of the cells."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(8, 3)) * 20
    q = [(i, (middles[i % 8] + rng.normal(size=3) * 0.1).tolist(), i // 8 % 3) for i in range(4000)]
    df = spark.createDataFrame(q, "vec_id long, embedding array<double>, label int")
    rows = H.quantised(df).cache()
    local, _, n = H.find_space(rows, 16)
    space = spark.sparkContext.broadcast(local)
    blocks = H.packed(H.in_cells(rows, space), space, H.BLOCK, True).cache()
    groups = H.packed(H.in_cells(rows.where("vec_id % 100 = 0"), space), space, 16, False).selectExpr("number as group", "ids as a_ids", "labels as a_labels", "q as a_q").cache()
    all_pairs = blocks.count() * groups.count()
    met = blocks.join(H.served(groups, space, 5), "cell").where("hi >= from and lo <= to").count()
    assert groups.count() > 2 and met < 0.7 * all_pairs
    assert H.hard_negatives(df).count() == sum(plain(q).values())


def test_best_keeps_first_by_score_then_id():
    rng = np.random.default_rng(5)
    best, seen = H.Best(6, 3), []
    for _ in range(9):
        slot, score, ids = rng.integers(0, 6, 20), rng.integers(0, 5, 20), rng.integers(0, 1000, 20)
        seen += zip(slot.tolist(), (-score).tolist(), ids.tolist())
        best.add(slot, score, ids)
    for s in range(6):
        assert [(-v, i) for v, i in zip(best.score[s].tolist(), best.id[s].tolist())] == [x[1:] for x in sorted(seen) if x[0] == s][:3]
