"""Row arrays and tiles against plain loops, hubs in parts, bytes that the tiled product shuffles."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeberg.operators import rows as R, sparse as M, tiles as T
from floeberg.plans.iterate import cut


def matrix(seed, n, m, per_row):
    rng = random.Random(seed)
    return [(i, j, float(rng.choice([-2, -1, 1, 2, 3]))) for i in range(n) if i % 7 for j in rng.sample(range(m), rng.randint(0, per_row))]


def frame(spark, entries):
    return spark.createDataFrame(entries, "i long, j long, v double").repartition(3)


@pytest.mark.parametrize("most", [R.MOST, 8])
def test_row_arrays(spark, most):
    entries = matrix(1, 40, 60, 12) + [(41, j, 1.0 + j % 5) for j in range(0, 600)] + [(2, 59, 5.0), (2, 59, 5.0)]
    rows = R.to_rows(frame(spark, entries), most).cache()
    got = rows.collect()
    assert sorted((r.i, j, v) for r in got for j, v in zip(r.js, r.vs)) == sorted(entries)
    assert all(list(r.js) == sorted(r.js) for r in got)
    if most == 8:
        hub = sorted((r.part, r.js[0], r.js[-1], len(r.js)) for r in got if r.i == 41)
        assert len(hub) > 100 and max(n for *_, n in hub) <= 8 and all(a[2] < b[1] for a, b in zip(hub, hub[1:]))
    back = sorted(map(tuple, R.to_entries(rows).collect()))
    assert back == sorted(entries)
    order = sorted(entries, key=lambda e: e[:2])
    assert [(r.i, r.j) for r in R.compressed(rows).orderBy("at").collect()] == [e[:2] for e in order]
    assert sorted(r.at for r in R.compressed(rows).collect()) == list(range(len(entries)))
    sums = {r.i: (r.nnz, r.total, r.largest) for r in R.row_sums(rows).collect()}
    for i in {e[0] for e in entries}:
        own = [v for k, _, v in entries if k == i]
        assert sums[i] == (len(own), pytest.approx(sum(own)), max(map(abs, own)))


@pytest.mark.parametrize("most", [R.MOST, 5])
def test_products_on_arrays(spark, most):
    entries = matrix(2, 50, 50, 9) + [(49, j, 2.0) for j in range(50)]
    a, x = frame(spark, entries), spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 7 - 3.0).alias("x"))
    for got, want in ((R.times(R.columns_of(a, most), x), M.spmv(a, x)), (R.times_transposed(R.to_rows(a, most), x), M.spmv_transpose(a, x))):
        assert {r.i: r.y for r in got.collect()} == pytest.approx({r.i: r.y for r in want.collect()})


def test_rows_dealt_to_parts(spark):
    entries = matrix(3, 30, 30, 6)
    owner = M.round_robin(spark.range(30).select(F.col("id").alias("i")), "i", 4).withColumnRenamed("key", "i")
    got = {r.i: (r.part, r.local, r.nnz, r.inside) for r in R.dealt(R.to_rows(frame(spark, entries), 3), owner).collect()}
    for i in {e[0] for e in entries}:
        own = [j for k, j, _ in entries if k == i]
        assert got[i] == (i % 4, i // 4, len(own), sum(j % 4 == i % 4 for j in own))


@pytest.mark.parametrize("size", [4, 16, 256])
def test_tiled_product(spark, size):
    a, b = matrix(4, 70, 90, 8), matrix(5, 90, 50, 8) + [(0, 0, 1.0), (0, 0, 1.0)]
    want = defaultdict(float)
    for i, k, v in a:
        for k2, j, w in b:
            if k == k2:
                want[i, j] += v * w
    got = M.block_multiply(frame(spark, a), frame(spark, b), size).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.v for r in got} == pytest.approx(dict(want))


def test_repeated_entries_are_one_place_of_a_tile(spark):
    tiles = T.to_tiles(frame(spark, [(1, 2, 1.0)] * 1000 + [(0, 3, 2.0), (5, 5, 1.0)]), 4).collect()
    assert sorted((r.bi, r.bj, list(r["at"]), list(r.v)) for r in tiles) == [(0, 0, [3, 6], [2.0, 1000.0]), (1, 1, [5], [1.0])]


def test_a_square_of_tiles_gets_each_tile_once(spark):
    """Eight by eight tiles: a tile goes to two squares, not to the eight tiles of its row."""
    tiles = cut(T.to_tiles(frame(spark, [(i, j, 1.0) for i in range(0, 32, 2) for j in range(32)]), 4))
    assert tiles.count() == 64 and T.meeting(tiles, T.transposed(tiles, 4)).count() == 2 * 64 * 2


def test_values_that_are_not_finite_stay_with_their_own_products(spark):
    inf = float("inf")
    got = {(r.i, r.j): r.v for r in M.block_multiply(frame(spark, [(0, 0, inf), (1, 1, 2.0), (1, 0, 1.0)]), frame(spark, [(0, 0, 1.0), (1, 1, 3.0)]), 4).collect()}
    assert got == {(0, 0): inf, (1, 0): 1.0, (1, 1): 6.0}


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_gram_in_steps(spark, monkeypatch, step):
    monkeypatch.setattr(T, "STEP", step)
    a = matrix(9, 40, 30, 6)
    want = defaultdict(float)
    for i, k, v in a:
        for j, k2, w in a:
            if k == k2:
                want[i, j] += v * w
    got = T.gram(frame(spark, a), 4).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.v for r in got} == pytest.approx(dict(want))
    one, two = T._add_products, (np.zeros((2, 2)), np.zeros((2, 2), bool))
    one(*two, [(np.array([0, 1, 1]), np.array([0, 0, 1]), np.ones(3))], [(np.array([1, 0, 0]), np.array([0, 0, 1]), np.array([5.0, 2.0, 3.0]))])
    assert two[0].tolist() == [[2, 3], [7, 3]] and two[1].all()


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], "i long, j long, v double")
    assert M.block_multiply(none, none, 8).count() == 0 and R.to_rows(none).count() == 0


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_tiles_shuffle_fewer_bytes_than_entries(spark):
    """Of stored matrices: entries send themselves and partial sums of the whole result from every task, tiles only themselves."""
    rng = random.Random(6)
    entries = [(i, j, rng.random()) for i in range(200) for j in range(300) if rng.random() < 0.4]
    a = spark.createDataFrame(entries, "i long, j long, v double").repartition(8).cache()
    a.count()
    tiles, turned = cut(T.to_tiles(a)), cut(T.to_tiles(M.transpose(a)))
    at, old = [shuffled(spark)], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for matrices that no task can hold
    try:
        for product in (M.multiply(a, M.transpose(a)), T.to_entries(T.multiply(tiles, turned))):
            got = product.toPandas()
            at.append(shuffled(spark))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < at[2] - at[1] < at[1] - at[0]
    dense, found = np.zeros((200, 300)), np.zeros((200, 200))
    for i, j, v in entries:
        dense[i, j] = v
    found[got.i, got.j] = got.v
    assert np.allclose(found, dense @ dense.T)


def test_products_of_entries_are_not_shuffled(spark):
    """40 rows that share 300 columns make 480,000 products; what is exchanged grows with the 12,000 entries."""
    a = spark.createDataFrame([(i * 1000, j, 1.0 + (i * j) % 5) for i in range(40) for j in range(300)], "i long, j long, v double").repartition(8).cache()
    a.count()
    before = shuffled(spark)
    got = M.multiply(a, M.transpose(a)).agg(F.count("v"), F.sum("v")).first()
    used = shuffled(spark) - before
    want = np.array([[1.0 + (i * j) % 5 for j in range(300)] for i in range(40)])
    assert got[0] == 1600 and got[1] == (want @ want.T).sum() and used < 3_000_000
    plan = M.multiply(a, M.transpose(a))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(gi" in plan and "sum(" not in plan


def test_sums_are_spread_over_enough_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD", 10)
    entries = [(i, j, 1.0) for i in range(20) for j in range(5)]
    a = frame(spark, entries)
    assert M.spread(a, 100, 10).rdd.getNumPartitions() == 10 and M.spread(a, 30, 10).rdd.getNumPartitions() == 3
    got = {(r.i, r.j): r.v for r in M.add(a, M.transpose(a), 200).collect()}
    assert got == {(i, j): (i < 20 and j < 5) + (j < 20 and i < 5) for i in range(20) for j in range(20) if i < 5 or j < 5}


def dealt(sent) -> int:
    """Entries in the chunks of ``_sent``."""
    width = {str(kind): np.dtype(name).itemsize for kind, name in enumerate(T._KINDS)}
    return sum(len(r.i) // width[r.kinds[2]] + len(r.j) // width[r.kinds[3]] for r in sent.collect())


def test_entries_go_only_where_they_have_products(spark):
    """256 rows in 32 squares' sides, 2 entries in each of 500 columns: an entry is sent twice at most, not to 32 squares."""
    rng = random.Random(11)
    entries = [(i, j, 7.0) for j in range(500) for i in rng.sample(range(256), 2)]
    a = frame(spark, entries).cache()
    a.count()
    one = sum(len({i // 8 for i in pair}) * 2 for pair in ([entries[2 * j][0], entries[2 * j + 1][0]] for j in range(500)))
    assert dealt(T._sent(T._side(a, "j", "i", False), True, 8)) == one <= 2 * len(entries)
    both = T._side(a, "j", "i", False).unionByName(T._side(M.transpose(a), "i", "j", True))
    assert dealt(T._sent(both, False, 8)) == 2 * one


def test_sparse_gram_shuffles_about_its_entries(spark):
    """2,048 rows that meet by twos in 4,000 columns: each block of 8 columns meets many squares, each entry two at most."""
    rng = random.Random(13)
    pairs = [rng.sample(range(2048), 2) for _ in range(4000)]
    a = frame(spark, [(i, j, 1.0 + i % 50) for j, pair in enumerate(pairs) for i in pair]).cache()
    a.count()
    before = shuffled(spark)
    got = {(r.i, r.j): r.v for r in T.gram(a, 8).collect()}
    used = shuffled(spark) - before
    want = defaultdict(float)
    for pair in pairs:
        for i in pair:
            for k in pair:
                want[i, k] += (1.0 + i % 50) * (1.0 + k % 50)
    assert got == want and used < 600_000, used


def test_chunks_in_any_pieces(monkeypatch):
    """Inner indexes that span batches, batches that end anywhere, entries that repeat, rows below 0, values of every kind."""
    rng = random.Random(12)
    left = sorted((rng.randrange(12), rng.randrange(-20, 40), rng.choice([1.0, 300.0, -2.0, 0.5])) for _ in range(400))
    right = sorted((rng.randrange(12), rng.randrange(25), rng.choice([1.0, 2.0])) for _ in range(300))
    for sent in (1, 50, 1 << 20):
        monkeypatch.setattr(T, "SENT", sent)
        for other in (None, right):
            want, got = defaultdict(float), defaultdict(float)
            for k, i, v in left:
                for k2, j, w in left if other is None else other:
                    if k == k2:
                        want[i, j] += v * w
            arrays = [None if rows is None else tuple(map(np.array, zip(*rows))) for rows in (left, other)]
            merged = [None if x is None else tuple(T._merged(x[0], np.zeros(len(x[0]), bool), x[1], x[2])[c] for c in (0, 2, 3)) for x in arrays]
            for batch in T._dealt(*merged, 8):
                for gi, gj, kinds, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                    n, m, i, j, v, w = (np.frombuffer(x, T._KINDS[int(kind)]) for x, kind in zip(numbers, kinds))
                    if other is None and gi == gj:
                        m, j, w = n, i, v
                    x = y = 0
                    for p, q in zip(map(int, n), map(int, m)):
                        for r in range(x, x + p):
                            for c in range(y, y + q):
                                at = gi * 8 + int(i[r]), gj * 8 + int(j[c])
                                got[at] += float(v[r]) * float(w[c])
                                if other is None and gi != gj:
                                    got[at[::-1]] += float(v[r]) * float(w[c])
                        x, y = x + p, y + q
            assert got.keys() == want.keys() and got == pytest.approx(want)


def test_inner_indexes_longer_than_what_is_dealt_at_once(spark, monkeypatch):
    monkeypatch.setattr(T, "DEALT", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        entries = [(i - 9, j, 1.0 + i % 3) for j in (0, 4) for i in range(40)] + [(3, 1, 2.0)] * 30
        got = {(r.i, r.j): r.v for r in T.gram(frame(spark, entries), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a = np.zeros((49, 5))
    for i, j, v in entries:
        a[i + 9, j] += v
    want = a @ a.T
    assert got == {(i - 9, k - 9): want[i, k] for i, k in np.argwhere(want).tolist()}


def test_matmul_coo_exchanges_each_entry_once(spark, tmp_path):
    """The query's matrix meets itself: its entries go to their part once, not once for each side."""
    from floeberg import plans

    rng = random.Random(6)
    items = [(rng.randrange(40), rng.randrange(25)) for _ in range(300)]
    spark.createDataFrame([(s, p, 1.0) for s, p in items], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.queries()["matmul_coo"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    want = {}
    for s, p in items:
        for t, q in items:
            if p == q:
                want[s, t] = want.get((s, t), 0.0) + 1.0
    assert {(r.i, r.j): r.v for r in got.collect()} == want
