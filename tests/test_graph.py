import pytest
from pyspark.sql import functions as F

from floeberg.operators import graph as G, infomap as I

LINKS = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
BARBELL = [(a, b, 1.0) for a, b in LINKS] + [(b, a, 1.0) for a, b in LINKS]


def _flow(spark, edges, ids, iterations):
    e = G.normalise(G.proper_edges(spark.createDataFrame(edges, "src long, dst long, w double")))
    nodes = G.teleport_weights(spark.createDataFrame([(i, 1.0) for i in ids], "id long, node_weight double"))
    return G.pagerank(nodes, e, iterations), e


@pytest.fixture(scope="module")
def barbell(spark):
    rates, edges = _flow(spark, BARBELL, range(6), 12)
    fl = G.flow(rates, edges)
    fl.nodes, fl.flows = G.cut(fl.nodes), G.cut(fl.flows)
    return fl, edges


def _parts(spark, f):
    return spark.createDataFrame([(i, f(i)) for i in range(6)], "id long, mod long")


def test_rates_and_code_length(spark, barbell):
    fl, edges = barbell
    p = {r.id: r.p for r in fl.nodes.collect()}
    assert p[0] == pytest.approx(0.14598540146, abs=1e-9) and p[2] == pytest.approx(0.20802919708, abs=1e-9)
    for f, want in ((lambda i: i, 4.474197862), (lambda i: i // 3, 2.517873103), (lambda i: 0, 2.563513992)):
        assert G.code_length(fl, _parts(spark, f)).first()[0] == pytest.approx(want, abs=1e-8)


def test_partition_scores(spark, barbell):
    edges = barbell[1]
    two = _parts(spark, lambda i: i // 3)
    assert G.modularity(edges, two).first()[0] == pytest.approx(0.357142857, abs=1e-8)
    assert G.modularity(edges, _parts(spark, lambda i: i)).first()[0] == pytest.approx(-0.173469388, abs=1e-8)
    assert G.conductance(edges, two).first()[0] == pytest.approx(1 / 7)


def test_sweep_gains(spark, barbell):
    best = {r.id: (r.new_mod, r.dl) for r in I.best_moves(I.move_gains(barbell[0], _parts(spark, lambda i: i))).collect()}
    assert {i: m for i, (m, _) in best.items()} == {0: 1, 1: 0, 2: 0, 3: 4, 4: 5, 5: 4}
    assert best[0][1] == pytest.approx(-0.428330066, abs=1e-8) and best[2][1] == pytest.approx(-0.367891384, abs=1e-8)


def test_gain_equals_difference_of_lengths(spark, barbell):
    fl = barbell[0]
    part = _parts(spark, lambda i: i // 2)
    before = G.code_length(fl, part).first()[0]
    for r in I.move_gains(fl, part).where("id in (2, 5)").collect():
        moved = I.apply_moves(part, spark.createDataFrame([(r.id, r.new_mod)], "id long, new_mod long"))
        assert G.code_length(fl, moved).first()[0] - before == pytest.approx(r.dl, abs=1e-9)


def test_communities_find_the_triangles(spark, barbell):
    got = I.communities(barbell[0], sweeps=3, max_levels=2)
    assert got.code_length == pytest.approx(2.517873103, abs=1e-8)
    groups = {}
    for r in got.partition.collect():
        groups.setdefault(r.mod, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5]]


def test_dangling_chain(spark):
    rates, edges = _flow(spark, [(0, 1, 1.0), (1, 2, 1.0)], range(3), 30)
    p = [r.p for r in rates.orderBy("id").collect()]
    assert p == pytest.approx([0.184416781927, 0.341171046565, 0.474412171508], abs=1e-6)
    assert [r.id for r in rates.where("dangling").collect()] == [2]


def test_contract_and_renumber(spark, barbell):
    fl, names = G.contract(barbell[0], _parts(spark, lambda i: 10 * (i // 3)))
    assert sorted((r.old_id, r.new_id) for r in names.collect()) == [(0, 0), (10, 1)]
    assert fl.flows.count() == 2 and fl.nodes.agg(F.sum("p")).first()[0] == pytest.approx(1)
    ids = spark.createDataFrame([(x,) for x in (7, -3, 7, 90)], "id long")
    assert sorted(map(tuple, G.renumber(ids, "id").collect())) == [(-3, 0), (7, 1), (90, 2)]
    assert G.renumber(ids.limit(0), "id").count() == 0
