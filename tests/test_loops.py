"""Loops that keep their partitioning: plans without an exchange of the edges, hubs in parts."""

import re

import pytest
from pyspark.sql import functions as F

from floeberg.operators import graph as G, solve as V
from floeberg.plans.iterate import bucketed, discard


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def star(spark):
    """A hub that links to all, all to the next, and two without links."""
    links = [(0, k, 1.0) for k in range(1, 300)] + [(k, k % 37 + 1, 1.0 + k % 3) for k in range(1, 250) if k % 37 + 1 != k]
    edges = G.normalise(spark.createDataFrame(links, "src long, dst long, w double"))
    nodes = G.teleport_weights(spark.range(302).select("id", (F.lit(1.0) + F.col("id") % 4).alias("node_weight")))
    return nodes, edges


def plain(nodes, edges, steps):
    tau = {r.id: r.tau for r in nodes.collect()}
    links = [(r.src, r.dst, r.w) for r in edges.collect()]
    out = {s for s, _, _ in links}
    p = dict.fromkeys(tau, 1 / len(tau))
    for _ in range(steps):
        loose = sum(p[i] for i in p if i not in out)
        new = {i: (G.ALPHA + G.BETA * loose) * tau[i] for i in p}
        for s, d, w in links:
            new[d] += G.BETA * w * p[s]
        total = sum(new.values())
        p = {i: x / total for i, x in new.items()}
    return p


def nodes_without_links(edges):
    return set(range(302)) - {r.src for r in edges.select("src").distinct().collect()}


@pytest.mark.parametrize("hub", [None, 20])
def test_rates_with_and_without_hubs(spark, hub):
    nodes, edges = star(spark)
    want = plain(nodes, edges, 6)
    got = {r.id: (r.p, r.dangling) for r in G.pagerank(nodes, edges, 6, buckets=4, hub=hub).collect()}
    assert {i: p for i, (p, _) in got.items()} == pytest.approx(want, abs=1e-12)
    assert {i for i, (_, d) in got.items() if d} == set(nodes_without_links(edges))


@pytest.mark.parametrize("hub", [None, 20])
def test_steps_exchange_no_edges(spark, no_broadcast, hub):
    nodes, edges = star(spark)
    linked = G.link(edges, 4, hub)
    base = nodes.select("id", "tau", F.lit(False).alias("dangling"), F.lit(0.1).alias("p")).repartition(4, "id")
    state, _ = linked.write(base)
    for _ in range(2):
        step = G.rank_step(linked, state, 1.0, 0.0)
        plan = step._jdf.queryExecution().executedPlan().toString()
        # Everything below an exchange: partial sums of targets, and with hubs the state, but never the edges as they are.
        exchanges = re.findall(r"Exchange hashpartitioning\(([^,#]+)#", plan)
        assert len(exchanges) == (1 if hub is None else 2) and "dst" in exchanges
        assert not re.search(r"Exchange hashpartitioning\((src|part)", plan) and plan.count("Exchange") == len(exchanges)
        state, _ = linked.write(step.drop("_old"))
    if hub:
        sizes = [r.n for r in linked.edges.where("src = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 15 and sum(sizes) == 299 and max(sizes) < 60


def test_bucketed_tables(spark, no_broadcast):
    a = bucketed(spark.range(1000).select("id", (F.col("id") * 2).alias("x")), ["id"], 4)
    b = bucketed(spark.range(0, 1000, 3).repartition(4, "id"), ["id"], 4)
    both = a.join(b, "id")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 334
    assert both.agg(F.sum("x")).first()[0] == 2 * sum(range(0, 1000, 3))
    name = a._table
    discard(a, b)
    assert not spark.catalog.tableExists(name)


def test_rates_of_nothing(spark):
    nodes, edges = star(spark)
    assert G.pagerank(nodes.limit(0), edges.limit(0), 2).count() == 0
    got = G.pagerank(nodes.limit(2), edges.limit(0), 2).collect()
    assert sum(r.p for r in got) == pytest.approx(1) and all(r.dangling for r in got)


def dominant(spark, n, seed):
    import random

    rng = random.Random(seed)
    entries = [(i, j, -rng.random()) for i in range(n) for j in rng.sample(range(n), 4) if i != j]
    entries += [(i, 0, -0.5) for i in range(1, n) if not any(e[:2] == (i, 0) for e in entries)]  # a column that all rows have
    total = [sum(-v for i, _, v in entries if i == k) for k in range(n)]
    a = spark.createDataFrame([*entries, *((i, i, 2 * total[i] + 1) for i in range(n))], "i long, j long, v double")
    return a, spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 5 - 1.0).alias("x"))


def solved(a, b, n):
    import numpy as np

    dense, right = np.zeros((n, n)), np.zeros(n)
    for r in a.collect():
        dense[r.i, r.j] = r.v
    for r in b.collect():
        right[r.i] = r.x
    return dict(enumerate(np.linalg.solve(dense, right)))


def test_relaxation_reaches_the_solution(spark):
    a, b = dominant(spark, 60, 3)
    assert {r.i: r.x for r in V.relax(a, b, 1e-9).collect()} == pytest.approx(solved(a, b, 60), abs=1e-7)


def test_only_rows_with_a_residual_send(spark):
    """A path with a load at one end: rows that the load hardly reaches never send, and those that are done stop."""
    n, sent = 60, []
    a = spark.createDataFrame([(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], "i long, j long, v double")
    b = spark.range(n).select(F.col("id").alias("i"), (F.col("id") == 0).cast("double").alias("x"))
    got = V.relax(a, b, 1e-6, trace=sent)
    assert {r.i: r.x for r in got.collect()} == pytest.approx(solved(a, b, n), abs=1e-5)
    assert sent[0] == 1 and sent[-1] == 0 and sent[-2] < max(sent) < 15


def test_jacobi_steps(spark):
    import numpy as np

    a, b = dominant(spark, 30, 4)
    dense, right, x = np.zeros((30, 30)), np.array([k % 5 - 1.0 for k in range(30)]), np.zeros(30)
    for r in a.collect():
        dense[r.i, r.j] = r.v
    for _ in range(4):
        x = x + (right - dense @ x) / np.diag(dense)
    assert {r.i: r.x for r in V.jacobi(a, b, 4).collect()} == pytest.approx(dict(enumerate(x)))


def test_steps_sort_no_edges(spark, no_broadcast):
    """The state is hashed in each task; a sorted join would sort the edges in every step."""
    nodes, edges = star(spark)
    linked = G.link(edges, 4)
    state, _ = linked.write(nodes.select("id", "tau", F.lit(False).alias("dangling"), F.lit(0.1).alias("p")).repartition(4, "id"))
    plan = G.rank_step(linked, state, 1.0, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


SF = "/root/testdata/sf0.001"


def folders(spark):
    import os

    from floeberg.plans.iterate import shared_dir

    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("step-")}


def test_a_system_is_written_once(spark):
    """Links, diagonal, entries where they lie, and the state."""
    from floeberg.plans import solving

    before = folders(spark)
    a, b = solving.system(spark, SF)
    got = V.jacobi(a, b, 0)
    assert got.count() == b.count() > 0 and len(folders(spark) - before) == 4


@pytest.mark.parametrize("hub", [None, 20])
def test_weights_are_divided_while_edges_are_laid_out(spark, hub):
    _, edges = star(spark)
    raw = edges.withColumn("w", F.col("w") * (1 + F.col("src") % 3))
    got = {(r.src, r.dst): r.w for r in G.link(raw, 4, hub, normal=True).edges.collect()}
    assert got == pytest.approx({(r.src, r.dst): r.w for r in G.normalise(raw).collect()})


def test_edges_of_the_tables_are_written_twice(spark):
    """As they are counted, and normalised where they lie; and the vertices, and the first and last state."""
    from floeberg.plans.tables import ranked

    before = folders(spark)
    rates, edges = ranked(spark, SF, 2)
    assert len(folders(spark) - before) == 4 and edges.count() > rates.count() > 0


def test_labels_meet_flows_where_they_lie(spark, no_broadcast):
    """Between modules: flows are exchanged by their target only."""
    from floeberg.plans.tables import by_tens, flow

    fl = flow(spark, SF)
    plan = G.between(fl.flows, by_tens(fl.nodes))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dst" in plan and "hashpartitioning(src" not in plan and "SortMergeJoin" not in plan


def test_exits_of_single_nodes_need_no_labels(spark, no_broadcast):
    from floeberg.operators import infomap as I

    nodes, edges = star(spark)
    fl = G.flow(G.pagerank(nodes, edges, 2, buckets=4), edges)
    out = I.node_exits(fl)
    assert not re.search(r"Exchange hashpartitioning\((dst|m1)", out._jdf.queryExecution().executedPlan().toString())
    single = G.modules(fl, fl.nodes.select("id", F.col("id").alias("mod")))
    assert {r.id: r.q for r in out.collect()} == pytest.approx({r.mod: r.exit for r in single.collect()})
