"""Flow-based graph operators over edges(src, dst, w) and nodes(id, ...).

Everything is a join or an aggregate on vertex keys, so both sides of each step
hash on the same key and partial aggregation runs before the shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..plans.iterate import bucketed, cut, discard

ALPHA, BETA = 0.15, 0.85


def plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def combine_edges(raw: DataFrame) -> DataFrame:
    """Duplicate edges summed."""
    return raw.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def proper_edges(edges: DataFrame) -> DataFrame:
    """Without self-links and weights that aren't positive."""
    return edges.where((F.col("src") != F.col("dst")) & (F.col("w") > 0))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def undirected_first_seen(pairs: DataFrame) -> DataFrame:
    """One edge per unordered pair, in the direction of the least ``line``."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    first = pairs.groupBy(low.alias("_a"), high.alias("_b")).agg(F.min(F.struct("line", "src", "dst")).alias("e"))
    return first.select("e.src", "e.dst", F.lit(1.0).alias("w"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def renumber(ids: DataFrame, column: str) -> DataFrame:
    """(old_id, new_id) with new ids 0..n-1 in ascending order of distinct ids.

    Ranks come from counts of range partitions, so no task sorts all ids."""
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    at = F.monotonically_increasing_id()
    own = cut(ids.select(F.col(column).alias("old_id")).distinct().repartitionByRange(parts, "old_id").sortWithinPartitions("old_id").withColumn("_part", F.shiftright(at, 33)).withColumn("_in", at.bitwiseAND((1 << 33) - 1)))
    total, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in own.groupBy("_part").count().collect()):  # one row per partition
        starts.append((part, total))
        total += n
    table = spark.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return own.join(F.broadcast(table), "_part").select("old_id", (F.col("_start") + F.col("_in")).alias("new_id"))


def teleport_weights(nodes: DataFrame) -> DataFrame:
    """tau = node_weight / total, by one scalar aggregate; weights that aren't positive count as 1."""
    nodes = nodes.withColumn("node_weight", F.when(F.col("node_weight") > 0, F.col("node_weight").cast("double")).otherwise(1.0))
    total = nodes.agg(F.sum("node_weight")).first()[0] or 1.0
    return nodes.withColumn("tau", F.col("node_weight") / F.lit(float(total)))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def few(df: DataFrame) -> DataFrame:
    """The side of a join with a row a vertex: hashed in each task, so that the edges that it meets are never sorted."""
    return df.hint("shuffle_hash")


def normalise(edges: DataFrame) -> DataFrame:
    """Weights divided by their source's sum (aggregate and join back: no window
    has to hold a hub's edges)."""
    out = edges.groupBy("src").agg(F.sum("w").alias("_s"))
    return edges.join(few(out), "src").select("src", "dst", (F.col("w") / F.col("_s")).alias("w"))


def normalise_with(laid: DataFrame, edges: DataFrame) -> DataFrame:
    """normalise() of edges that lie by their source already, with sums counted from ``edges``, the same ones: only the sums are exchanged."""
    out = edges.groupBy("src").agg(F.sum("w").alias("_s"))
    return laid.join(few(out), "src").select("src", "dst", (F.col("w") / F.col("_s")).alias("w"))


@dataclass
class Flow:
    """nodes(id, p, tau, d) with d the dangling rate, and flows(src, dst, f)."""

    nodes: DataFrame
    flows: DataFrame


@dataclass
class Linked:
    """Edges laid out once for a loop over states of their vertices.

    ``edges`` (src, part, dst, w) lie in buckets by their source, and a state in
    as many by its id, so a step joins them where they lie and only the partial sums of
    the targets are exchanged.  The edges of a hub, a source with over ``hub``
    edges, are dealt over several parts, and so is the hub's row of the state."""

    edges: DataFrame
    parts: DataFrame | None  # (id, parts) of the hubs; None if there are none
    buckets: int

    @property
    def keys(self) -> list[str]:
        return ["id"] if self.parts is None else ["id", "part"]

    def write(self, state: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """A state (id, ...), written so that it meets the edges without an exchange, and aggregates over it, taken while it is written."""
        if self.parts is None:
            laid = state.withColumn("part", F.lit(0))
        else:
            wide = state.join(F.broadcast(self.parts), "id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
            laid = wide.repartition(self.buckets, "id", "part")
        seen = Observation()
        once = laid.withColumn("_once", F.col("part") == 0).observe(seen, F.count(F.lit(1)).alias("_rows"), *(how.alias(name) for name, how in sums.items())).drop("_once")
        return bucketed(once, self.keys, self.buckets), {name: seen.get.get(name) or 0 for name in sums}

    def inflow(self, state: DataFrame, value: str) -> DataFrame:
        """(id, _in): sum of w times the source's ``value`` over the edges into each vertex."""
        on = state.select(F.col("id").alias("src"), "part", F.col(value).alias("_v"))
        met = self.edges.join(few(on), ["src"] if self.parts is None else ["src", "part"])
        return met.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("_v")).alias("_in"))


def link(edges: DataFrame, buckets: int | None = None, hub: int | None = None, normal: bool = False) -> Linked:
    """``edges`` laid out for a loop; ``hub``: a quarter of a bucket's share if not given.  ``normal``: weights are divided by their source's sum on the way."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges if hasattr(edges, "_written") else cut(edges)
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total, top = degrees.agg(F.sum("n"), F.max("n")).first()
    most = hub or max(100_000, (total or 0) // (4 * buckets))
    if (top or 0) <= most:
        laid = edges.select("src", "dst", "w").repartition(buckets, "src")
        laid = (normalise_with(laid, edges) if normal else laid).select("src", F.lit(0).alias("part"), "dst", "w")
        return Linked(bucketed(laid, ["src"], buckets), None, buckets)
    # With the default bound there are at most four times as many hubs as buckets.
    hubs = cut(degrees.where(F.col("n") > most).select(F.col("src").alias("id"), F.ceil(F.col("n") / most).cast("int").alias("parts")))
    edges = normalise(edges) if normal else edges
    own = edges.join(F.broadcast(hubs.withColumnRenamed("id", "src")), "src", "left")
    laid = own.select("src", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "dst", "w")
    return Linked(bucketed(laid.repartition(buckets, "src", "part"), ["src", "part"], buckets), hubs, buckets)


def rank_step(linked: Linked, state: DataFrame, scale: float, loose: float) -> DataFrame:
    """The next rates, before division by their sum; ``state``'s are to be multiplied by ``scale``."""
    old = F.col("p") * F.lit(scale)
    inflow = linked.inflow(state, "p")
    new = F.lit(ALPHA + BETA * loose) * F.col("tau") + BETA * scale * F.coalesce("_in", F.lit(0.0))
    return state.where("part = 0").join(few(inflow), "id", "left").select("id", "tau", "dangling", old.alias("_old"), new.alias("p"))


def pagerank(nodes: DataFrame, edges: DataFrame | Linked, iterations: int = 200, least_iterations: int = 50, tolerance: float = 1e-15, buckets: int | None = None, hub: int | None = None) -> DataFrame:
    """(id, p, tau, dangling): rates with teleport and dangling mass.

    p' = (alpha + beta * dangling mass) * tau + beta * sum of w * p, divided by its
    sum; ends when the L1 change is small after ``least_iterations``.  ``nodes``
    has id and tau; ``edges`` are normalised, and may be laid out already.  Each step is one job: the edges stay
    where they lie, and the sums are taken by the tasks that write the state."""
    linked = edges if isinstance(edges, Linked) else link(edges, buckets, hub)
    sources = linked.edges.select(F.col("src").alias("id"), F.lit(False).alias("_d")).distinct()
    base = nodes.select("id", "tau").repartition(linked.buckets, "id").join(sources, "id", "left")
    base = base.select("id", "tau", F.coalesce("_d", F.lit(True)).alias("dangling"), F.lit(1.0).alias("p"))
    once = F.col("_once")
    state, seen = linked.write(base, n=F.count_if(once), loose=F.count_if(once & F.col("dangling")))
    scale = 1.0 / max(seen["n"], 1)
    loose = seen["loose"] * scale
    sums = {"total": F.sum(F.when(once, F.col("p"))), "loose": F.sum(F.when(once & F.col("dangling"), F.col("p"))), "change": F.sum(F.when(once, F.abs(F.col("p") - F.col("_old"))))}
    for k in range(iterations):
        before = state
        state, seen = linked.write(rank_step(linked, state, scale, loose), **sums)
        discard(before)
        scale = 1.0 / (seen["total"] or 1.0)
        loose = seen["loose"] * scale
        if k + 1 >= least_iterations and seen["change"] <= tolerance:
            break
    return state.where("part = 0").select("id", (F.col("p") * F.lit(scale)).alias("p"), "tau", "dangling")


def flow(ranked: DataFrame, edges: DataFrame) -> Flow:
    """Edge flows p * w, and each node's dangling rate."""
    flows = edges.join(few(ranked.select(F.col("id").alias("src"), "p")), "src").select("src", "dst", (F.col("p") * F.col("w")).alias("f"))
    return Flow(ranked.select("id", "p", "tau", F.when(F.col("dangling"), F.col("p")).otherwise(0.0).alias("d")), flows)


def node_entropy(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum(plogp(F.col("p"))).alias("h"))


def modules(fl: Flow, partition: DataFrame) -> DataFrame:
    """(mod, p, tau, d, members, exit, stay) of partition(id, mod)."""
    inside = fl.nodes.join(partition, "id").groupBy("mod").agg(F.sum("p").alias("p"), F.sum("tau").alias("tau"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("members"))
    return _exits(inside, between(fl.flows, partition).groupBy(F.col("m1").alias("mod")).agg(F.sum("f").alias("_out")))


def _exits(inside: DataFrame, out: DataFrame) -> DataFrame:
    exit_ = ALPHA * (1 - F.col("tau")) * F.col("p") + BETA * (F.coalesce("_out", F.lit(0.0)) + (1 - F.col("tau")) * F.col("d"))
    return inside.join(out, "mod", "left").withColumn("exit", exit_).withColumn("stay", F.col("exit") + F.col("p")).drop("_out")


def between(flows: DataFrame, partition: DataFrame) -> DataFrame:
    """(m1, m2, f) of flows between different modules."""
    one = flows.join(few(partition.select(F.col("id").alias("src"), F.col("mod").alias("m1"))), "src")
    both = one.join(few(partition.select(F.col("id").alias("dst"), F.col("mod").alias("m2"))), "dst")
    return both.where("m1 <> m2").groupBy("m1", "m2").agg(F.sum("f").alias("f"))


def code_length(fl: Flow, partition: DataFrame, h: float | None = None) -> DataFrame:
    """One row: the map equation in bits.  ``h``: sum of p log p of the first level's nodes."""
    own = node_entropy(fl.nodes).withColumnRenamed("h", "_h") if h is None else None
    m = modules(fl, partition).agg(F.sum("exit").alias("q"), F.sum(plogp(F.col("exit"))).alias("a"), F.sum(plogp(F.col("stay"))).alias("b"))
    m = m.crossJoin(own) if own is not None else m.withColumn("_h", F.lit(h))  # one row each
    return m.select(((plogp(F.col("q")) - 2 * F.col("a") + F.col("b") - F.col("_h")) / math.log(2)).alias("code_length"))


def contract(fl: Flow, partition: DataFrame) -> tuple[Flow, DataFrame]:
    """Modules become nodes 0..n-1 in ascending order; (old mod -> new id) too."""
    names = renumber(partition, "mod")
    nodes = fl.nodes.join(partition, "id").groupBy("mod").agg(F.sum("p").alias("p"), F.sum("tau").alias("tau"), F.sum("d").alias("d"))
    nodes = nodes.join(names, nodes["mod"] == names["old_id"]).select(F.col("new_id").alias("id"), "p", "tau", "d")
    a, b = names.select(F.col("old_id").alias("m1"), F.col("new_id").alias("src")), names.select(F.col("old_id").alias("m2"), F.col("new_id").alias("dst"))
    flows = between(fl.flows, partition).join(a, "m1").join(b, "m2").select("src", "dst", "f")
    return Flow(cut(nodes), cut(flows)), names


def members(partition: DataFrame) -> DataFrame:
    """(mod, members, small): sizes, and whether the module has at most 10,000."""
    return partition.groupBy("mod").agg(F.count(F.lit(1)).alias("members")).withColumn("small", F.col("members") <= 10_000)


def induced_subgraph(edges: DataFrame, partition: DataFrame, mod) -> DataFrame:
    """Edges inside one module with its nodes renumbered from 0."""
    names = renumber(partition.where(F.col("mod") == F.lit(mod)), "id")
    a, b = names.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), names.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def _labelled(edges: DataFrame, partition: DataFrame) -> DataFrame:
    one = edges.join(few(partition.select(F.col("id").alias("src"), F.col("mod").alias("m1"))), "src")
    return one.join(few(partition.select(F.col("id").alias("dst"), F.col("mod").alias("m2"))), "dst")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """q = sum over modules of e - a^2, where a is the share of edge ends credited
    to the target's module and e the share of those inside a module."""
    per = _labelled(edges, partition).groupBy("m2").agg(F.count(F.lit(1)).alias("a"), F.sum(F.when(F.col("m1") == F.col("m2"), 1).otherwise(0)).alias("e"))
    n = per.agg(F.sum("a").alias("n"))
    return per.crossJoin(F.broadcast(n)).agg(F.sum(F.col("e") / F.col("n") - (F.col("a") / F.col("n")) ** 2).alias("q"))


def conductance(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Share of edges between modules."""
    return _labelled(edges, partition).agg((F.sum(F.when(F.col("m1") != F.col("m2"), 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("c"))


def conductance_per_module(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(mod, c): share of a module's edge ends that belong to edges between modules."""
    ends = _labelled(edges, partition).select(F.explode(F.array("m1", "m2")).alias("mod"), (F.col("m1") != F.col("m2")).cast("double").alias("x"))
    return ends.groupBy("mod").agg((F.sum("x") / F.count(F.lit(1))).alias("c"))


def conductance_sum(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: the sum of the modules' conductances."""
    return conductance_per_module(edges, partition).agg(F.sum("c").alias("c"))


def block_split(df: DataFrame, order: str, parts: int) -> DataFrame:
    """df with ``part``: contiguous ranges of nearly equal size in ``order``."""
    ranks = renumber(df, order)
    n = ranks.count()
    part = F.expr(f"cast((new_id * {parts}L) div {max(n, 1)}L as int)")
    return df.join(ranks.select(F.col("old_id").alias(order), part.alias("part")), order)


def random_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Deterministic permutation."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def tree_ranks(partition: DataFrame, rates: DataFrame) -> DataFrame:
    """(mod, rank, id, p): modules renumbered from 1, members ranked by id."""
    rank = F.row_number().over(Window.partitionBy("mod").orderBy("id"))
    names = renumber(partition, "mod").select(F.col("old_id").alias("mod"), (F.col("new_id") + 1).alias("module"))
    return partition.join(rates.select("id", "p"), "id").withColumn("rank", rank).join(F.broadcast(names) if names.count() < 100_000 else names, "mod").select(F.col("module").alias("mod"), "rank", "id", "p")
