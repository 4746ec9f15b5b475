"""Community detection by minimising the map equation, in parallel sweeps.

Every node weighs all modules it is linked to; the best gain is a top-1 by
aggregate, ties to the smaller module.  A batch of moves is kept only if the
recomputed code length falls; otherwise half of it, by a hash, is tried."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.iterate import cut
from .graph import ALPHA, BETA, Flow, code_length, contract, few, modules, node_entropy, plogp


def node_exits(fl: Flow) -> DataFrame:
    """(id, q): exit rate of each node as a module of its own."""
    out = fl.flows.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.sum("f").alias("_out"))
    return fl.nodes.join(out, "id", "left").select("id", (ALPHA * (1 - F.col("tau")) * F.col("p") + BETA * (F.coalesce("_out", F.lit(0.0)) + (1 - F.col("tau")) * F.col("d"))).alias("q"))


def move_gains(fl: Flow, partition: DataFrame, active: DataFrame | None = None, empty_target: bool = False) -> DataFrame:
    """(id, old_mod, new_mod, dl): change of the code length, in bits, of every
    move of a node to a module that it is linked to.

    ``active``: only these ids.  ``empty_target``: also a move to an empty
    module, numbered after the largest, for nodes that share their module."""
    part = partition
    m = cut(modules(fl, part))
    total = m.agg(F.sum("exit")).first()[0] or 0.0
    out = fl.flows.join(few(part.select(F.col("id").alias("dst"), "mod")), "dst").groupBy(F.col("src").alias("id"), "mod").agg(F.sum("f").alias("fo"), F.lit(0.0).alias("fi"))
    into = fl.flows.join(few(part.select(F.col("id").alias("src"), "mod")), "src").groupBy(F.col("dst").alias("id"), "mod").agg(F.lit(0.0).alias("fo"), F.sum("f").alias("fi"))
    links = out.unionByName(into).groupBy("id", "mod").agg(F.sum("fo").alias("fo"), F.sum("fi").alias("fi"))
    me = fl.nodes.join(part, "id").withColumnRenamed("mod", "old").join(node_exits(fl), "id")
    if active is not None:
        me = me.join(active.select("id"), "id", "left_semi")
    old_mod = m.select(F.col("mod").alias("old"), F.col("p").alias("po"), F.col("tau").alias("to"), F.col("d").alias("do"), F.col("exit").alias("qo"), F.col("members").alias("mo"))
    old_link = links.select("id", F.col("mod").alias("old"), F.col("fo").alias("oo"), F.col("fi").alias("oi"))
    me = me.join(old_mod, "old").join(old_link, ["id", "old"], "left").fillna(0.0, ["oo", "oi"])
    new_mod = m.select(F.col("mod").alias("new"), F.col("p").alias("pn"), F.col("tau").alias("tn"), F.col("d").alias("dn"), F.col("exit").alias("qn"))
    moves = me.join(links.withColumnRenamed("mod", "new"), "id").where("new <> old").join(new_mod, "new")
    if empty_target:
        top = (m.agg(F.max("mod")).first()[0] or 0) + 1
        zero = [F.lit(0.0).alias(c) for c in ("fo", "fi", "pn", "tn", "dn", "qn")]
        more = me.where("mo > 1").select(*me.columns, F.lit(top).alias("new"), *zero)
        moves = moves.unionByName(more)
    c = F.col
    give = ALPHA * c("p") + BETA * c("d")
    out_old = BETA * c("oo") + give * (c("to") - c("tau"))
    in_old = BETA * c("oi") + (ALPHA * (c("po") - c("p")) + BETA * (c("do") - c("d"))) * c("tau")
    out_new = BETA * c("fo") + give * c("tn")
    in_new = BETA * c("fi") + (ALPHA * c("pn") + BETA * c("dn")) * c("tau")
    q1 = c("qo") - c("q") + out_old + in_old
    q2 = c("qn") + c("q") - out_new - in_new
    moves = moves.withColumn("q1", q1).withColumn("q2", q2).withColumn("qt", F.lit(total) + c("q1") + c("q2") - c("qo") - c("qn"))
    dl = plogp(c("qt")) - plogp(F.lit(total)) - 2 * (plogp(c("q1")) + plogp(c("q2")) - plogp(c("qo")) - plogp(c("qn")))
    dl = dl + plogp(c("q1") + c("po") - c("p")) + plogp(c("q2") + c("pn") + c("p")) - plogp(c("qo") + c("po")) - plogp(c("qn") + c("pn"))
    return moves.select("id", c("old").alias("old_mod"), c("new").alias("new_mod"), (dl / math.log(2)).alias("dl"))


def best_moves(gains: DataFrame) -> DataFrame:
    """The best move of each node, ties (to 12 places) to the smaller module."""
    best = gains.groupBy("id").agg(F.min(F.struct(F.round("dl", 12).alias("r"), "new_mod", "old_mod", "dl")).alias("m"))
    return best.select("id", "m.old_mod", "m.new_mod", "m.dl")


def accepted(best: DataFrame, threshold: float = 0.0, ordered: bool = True) -> DataFrame:
    """Moves that gain; with ``ordered`` only to larger module numbers, which keeps
    two nodes from trading places in one sweep."""
    out = best.where(F.col("dl") < -threshold - 1e-12)
    return out.where("old_mod < new_mod") if ordered else out


def apply_moves(partition: DataFrame, moves: DataFrame) -> DataFrame:
    return partition.join(moves.select("id", "new_mod"), "id", "left").select("id", F.coalesce("new_mod", "mod").alias("mod"))


def neighbours(fl: Flow, moved: DataFrame) -> DataFrame:
    """The active set of the next sweep: nodes linked to those that moved."""
    out = fl.flows.join(moved.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    into = fl.flows.join(moved.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return out.union(into).distinct()


@dataclass
class Communities:
    partition: DataFrame
    code_length: float
    levels: int


def sweep(fl: Flow, partition: DataFrame, length: float, h: float, active: DataFrame | None = None, threshold: float = 0.0) -> tuple[DataFrame, float, DataFrame | None]:
    """One guarded batch of moves: (partition, code length, nodes that moved or None)."""
    best = cut(best_moves(move_gains(fl, partition, active, empty_target=True)))
    for ordered in (True, False):
        moves = accepted(best, threshold, ordered)
        for halving in range(6):
            batch = cut(moves.where(F.pmod(F.xxhash64("id", F.lit(halving)), F.lit(1 << halving)) == 0) if halving else moves)
            if not batch.limit(1).count():
                break
            new = cut(apply_moves(partition, batch))
            now = code_length(fl, new, h).first()[0]
            if now < length - 1e-12:
                return new, now, batch
    return partition, length, None


def communities(fl: Flow, threshold: float = 1e-4, sweeps: int = 10, prioritise: bool = True, max_levels: int = 10) -> Communities:
    """Sweeps until the gain is under ``threshold``, then contraction, until no level gains."""
    h = node_entropy(fl.nodes).first()[0] or 0.0
    level = Flow(cut(fl.nodes), cut(fl.flows))
    whole = fl.nodes.select("id", F.col("id").alias("mod"))
    total = code_length(level, whole, h).first()[0]
    levels = 0
    while levels < max_levels:
        part = level.nodes.select("id", F.col("id").alias("mod"))
        length, active, before = total, None, total
        for _ in range(sweeps):
            part, new, moved = sweep(level, part, length, h, active)
            gain, length = length - new, new
            if moved is None and active is not None:
                active = None  # the last word is a sweep over all nodes
                continue
            if moved is None or gain < threshold:
                break
            active = cut(neighbours(level, moved)) if prioritise else None
        if before - length < 1e-12:
            break
        level, names = contract(level, part)
        up = part.join(names, part["mod"] == names["old_id"]).select(F.col("id").alias("mod"), F.col("new_id"))
        whole = cut(whole.join(up, "mod").select("id", F.col("new_id").alias("mod")))
        total, levels = length, levels + 1
    return Communities(whole, total, levels)


def sub_modules(fl: Flow, partition: DataFrame, sweeps: int = 2) -> DataFrame:
    """(id, mod, sub): every module searched on its own inner flows, all at once.

    Flows between modules are left out, so no move can leave its module."""
    a, b = partition.select(F.col("id").alias("src"), F.col("mod").alias("_a")), partition.select(F.col("id").alias("dst"), F.col("mod").alias("_b"))
    inner = cut(fl.flows.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst", "f"))
    level = Flow(cut(fl.nodes), inner)
    h = node_entropy(fl.nodes).first()[0] or 0.0
    part = level.nodes.select("id", F.col("id").alias("mod"))
    length = code_length(level, part, h).first()[0]
    for _ in range(sweeps):
        best = cut(best_moves(move_gains(level, part)))
        moves = cut(accepted(best))
        if not moves.limit(1).count():
            break
        new = cut(apply_moves(part, moves))
        now = code_length(level, new, h).first()[0]
        if now >= length - 1e-12:
            break
        part, length = new, now
    return partition.join(part.withColumnRenamed("mod", "sub"), "id")


def sub_module_graph(fl: Flow, subs: DataFrame) -> tuple[Flow, DataFrame]:
    """Sub-modules as nodes, and the module that each new node starts in."""
    level, names = contract(fl, subs.select("id", F.col("sub").alias("mod")))
    start = subs.select(F.col("sub").alias("old_id"), "mod").distinct().join(names, "old_id").select(F.col("new_id").alias("id"), "mod")
    return level, start
