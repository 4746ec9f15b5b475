"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks.  With weight w, the i-th block (from 0) of a source
is released at slot floor(i/w) and due by slot ceil((i+1)/w); serving the
released block with the earliest deadline keeps every source within one block
of w times the slots served, at all times.  Weights are rationals: given ones
are taken as the decimals they are written as, so 0.6, 0.3 and 0.1 are exactly
6, 3 and 1 blocks of every 10 slots.  The schedule of one such period, made once
on the driver from the weights alone, repeats without end: a block's slot is
arithmetic on its number, and all rows are placed by joins with small tables of
known size.  A period longer than what is left is made only up to there, so there
are never more slots than blocks.  The default weights (roots of the row counts)
are rounded each by itself, to the nearest of 1024 steps between two powers of
two: no weight depends on how many sources there are.

When a source runs out, the others go on with their target weights, divided by
what is left of the total, so every row is placed once and none is dropped or
repeated.  Sources of one weight and one number of blocks take turns as one class,
which holds the windows of each of them, so any number of sources is scheduled by
its few different sizes, in the same way for all.

Cases: a null source is a source of its own; the last block of a source may be
short; repeated rows and ties are placed apart; ids may have any type; weights
of absent sources are left out, and sources without a weight over 0 get the
smallest one given; an empty table gives no rows.  Only DataFrame operations
touch the rows."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.iterate import cut
from .common import BROADCAST_ROWS, maybe_broadcast

BLOCK, PERIOD, TEMPER = 64, 1024, 0.5
#: Denominators that are exact in a period of 16,384 steps.
EXACT = 1 << 14
#: Deadlines beyond all slots, of very small weights.
NEVER = 1 << 62
#: Most given names that are compared one by one (more are joined), and hashed parts in which a class numbers its members.
MOST_SOURCES, GROUPS = 512, 64
#: Rows of a source that are ranked together in one task.
RANKED = 2_048
_NULL = "\x00null"
SCHEDULE = ("block", "phase", "slot", "release", "deadline", "place")


def held(weight: float | Fraction, period: int | None) -> Fraction:
    """The weight as a fraction: exact without ``period`` or with a denominator up to it, else
    the nearest of ``period`` steps between two powers of two.  Other weights have no part in it."""
    w = weight if isinstance(weight, Fraction) else Fraction(str(weight))
    if period is None or w <= 0 or w.denominator <= period:
        return w
    power = w.numerator.bit_length() - w.denominator.bit_length()
    octave = Fraction(2) ** (power if Fraction(2) ** power <= w else power - 1)
    return round(w / octave * period) * octave / period


def shares_of(weights: Mapping[str, float], period: int | None = None) -> dict[str, int]:
    """Whole numbers in proportion to the weights, each held by itself."""
    given = {s: held(w, period) for s, w in weights.items()}
    least = min((w for w in given.values() if w > 0), default=Fraction(1))
    given = {s: w if w > 0 else least for s, w in given.items()}
    size = lcm(*(w.denominator for w in given.values()))
    return {s: int(w * size) for s, w in given.items()}


def earliest_deadline(shares: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> list[tuple[str, int, int, int]]:
    """(source, number, release, deadline) of each slot of one period.

    With ``blocks``, only up to the last block of the first source to end."""
    period = sum(shares.values())
    release = lambda q, i: i * period // q
    due = lambda q, i: -(-(i + 1) * period // q)
    waiting = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(shares[s], i), -shares[s], s, i))
        deadline, _, s, i = heapq.heappop(ready)
        out.append((s, i, release(shares[s], i), deadline))
        if blocks and i + 1 == blocks[s]:
            break
        if i + 1 < shares[s]:
            heapq.heappush(waiting, (release(shares[s], i + 1), s, i + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int | None = None) -> list[dict]:
    """Stretches of constant shares until all blocks are placed.

    Each has its period's schedule, how often it repeats, and where its slots
    and each source's blocks begin.  There are two for each source at most: whole
    periods, and the part of one up to the last block of the first source to end."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    target = shares_of({s: weights[s] for s in left}, period) if left else {}
    out, slot = [], 0
    while left:
        unit = gcd(*(target[s] for s in left))
        shares = {s: target[s] // unit for s in left}
        repeat = min(left[s] // shares[s] for s in left)
        plan = earliest_deadline(shares, None if repeat else left)
        repeat = max(repeat, 1)
        used: dict[str, int] = {}
        for s, *_ in plan:
            used[s] = used.get(s, 0) + 1
        out.append({"plan": plan, "repeat": repeat, "slot": slot, "length": len(plan), "period": sum(shares.values()), "first": {s: done[s] for s in used}, "used": used})
        slot += len(plan) * repeat
        for s, k in used.items():
            done[s] += k * repeat
            left[s] -= k * repeat
        left = {s: n for s, n in left.items() if n}
    return out


def _tables(spark: SparkSession, plan: list[dict]) -> tuple[DataFrame, DataFrame]:
    # Classes go by numbers here, as the slots may be as many as the blocks.
    number = {s: k for k, s in enumerate(dict.fromkeys(s for ph in plan for s in ph["used"]))}
    spans = [(s, number[s], p, ph["first"][s], ph["first"][s] + ph["used"][s] * ph["repeat"], ph["used"][s], ph["slot"], ph["length"]) for p, ph in enumerate(plan) for s in ph["used"]]
    slots = [(number[s], p, i, k, r, min(d, NEVER)) for p, ph in enumerate(plan) for k, (s, i, r, d) in enumerate(ph["plan"])]
    a = spark.createDataFrame(spans, "_class string, _no int, phase int, _from long, _to long, _share long, _slot0 long, _length long")
    b = spark.createDataFrame(slots, "_no int, phase int, _number long, _place long, _release long, _deadline long")
    return maybe_broadcast(a, len(spans)), maybe_broadcast(b, len(slots))


def classes_of(sizes: DataFrame, weights: Mapping[str, float] | None, block: int, temper: float) -> DataFrame:
    """sizes (_source, _rows) with _class, _members and _member: sources of one weight and as many blocks are one class.

    They take turns in it.  Class block k, of m members with weight w each, lies in the window from k / (m w) to
    (k + 1) / (m w), which is inside the window of its member's own block k div m, from (k div m) / w on: a class
    keeps the windows of all its members.  Sources with a weight of their own are classes of their own."""
    own = list(weights or ())
    alone = F.col("_source").isin(own) if 0 < len(own) <= MOST_SOURCES else F.lit(False)
    if len(own) > MOST_SOURCES:
        named = sizes.sparkSession.createDataFrame([(s, True) for s in own], "_source string, _own boolean")
        sizes = sizes.join(maybe_broadcast(named, len(own)), "_source", "left")
        alone = F.coalesce("_own", F.lit(False))
    # By default equal counts give equal weights; where weights are given, all sources without one have the least.
    shared = F.col("_rows") if weights is None else F.ceil(F.col("_rows") / block)
    name = F.when(alone, F.concat(F.lit("s"), "_source")).otherwise(F.concat(F.lit("n"), shared.cast("string")))
    keyed = sizes.withColumn("_class", name).select("_source", "_rows", "_class")
    # A member's number in its class: its place in a hashed part plus the members of the parts before.
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_source", F.lit(7)), F.lit(GROUPS)))
    per = keyed.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_class", "_part", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_class")).alias("_members"))
    at = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_source"))
    numbered = keyed.withColumn("_at", at).join(before, ["_class", "_part"])
    return numbered.select("_source", "_rows", "_class", "_members", (F.col("_before") + F.col("_at") - 1).alias("_member"))


def pfair_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int | None = None, temper: float = TEMPER, record: bool = False) -> DataFrame:
    """docs with block, phase, slot, release, deadline and place.

    Columns of docs with these names are left out; ``record`` adds the whole row as _row.
    ``slot`` orders the blocks and ``place`` the rows in one.  Without weights,
    a source's weight is its row count to the power ``temper``, held in ``period`` (1024) steps;
    given weights are exact, or with a ``period`` held in it."""
    spark = docs.sparkSession
    # The record travels as one column, so its names can't clash with the schedule's.
    named = docs.select("doc_id", F.struct("*").alias("_row"), F.coalesce(F.col("source"), F.lit(_NULL)).alias("_source"))
    members = cut(classes_of(named.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows")), weights, block, temper))
    classes = members.groupBy("_class").agg(F.first("_members").alias("m"), F.max(F.ceil(F.col("_rows") / block)).alias("blocks"), F.max("_rows").alias("rows")).collect()  # with all sources, at most the root of twice the rows, and the given names
    if weights is None:
        each = {r["_class"]: held(r.rows**temper, period or PERIOD) for r in classes}
    else:
        given = [held(w, period) for w in weights.values() if w > 0]
        each = {r["_class"]: held(weights[r["_class"][1:]], period) if r["_class"][0] == "s" else 0 for r in classes}
        least = min([w for w in each.values() if w > 0], default=min(given, default=Fraction(1)))
        each = {c: w if w > 0 else least for c, w in each.items()}
    plan = phases({r["_class"]: r.blocks * r.m for r in classes}, {r["_class"]: each[r["_class"]] * r.m for r in classes})
    spans, slots = _tables(spark, plan)
    n_sources = members.count()
    shares = members.select("_source", "_class", "_members", "_member", F.ceil(F.col("_rows") / RANKED).alias("_buckets"))
    # A row's rank in its source: its rank in a hashed bucket plus the buckets before.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(5))).otherwise(F.xxhash64("doc_id", F.lit(5)))
    bucketed = named.withColumn("_hash", key).join(maybe_broadcast(shares, n_sources), "_source").withColumn("_bucket", F.pmod("_hash", "_buckets"))
    counts = bucketed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_source", "_bucket", (F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    n_buckets = members.agg(F.sum(F.ceil(F.col("_rows") / RANKED))).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id"))
    ranked = bucketed.withColumn("_in", inside).join(maybe_broadcast(before, n_buckets, BROADCAST_ROWS), ["_source", "_bucket"])
    rank = F.col("_before") + F.col("_in") - 1
    numbered = ranked.withColumn("block", F.floor(rank / block).cast("long")).withColumn("place", (rank % block).cast("int"))
    numbered = numbered.withColumn("_turned", F.col("block") * F.col("_members") + F.col("_member"))
    placed = numbered.join(spans, "_class").where((F.col("_turned") >= F.col("_from")) & (F.col("_turned") < F.col("_to")))
    turn = F.floor((F.col("_turned") - F.col("_from")) / F.col("_share")).cast("long")
    placed = placed.withColumn("_turn", turn).withColumn("_number", (F.col("_turned") - F.col("_from")) % F.col("_share")).join(slots, ["_no", "phase", "_number"])
    base = F.col("_slot0") + F.col("_turn") * F.col("_length")
    return placed.select(
        *(F.col(f"_row.`{c}`") for c in docs.columns if c not in SCHEDULE), *([F.col("_row")] if record else []), "block", "phase",
        (base + F.col("_place")).alias("slot"), (base + F.col("_release")).alias("release"), (base + F.col("_deadline")).alias("deadline"), "place")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """docs, all columns, physically ordered by the schedule."""
    mixed = pfair_mix(docs, weights, record=True, **options).select("_row", "slot", "place")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return mixed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select("_row.*")


def op4_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return pfair_mix(docs)
