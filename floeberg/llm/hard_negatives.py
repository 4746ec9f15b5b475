"""Hard-negative mining by a Voronoi-partition nearest-neighbour join.

A higher inner product is a shorter distance once every vector x gets one more
component sqrt(M^2 - |x|^2), M the greatest norm, and every anchor gets 0 there.
In that space rows go to the cell of their nearest pivot.  Within a cell they
are sorted by their distance from the pivot and cut into blocks; anchors are cut
into groups along a chain of neighbouring pivots.  By the triangle inequality an
anchor q can use a row x of pivot p only if |d(q,p) - d(x,p)| is at most the
distance of the worst partner that q may still need, so a block goes only to the
groups with such an anchor, and there it is joined exactly.

Two joins follow each other.  The first finds the positives; its bound is the
fifth best score among the rows of the pivot sample.  The second finds the
negatives; the positives' scores bound it from both sides.

The driver holds ``most_pivots`` pivots and a sample of at most ``SAMPLE`` rows,
which set bounds and cells but no result; every row is joined.  Tasks keep the
best rows of each anchor while they read, so an anchor has few rows to merge.

Cases: rows with a null id, label or vector, or a null or non-finite component
take no part; a shorter vector has zeros at its end, an empty one only zeros; a
row with the anchor's id is never its partner; a repeated anchor row answers
once, a repeated other row is a row of its own; a zero score has zero scores as
negatives, a negative one none; anchors without positives or negatives give no
rows; scores are exact below 2^63; an empty table gives no rows; extra columns
are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_BYTES, materialize, maybe_broadcast, small_batches

#: Rows of the sample that pivots come from, of a block, of a group; values in a block.
SAMPLE, BLOCK, GROUP, BLOCK_VALUES = 4096, 2048, 1024, 1 << 18
MOST_PIVOTS, FIRST = 256, 5
#: Groups whose best rows a task holds before it sends them on.
MOST_HELD = 32
_LOW = np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, norm2) of the rows that take part: q = floor(256 x), label moved on where the id is divisible by 7."""

    def run(batches):
        for batch in batches:
            ids, labels, lists = (batch.column(k) for k in range(3))
            lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lens)), lens)
            use = ~np.array([c.is_null().to_numpy(zero_copy_only=False) for c in (ids, labels, lists)]).any(0)
            use &= np.bincount(row, ~np.isfinite(x), len(lens)) == 0
            x, row = x[use[row]], row[use[row]]
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(256 * x), -(2.0**62), 2.0**62).astype(np.int64)
            norm = np.bincount(row, q.astype(float) ** 2, len(lens))[use]
            i, k = (c.filter(pa.array(use)).cast(pa.int64()).to_numpy() for c in (ids, labels))
            k = np.where(i % 7 == 0, np.fmod(k + 1, 10), k)
            ends = np.concatenate([[0], np.cumsum(lens[use])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.ListArray.from_arrays(pa.array(ends), pa.array(q)), pa.array(norm)], ["vec_id", "label", "q", "norm2"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label long, q array<long>, norm2 double")


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, with zeros at the end of shorter ones."""
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class Space:
    """The space with one component more, its pivots, and the sample they come from."""

    def __init__(self, dim: int, top: float, ids, labels, q, k: int):
        self.dim, self.top = dim, top
        #: Type in which inner products are exact: no partial sum is over the greatest squared norm.
        self.kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        self.slack = 1e-6 * math.sqrt(top) + 1e-9
        self.ids, self.labels, self.sample = ids, labels, q
        points = self.lift(q)
        pivots = points[:: max(1, len(points) // k)][:k]
        for _ in range(6):  # cells about their means
            own = self.distances(points, pivots).argmin(1)
            n = np.bincount(own, minlength=len(pivots))
            pivots = np.array([points[own == c].mean(0) if n[c] else pivots[c] for c in range(len(pivots))])
        order, left = [], list(range(len(pivots)))
        while left:  # a chain of near pivots
            order.append(left.pop(0 if not order else int(self.distances(pivots[order[-1:]], pivots[left])[0].argmin())))
        self.pivots = pivots[order]

    def lift(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.concatenate([q, np.sqrt(np.maximum(self.top - (q * q).sum(1), 0))[:, None]], 1)

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors from the pivots."""
        return self.distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1), self.pivots)

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from each anchor of rows with that score."""
        return np.sqrt(np.maximum((q.astype(float) ** 2).sum(1) + self.top - 2 * score, 0))

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (a.astype(self.kind) @ x.astype(self.kind).T).astype(np.int64)


def find_space(rows: DataFrame, most_pivots: int) -> tuple[Space, int, int] | None:
    """The space, the number of rows and that of anchors."""
    n, anchors, dim, top = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % 100 == 0), F.max(F.size("q")), F.max("norm2")).first()
    if not anchors:
        return None
    most = max(64, min(SAMPLE, (1 << 21) // max(dim, 1)))
    order = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    share = min(1.0, 1.2 * (most + 100) / n)
    got = rows.where(order <= int(share * (1 << 30))).select("vec_id", "label", "q", order.alias("o")).orderBy("o", "vec_id", "label", "q").limit(most).drop("o").toArrow().combine_chunks()
    column = lambda name: got.column(name).combine_chunks()
    k = max(1, min(most_pivots, math.isqrt(n) // 8, got.num_rows))
    return Space(max(dim, 1), float(top), column("vec_id").to_numpy(), column("label").to_numpy(), matrix(column("q"), max(dim, 1)), k), n, anchors


def in_cells(rows: DataFrame, space) -> DataFrame:
    """Each row with its cell and the distance from the pivot."""

    def run(batches):
        s = space.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = s.distances(s.lift(matrix(part.column("q"), s.dim)), s.pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "label", "q", "cell", "dist"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, "vec_id long, label long, q array<long>, cell int, dist double")


def packed(rows: DataFrame, space, most: int, by_cell: bool) -> DataFrame:
    """Runs of at most ``most`` sorted rows as one row with their ids, labels and vectors; by_cell: of one cell, with the range of distances."""
    key = ["cell", "dist", "vec_id"] if by_cell else ["cell", "vec_id"]

    def run(batches):
        s = space.value
        limit = max(16, min(most, BLOCK_VALUES // s.dim))
        own: list = []
        size, now = 0, None

        def told():
            table = pa.Table.from_batches(own).combine_chunks()
            c = {name: table.column(name).combine_chunks() for name in table.column_names}
            ids, labels, dist = (c[n].to_numpy() for n in ("vec_id", "label", "dist"))
            order = np.argsort(ids, kind="stable")
            q = matrix(c["q"], s.dim)[order].astype(np.int64 if s.kind is np.int64 else s.kind)
            return pa.RecordBatch.from_pydict({"cell": pa.array([now], pa.int32()), "lo": [float(dist.min())], "hi": [float(dist.max())], "ids": pa.array([ids[order]], pa.list_(pa.int64())), "labels": pa.array([labels[order]], pa.list_(pa.int64())), "q": pa.array([q.tobytes()], pa.binary())})

        for batch in batches:
            cell, at = batch.column("cell").to_numpy(), 0
            while at < len(cell):
                if own and (size == limit or by_cell and cell[at] != now):
                    yield told()
                    own, size = [], 0
                now = int(cell[at])
                till = min(len(cell), at + limit - size)
                if by_cell:
                    till = min(till, int(np.searchsorted(cell, now, "right")))
                own.append(batch.slice(at, till - at))
                size, at = size + till - at, till
        if own:
            yield told()

    sorted_rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return sorted_rows.mapInArrow(run, "cell int, lo double, hi double, ids array<long>, labels array<long>, q binary").withColumn("number", F.monotonically_increasing_id())


class Best:
    """For each slot the first k rows by score, then id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _LOW)
        self.id = np.zeros((slots, k), np.int64)
        self.used = np.zeros((slots, k), bool)

    @property
    def last(self) -> np.ndarray:
        """A score below which nothing can enter, for each slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        old_slot, old = np.nonzero(self.used & np.isin(np.arange(len(self.used)), slot)[:, None])
        s, v, i = (np.concatenate(x) for x in ((slot, old_slot), (score, self.score[old_slot, old]), (ids, self.id[old_slot, old])))
        order = np.lexsort((i, -v, s))
        s, v, i = s[order], v[order], i[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        keep = place < self.k
        at = s[keep], place[keep]
        self.score[at], self.id[at], self.used[at] = v[keep], i[keep], True


class _Group:
    """Anchors of one group as a task sees them."""

    def __init__(self, space: Space, row: dict, k: int):
        self.ids, self.labels = np.array(row["a_ids"], np.int64), np.array(row["a_labels"], np.int64)
        self.q = np.frombuffer(row["a_q"], space.kind).reshape(len(self.ids), space.dim)
        if row.get("found") is None:
            self.limits, self.best = None, Best(len(self.ids), k)
        else:
            self.limits = limits(row["found"], len(self.ids), k)
            self.best = Best(len(self.ids) * k, k)

    def add(self, space: Space, ids, labels, x) -> None:
        score = space.scores(self.q, x)
        same = self.labels[:, None] == labels
        if self.limits is None:
            a, c = np.nonzero(same & (self.ids[:, None] != ids) & (score >= self.best.last[:, None]))
            self.best.add(a, score[a, c], ids[c])
            return
        k = self.limits.shape[1]
        low, high = need(self.limits)
        a, c = np.nonzero(~same & (score >= low[:, None]) & (score <= high[:, None]))
        v, i = score[a, c], ids[c]
        for r in range(k):
            top = self.limits[a, r]
            ok = (top >= 0) & (v <= top) & (v >= top - top // 5) & (v >= self.best.last[a * k + r])
            self.best.add(a[ok] * k + r, v[ok], i[ok])


def limits(found: list, n: int, k: int) -> np.ndarray:
    """Scores of the positives of each anchor, in order; -1 for none, or below 0."""
    out = np.full((n, k), -1, np.int64)
    for place, rank, score in found:
        out[place, rank - 1] = max(score, -1)
    return out


def need(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of scores that an anchor's negatives can have; empty if it has no positive of 0 or more."""
    high = tops.max(1)
    low = np.where(tops >= 0, tops - tops // 5, np.iinfo(np.int64).max).min(1)  # 80 % of the score, rounded up
    return low, high


def served(groups: DataFrame, space, k: int) -> DataFrame:
    """(group, cell, from, to): the distances from the pivot between which a group needs the rows of a cell."""
    columns = [c for c in ("group", "a_ids", "a_labels", "a_q", "found") if c in groups.columns]

    def run(batches):
        s = space.value
        for batch in batches:
            for row in batch.to_pylist():
                g = _Group(s, row, k)
                if g.limits is None:
                    score, ok = s.scores(g.q, s.sample), (g.labels[:, None] == s.labels) & (g.ids[:, None] != s.ids)
                    low = np.sort(np.where(ok, score.astype(float), -np.inf), 1)[:, -k] if len(s.ids) >= k else np.full(len(g.ids), -np.inf)
                    near, use = np.zeros(len(low)), np.full(len(low), True)
                else:
                    low, high = (x.astype(float) for x in need(g.limits))
                    use = high >= 0
                    near = s.reach(g.q, high) - s.slack
                if not use.any():
                    continue
                far = np.where(np.isfinite(low), s.reach(g.q, np.where(np.isfinite(low), low, 0)), np.inf) + s.slack
                d = s.of_anchors(g.q)
                first = np.maximum(d - far[:, None], near[:, None] - d)[use].min(0)
                last = (d + far[:, None])[use].max(0)
                p = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(p, row["group"])), pa.array(np.arange(p, dtype=np.int32)), pa.array(first), pa.array(last)], ["group", "cell", "from", "to"])

    return groups.select(*columns).mapInArrow(run, "group long, cell int, from double, to double")


def joined(blocks: DataFrame, groups: DataFrame, space, n_blocks: int, n_anchors: int, k: int) -> DataFrame:
    """(group, place, anchor_id, rank, id, score): the best rows that each task finds; rank is the positive's, 0 where positives are sought."""
    s = space.value
    wanted = served(groups, space, k)
    n_groups = groups.count()
    wanted = maybe_broadcast(wanted, n_groups * len(s.pivots))
    b, w = blocks.alias("b"), wanted.alias("w")
    pairs = b.join(w, (F.col("b.cell") == F.col("w.cell")) & (F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to"))).select("group", "number", "ids", "labels", "q")
    small = n_anchors * (s.dim + 3 + 3 * k) * 8 <= BROADCAST_BYTES
    if small:
        both = pairs.join(F.broadcast(groups), "group")
    else:  # a group's blocks are dealt over several tasks
        salts = -(-n_blocks // 512)
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = pairs.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["group", "salt"])
    columns = ["group", "ids", "labels", "q", "a_ids", "a_labels", "a_q", *(["found"] if "found" in groups.columns else [])]

    def told(number, g):
        slot, place = np.nonzero(g.best.used)
        wide = 1 if g.limits is None else k
        a = slot // wide
        rank = slot % wide + (g.limits is not None)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), number)), pa.array(a), pa.array(g.ids[a]), pa.array(rank.astype(np.int32)), pa.array(g.best.id[slot, place]), pa.array(g.best.score[slot, place])], ["group", "place", "anchor_id", "rank", "id", "score"])

    def run(batches):
        s, held = space.value, {}
        for batch in batches:
            for at in range(batch.num_rows):
                number = batch.column("group")[at].as_py()
                if number not in held:
                    if len(held) >= MOST_HELD:
                        for each in list(held):
                            yield told(each, held.pop(each))
                    held[number] = _Group(s, {c: batch.column(c)[at].as_py() for c in columns if c[:2] == "a_" or c == "found"}, k)
                ids, labels = (batch.column(c)[at].values.to_numpy() for c in ("ids", "labels"))
                held[number].add(s, ids, labels, np.frombuffer(batch.column("q")[at].as_py(), s.kind).reshape(len(ids), s.dim))
        for number, g in held.items():
            yield told(number, g)

    return both.select(*columns).mapInArrow(run, "group long, place long, anchor_id long, rank int, id long, score long")


def hard_negatives(vectors: DataFrame, k: int = FIRST, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the anchors' first k positives the first k negatives."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(quantised(vectors), "negatives-rows")
    if (found := find_space(rows, most_pivots)) is None:
        return spark.createDataFrame([], schema)
    local, _, n_anchors = found
    space = spark.sparkContext.broadcast(local)
    cells = in_cells(rows, space)
    blocks = materialize(packed(cells, space, BLOCK, True), "negatives-blocks")
    anchors = in_cells(rows.where("vec_id % 100 = 0").dropDuplicates(["vec_id", "label", "q"]), space)
    groups = materialize(packed(anchors, space, GROUP, False).select(F.col("number").alias("group"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("q").alias("a_q")), "negatives-groups")
    n_blocks = blocks.count()
    best = joined(blocks, groups, space, n_blocks, n_anchors, k)
    order = Window.partitionBy("group", "place").orderBy(F.desc("score"), "id")
    positives = materialize(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives-positives")
    found = positives.groupBy("group").agg(F.collect_list(F.array("place", F.col("rank").cast("long"), "score")).alias("found"))  # k for each anchor of a group
    best = joined(blocks, materialize(groups.join(found, "group"), "negatives-wanted"), space, n_blocks, n_anchors, k)
    order = Window.partitionBy("group", "place", "rank").orderBy(F.desc("score"), "id")
    negatives = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    own = positives.select("group", "place", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(own, ["group", "place", "rank"]).select("anchor_id", "positive_id", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, x.vec_id AS x, a.label = x.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, x.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, x) <= 5),
n AS (
  SELECT p.a AS anchor_id, p.x AS positive_id, n.x AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.x ORDER BY n.score DESC, n.x) AS rank
  FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
