"""Near-duplicate classes by DartMinHash signatures and banding.

A document is the weighted set of its five-word shingles (lower-cased, split
at white space; the weight is how often a shingle occurs).  Darts are thrown by
hashes into unit regions of (weight, rank); those inside an element's weight
and below a rank bound that fits the document's total weight survive, each
falls on one of K coordinates, and the earliest dart of every coordinate is
kept.  Two documents agree on a coordinate with probability equal to their
weighted Jaccard similarity, at a cost of the set's size plus about K log K.

Documents that share a band (R coordinates in order) are compared.  Inside a
bucket the signatures of at most BLOCK texts meet in one step.  Two rounds
propose each text's best partners; these pairs are verified by the exact
weighted Jaccard similarity (0.8 or more), and verified links form classes.  Where
likely pairs between different classes are left, the sets of their texts are
sent to their blocks and every such pair is verified there.  Larger buckets
are cut into blocks whose best-connected texts meet again in the next level;
then blocks meet two at a time, except for pairs inside a bucket's largest
class.  So all texts of different classes that share a band are compared; a
task holds about BLOCK texts, whatever a group's size.

Cases: null counts as empty; texts with the same words are one text with
copies, and empty texts are copies of each other; a text under five words is
one shingle of all its words; repeated rows are copies; an empty table gives
no rows.  class_id is the smallest doc_id of the class; its first row is kept."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, from_files, lookup, lower_ascii, materialize, maybe_broadcast, mix64, slices, small_batches, text_bytes, with_locator, without_rows, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, R = 25, 5
K = BANDS * R
BLOCK, HUBS = 2048, 16
#: Agreeing coordinates for a pair to be verified: over three standard errors below 0.8.
LIKELY = int(K * 0.68)
#: Places in a text's list of likely partners that the first rounds propose.
ROUNDS = ((0, 1), (1, 4))

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def shingles(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements and their rows, sorted, and two digests of each text's words.

    The n-th occurrence of a shingle is an element of its own, so that set
    operations on elements are weighted ones on shingles."""
    n = len(at) - 1
    low = lower_ascii(part)
    starts, ends, rows = words(low, at)
    h = word_hashes(low, starts, ends)
    per = np.bincount(rows, minlength=n)
    first = np.cumsum(per) - per
    place = (np.arange(len(rows)) - first[rows]).astype(np.uint64)
    digests = []
    for c in _C[:2]:
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h + (place + np.uint64(1)) * c), out=sums[1:])
        digests.append((sums[first + per] - sums[first] + per.astype(np.uint64) * c).view(np.int64))
    whole = np.zeros(len(h), np.uint64)
    size = np.minimum(per, SHINGLE)[rows].astype(np.uint64)
    for k in range(SHINGLE):
        inside = np.uint64(k) < size
        word = np.zeros(len(h), np.uint64)
        word[: max(len(h) - k, 0)] = h[k:]
        whole = np.where(inside, (whole * _C[2]) ^ mix64(word + np.uint64(k)), whole)
    ok = place.astype(np.int64) + np.minimum(per, SHINGLE)[rows] <= per[rows]
    key = np.sort((rows[ok].astype(np.uint64) << np.uint64(48)) | (mix64(whole[ok]) >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
    row = (key >> np.uint64(48)).astype(np.int64)
    return mix64((key & np.uint64((1 << 48) - 1)) + nth.astype(np.uint64) * _C[3]), row, *digests


def dart_minhash(elements: np.ndarray, rows: np.ndarray, n_rows: int, k: int = K, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature (n_rows x k identifiers of the earliest darts) and which rows have one.

    ``rows`` is sorted.  Weights may be any positive numbers (1 if not given);
    a weight w takes the unit regions [0, 1), [1, 2), ... up to w."""
    w = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    total = np.bincount(rows, w, n_rows)
    sig, rank_of = np.zeros(n_rows * k, np.uint64), np.full(n_rows * k, np.inf)
    has = total > 0
    bound = np.where(has, (k * math.log(k) + 2 * k) / np.where(has, total, 1), 0.0)
    todo = has.copy()
    if weights is not None:  # one element for each unit region of weight
        units = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(w)), units)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
        elements, rows, room = np.where(unit > 0, mix64(elements[at] + unit.astype(np.uint64) * _C[5]), elements[at]), rows[at], w[at] - unit
    else:
        room = None
    while todo.any():
        mine = np.flatnonzero(todo[rows])
        cells = np.ceil(bound[rows[mine]]).astype(np.int64)
        own = np.repeat(mine, cells)
        cell = np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
        base = mix64(elements[own] + (cell + 1).astype(np.uint64) * _C[0])
        darts = np.searchsorted(_POISSON, (base >> np.uint64(11)).astype(float) * 2.0**-53, "right")
        pick = np.repeat(np.arange(len(own)), darts)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(base[pick] + (nth + 1).astype(np.uint64) * _C[1])
        rank = cell[pick] + (dart >> np.uint64(11)).astype(float) * 2.0**-53
        row = rows[own[pick]]
        ok = rank < bound[row]
        if room is not None:
            ok &= (mix64(dart + _C[4]) >> np.uint64(11)).astype(float) * 2.0**-53 < room[own[pick]]
        dart, rank, row = dart[ok], rank[ok], row[ok]
        slot = row * k + (((mix64(dart + _C[2]) & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(rank_of, slot, rank)
        won = rank == rank_of[slot]
        sig[slot[won]] = mix64(dart[won] + _C[3])
        todo &= np.isinf(rank_of.reshape(n_rows, k)).any(1)
        bound[todo] *= 2
    return sig.reshape(n_rows, k), has


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), (b + 1) * int(_C[4]) & (1 << 64) - 1, np.uint64)
        for c in range(b * R, b * R + R):
            key = mix64(key * _C[2] + sig[:, c])
        out[:, b] = key
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """A written row for each document: its id, locator, word digests, bands and sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                m = hi - lo
                elements, rows, d1, d2 = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sig, has = dart_minhash(elements, rows, m)
                keys = band_keys(sig)[has]
                cuts = pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32))
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(K), m, [None, pa.py_buffer(np.ascontiguousarray((sig >> np.uint64(56)).astype(np.uint8)))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, m), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(cuts, pa.array(keys.ravel())), sketch.cast(pa.binary()), batch.column("_loc").slice(lo, m)],
                    ["doc_id", "d1", "d2", "bands", "sketch", "_loc"])

    out = docs.select("doc_id", "text", "_loc").mapInArrow(run, f"doc_id {kind}, d1 long, d2 long, bands array<long>, sketch binary, _loc string")
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "dart-signatures")


def _propose(uid: np.ndarray, sketch: np.ndarray, comp: np.ndarray, first: int, last: int, hubs: int):
    """Pairs at places first..last of each text's likely partners, texts with more, and hubs."""
    m = len(uid)
    agree = np.empty((m, m), np.uint8)
    step = max(1, (1 << 23) // (m * K))
    for lo in range(0, m, step):
        agree[lo : lo + step] = (sketch[lo : lo + step, None, :] == sketch[None, :, :]).sum(-1, dtype=np.uint8)
    np.fill_diagonal(agree, 0)
    likely = agree >= LIKELY
    degree = likely.sum(1)
    order = np.lexsort((uid, -degree))
    a, b, left = [], [], np.zeros(m, bool)
    for k in range(1, m):
        j, before = order[k], order[:k]
        near = before[likely[j, before]]
        if not len(near):
            continue
        near = near[np.argsort(-agree[j, near].astype(int), kind="stable")]
        other = comp[near] != comp[j]
        now = near[first:last][other[first:last]]
        a.append(np.full(len(now), uid[j]))
        b.append(uid[now])
        if other[last:].any():
            left[near[last:][other[last:]]] = left[j] = True
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else empty), (np.concatenate(b) if b else empty), uid[left], uid[order[:hubs]]


def _settle(uid, sketch, comp, elements) -> tuple[np.ndarray, np.ndarray]:
    """All links between likely texts of different classes, by their sets."""
    up = {int(c): int(c) for c in comp}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    mine = [np.sort(e) for e in elements]
    size = np.array([len(e) for e in mine])
    a, b = [], []
    for j in range(1, len(uid)):
        root = top(int(comp[j]))
        near = np.flatnonzero((sketch[:j] == sketch[j]).sum(1) >= LIKELY)
        near = near[[top(int(comp[i])) != root for i in near]] if len(near) else near
        if not len(near):
            continue
        flat = np.concatenate([mine[i] for i in near])
        at = np.minimum(np.searchsorted(mine[j], flat), size[j] - 1)
        both = np.add.reduceat((mine[j][at] == flat).astype(np.int64), np.cumsum(size[near]) - size[near])
        for i in near[both >= SIMILARITY * (size[near] + size[j] - both) - 1e-9]:
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y:
                up[x] = y
                a.append(uid[i])
                b.append(uid[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _in_blocks(members: DataFrame, first: int, last: int, settle: bool = False) -> DataFrame:
    """(kind, key, a, b) from members (key, blk, uid, sketch, comp): kind 0 a
    pair, 1 a text with more likely pairs and its block, 2 a hub of a block.

    With ``settle``, members also have elements, and the pairs are all links."""
    many = HUBS  # the driver's value, not a worker's
    ready = members.repartition("key", "blk").sortWithinPartitions("key", "blk", "uid")

    def flush(held):
        key, blk, uid, sketch, comp = (np.concatenate([h[i] for h in held]) for i in range(5))
        elements = [e for h in held for e in h[5]] if settle else []
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])])
        out: list[list] = [[], [], [], []]
        for lo, hi in zip(new, np.append(new[1:], len(key)), strict=True):
            if settle:
                a, b = _settle(uid[lo:hi], sketch[lo:hi], comp[lo:hi], elements[lo:hi])
                for k, x in enumerate((np.zeros(len(a), np.int32), np.full(len(a), key[lo]), a, b)):
                    out[k].append(x)
                continue
            several = hi - lo > 1 and (comp[lo:hi] != comp[lo]).any()
            if not several and blk[lo] < 0:
                continue
            if several:
                a, b, left, hubs = _propose(uid[lo:hi], sketch[lo:hi], comp[lo:hi], first, last, many)
            else:
                a, b, left, hubs = uid[:0], uid[:0], uid[:0], uid[lo : min(hi, lo + many)]
            if blk[lo] < 0:
                hubs = hubs[:0]
            for kind, x, y in ((0, a, b), (1, left, np.full(len(left), blk[lo])), (2, hubs, hubs)):
                out[0].append(np.full(len(x), kind, np.int32))
                out[1].append(np.full(len(x), key[lo]))
                out[2].append(x)
                out[3].append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["kind", "key", "a", "b"])

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, K)
            now = [batch.column("key").to_numpy(), batch.column("blk").to_numpy(), batch.column("uid").to_numpy(), raw, batch.column("comp").to_numpy()]
            if settle:
                flat = batch.column("elements")
                values, sizes = flat.flatten().to_numpy(), flat.value_lengths().to_numpy()
                now.append(np.split(values, np.cumsum(sizes)[:-1]))
            edges = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            cut = int(edges[-1]) if len(edges) else 0
            fresh = bool(held) and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0])
            if fresh:
                yield from flush(held)
                held, rows = [], 0
            if cut:
                yield from flush([*held, [x[:cut] for x in now]])
                held, rows = [], 0
            held.append([x[cut:] for x in now])
            rows += len(now[0]) - cut
        if held:
            yield from flush(held)

    return ready.select("key", "blk", "uid", "sketch", "comp", *(["elements"] if settle else [])).mapInArrow(run, "kind int, key long, a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(uid, comp) of every linked uid; comp is one uid of its component.

    Each round gives a vertex the label of its smallest neighbour and contracts
    the links to labels; links inside one label vanish, so the work is about
    twice the links in all.  Written tables cut the lineage."""
    left = materialize(links.select("a", "b").where("a <> b").distinct(), "dart-links")
    labels = materialize(left.select(F.explode(F.array("a", "b")).alias("uid")).distinct().withColumn("comp", F.col("uid")), "dart-labels")
    while left.limit(1).count():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(ends.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to")), "dart-to")
        before = labels, left
        moved = left.join(to, "a").select("b", F.col("to").alias("x")).join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        labels = materialize(labels.join(to.select(F.col("a").alias("comp"), "to"), "comp", "left").select("uid", F.coalesce("to", "comp").alias("comp")), "dart-labels")
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dart-links")
        discard(to, *before)
    discard(left)
    return labels


def _merge(comps: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """comps with the components that new links between uids join."""
    if comps is None:
        return components(fresh)
    ends = fresh
    for end in ("a", "b"):
        ends = ends.join(comps.withColumnRenamed("uid", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    more = components(ends)
    old = comps.join(more.select(F.col("uid").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("uid", F.coalesce("new", "comp").alias("comp"))
    return materialize(old.unionAll(more.join(comps, "uid", "left_anti").select("uid", "comp")), "dart-comps")


def _sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(uid, elements) of the wanted texts; each is read from its own document, found by its locator."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            want = [batch.column(c).to_numpy() for c in ("w1", "w2")]
            for lo, hi in slices(offsets):
                elements, row, d1, d2 = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ok = (d1 == want[0][lo:hi]) & (d2 == want[1][lo:hi])
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(cuts), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(lo, hi - lo), made], ["uid", "elements"]).filter(pa.array(ok))

    side = wanted.select("_loc", "uid", F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    return docs.select("_loc", "text").join(maybe_broadcast(side, rows), "_loc").select("uid", "w1", "w2", "text").mapInArrow(run, "uid long, elements array<long>")


def _across(members: DataFrame) -> DataFrame | None:
    """(key, blk, uid): two blocks at a time of the large buckets (key, uid, comp)
    that still have several classes, or None.

    Pairs inside the largest class of a bucket need no comparison; every other
    pair of texts of different classes meets in at least one pair of blocks."""
    per = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("c")).where("c > top.n")
    half = BLOCK // 2
    top = materialize(top.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.n") / half).alias("mains"), F.ceil((F.col("c") - F.col("top.n")) / half).alias("rests")), "dart-large")
    n = top.count()
    if not n:
        return None
    rest = F.col("comp") != F.col("main")
    dealt = members.join(maybe_broadcast(top, n), "key").withColumn("own", F.pmod(F.xxhash64("uid", "key"), F.when(rest, F.col("rests")).otherwise(F.col("mains"))))
    pair = lambda a, b, odd: -((a * (1 << 24) + b) * 2 + 2 + odd)  # noqa: E731  negative: no hubs
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda q: pair(F.col("own"), q, 0))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda q: q != F.col("own"))
    with_rest = F.transform(others, lambda q: pair(F.least("own", q), F.greatest("own", q), 1))
    as_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda q: pair(q, F.col("own"), 0))
    blocks = F.when(rest, F.concat(with_main, with_rest)).otherwise(as_main)
    return materialize(dealt.select("key", F.explode(blocks).alias("blk"), "uid"), "dart-across")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_texts and kept of every row (and _loc, if there)."""
    if 4 * HUBS > BLOCK:
        raise ValueError("at most a quarter of a block's texts can be its hubs")
    small_batches(docs.sparkSession)
    loc = ["_loc"] if "_loc" in docs.columns else []
    if from_files(docs):
        docs = (docs if loc else with_locator(docs)).select("doc_id", "text", "_loc")
    else:  # rows without a lasting name are written once
        docs = materialize(docs.select("doc_id", "text", *loc), "dart-input")
        docs = docs if loc else with_locator(docs)
    signed = sign(docs)
    rows = signed.count()
    groups = materialize(signed.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("copies")).select("d1", "d2", "first.doc_id", "first.uid", "copies"), "dart-texts")
    texts = signed.join(groups.select("uid"), "uid", "left_semi")
    bands = texts.select("uid", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialize(bands.join(shared, "key"), "dart-buckets")
    likely = members.select("uid").distinct()
    sketches = materialize(signed.select("uid", "_loc", "d1", "d2", "sketch").join(likely, "uid", "left_semi"), "dart-sketches")
    n_likely = sketches.count()
    comps, sets = None, None
    if n_likely:
        sets = materialize(_sets(docs, sketches.select("_loc", "uid", "d1", "d2"), n_likely), "dart-sets")

    def with_class(rows_: DataFrame) -> DataFrame:
        if comps is None:
            return rows_.withColumn("comp", F.col("uid"))
        return rows_.join(comps, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))

    def verify(found: DataFrame) -> DataFrame | None:
        """Links the proposed pairs that are alike; the texts with more likely pairs, if any."""
        nonlocal comps
        pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sa, sb = sets.select(F.col("uid").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("uid").alias("b"), F.col("elements").alias("eb"))
        both = F.size(F.array_intersect("ea", "eb"))
        fresh = materialize(pairs.join(sa, "a").join(sb, "b").where(both >= SIMILARITY * (F.size("ea") + F.size("eb") - both) - 1e-9).select("a", "b"), "dart-verified")
        if fresh.limit(1).count():
            comps = _merge(comps, fresh)
        more = found.where("kind = 1").select("key", F.col("b").alias("blk"), F.col("a").alias("uid"))
        return more if more.limit(1).count() else None

    def settle(more: DataFrame) -> None:
        nonlocal comps
        last_ones = with_class(more.join(sketches.select("uid", "sketch"), "uid")).join(sets, "uid")
        fresh = materialize(_in_blocks(last_ones, 0, BLOCK, settle=True).select("a", "b").distinct(), "dart-verified")
        if fresh.limit(1).count():
            comps = _merge(comps, fresh)

    more = None
    for first, last in ROUNDS if n_likely else ():
        full, found, level = with_class(members.join(sketches.select("uid", "sketch"), "uid")), None, 0
        while True:  # levels: the hubs of a large bucket's blocks meet in the next
            blk = F.when(F.col("c") <= BLOCK, F.lit(-1 - level)).otherwise(F.pmod(F.xxhash64("uid", "key"), F.ceil(F.col("c") / (BLOCK // 2))) + level * (1 << 40)).cast("long")
            got = materialize(_in_blocks(full.withColumn("blk", blk), first, last), "dart-pairs")
            found = got if found is None else found.unionAll(got)
            hubs = got.where("kind = 2").select("key", F.col("a").alias("uid"))
            if not hubs.limit(1).count():
                break
            sizes = hubs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            full, level = hubs.join(sizes, "key").join(full.select("uid", "sketch", "comp").dropDuplicates(["uid"]), "uid"), level + 1
        more = verify(found)
        if more is None:
            break
    if more is not None:
        settle(more)
    across = _across(with_class(members.where(F.col("c") > BLOCK))) if n_likely else None
    for first, last in ROUNDS if across is not None else ():
        more = verify(materialize(_in_blocks(with_class(across.join(sketches.select("uid", "sketch"), "uid")), first, last), "dart-pairs"))
        if more is None:
            break
    if across is not None and more is not None:
        settle(more)
    labels = groups.join(comps, "uid", "left").withColumn("comp", F.coalesce("comp", "uid")) if comps is not None else groups.withColumn("comp", F.col("uid"))
    classes = labels.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    classes = classes.select("comp", F.col("best.doc_id").alias("class_id"), F.col("best.uid").alias("best_uid"), "class_size", "n_texts")
    named = lookup(labels.select("comp", "d1", "d2", "copies"), classes.withColumn("size", F.col("n_texts")), "comp", "size", rows)
    named = named.select(F.struct("d1", "d2").alias("digest"), "copies", "class_id", "best_uid", "class_size", "n_texts")
    out = lookup(signed.select("doc_id", "uid", *loc, F.struct("d1", "d2").alias("digest")), named, "digest", "copies", rows)
    return out.select("doc_id", "class_id", "class_size", "n_texts", (F.col("uid") == F.col("best_uid")).alias("kept"), *loc)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns kept."""
    return without_rows(docs, materialize(near_duplicates(with_locator(docs)).where(~F.col("kept")).select("_loc"), "dart-dropped"))


def op3_dartminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
