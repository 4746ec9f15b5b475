"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over hashed words and word beginnings is trained with numpy
from confirmed toxic texts (positive) and all other texts (unlabelled, toxic
ones among them).  The risk is R = pi*R_p+ + max(0, R_u- - pi*R_p-), where pi
is the share of toxic texts; when the bracket is negative, a step undoes it.
The confirmed texts are left out of the unlabelled ones, so these have a share of
toxic texts that is lower by them, and that one stands in the bracket.

Features are chosen by their likelihood ratio between all positive texts and all
texts, counted on the executors in one aggregation; the driver gets only the
chosen ones.  The gradient steps see at most ``most_positive`` positive and
``most_unlabelled`` unlabelled texts, chosen by a hash of the id; every text is
scored whole.

Cases: null counts as empty; empty texts get the model's bias; equal texts get
equal scores; a doc_id labelled twice counts as toxic if any label says so;
without positive labels every score is 0; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LETTERS, crc_mod, lower_ascii, maybe_broadcast, merge_counts, mix64, slices, small_batches, text_bytes, word_hashes, words

BUCKETS = 1 << 22
#: Lengths in bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)
MOST_POSITIVE, MOST_UNLABELLED, FEATURES = 8_000, 24_000, 4_096
LEAST_RATIO, LEAST_LIFT = 8.0, 5.0
#: Buckets that a task counts before it sends them on.
MOST_HELD = 1 << 19
THRESHOLD = 0.3
#: Cost of a missed toxic text in false alarms.
MISS = 2.0


def _features(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and word beginning of lower-cased texts."""
    starts, ends, rows = words(part, at, LETTERS)
    hashes, where = [word_hashes(part, starts, ends)], [rows]
    for n in BEGINNINGS:
        ok = ends - starts >= n
        hashes.append(word_hashes(part, starts[ok], starts[ok] + n) + np.uint64(n))
        where.append(rows[ok])
    return (mix64(np.concatenate(hashes)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(where)


def _each(batch, name: str = "text"):
    data, offsets = text_bytes(batch.column(name))
    for lo, hi in slices(offsets):
        yield lo, hi, *_features(lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])


def confirmed(labels: DataFrame) -> tuple[DataFrame, float]:
    """The ids labelled toxic, and their share of the labelled ones."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where("toxic = 1").select("doc_id"), float(known.agg(F.avg("toxic")).first()[0] or 0.0)


def choose_sample(marked: DataFrame, n: int, most_positive: int, most_unlabelled: int) -> DataFrame:
    """(doc_id, fit) of the rows to fit on: 1 for confirmed ones, 0 for others."""
    order = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    ids = marked.where("doc_id is not null")
    yes = ids.where("positive = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive)
    share = min(1.0, 1.2 * (most_unlabelled + 100) / max(n, 1))
    no = ids.where("positive = 0").where(order < int(share * (1 << 30))).select("doc_id").distinct().orderBy(order, "doc_id").limit(most_unlabelled)
    return yes.withColumn("fit", F.lit(1)).unionByName(no.withColumn("fit", F.lit(0)))


def choose_features(marked: DataFrame, n_yes: int, n_all: int, most: int) -> np.ndarray:
    """Buckets that positives have more often, by likelihood ratio over all rows of (text, positive)."""

    def run(batches):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen, pending = none, []
        for batch in batches:
            sign = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, bucket, row in _each(batch):
                own = np.unique(row * BUCKETS + bucket)
                pending.append(np.unique(own % BUCKETS * 2 + sign[own // BUCKETS + lo], return_counts=True))
                if len(pending) == 32:
                    seen, pending = merge_counts(seen, pending), []
                    if len(seen[0]) > MOST_HELD:
                        yield from told(*seen)
                        seen = none
        yield from told(*merge_counts(seen, pending))

    def told(keys, n):
        if not len(keys):
            return
        first = np.flatnonzero(np.r_[True, keys[1:] // 2 != keys[:-1] // 2])
        total, yes = np.add.reduceat(n, first), np.add.reduceat(np.where(keys % 2 == 1, n, 0), first)
        for lo in range(0, len(first), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array((keys[first[at]] // 2).astype(np.int32)), pa.array(yes[at].astype(np.int64)), pa.array(total[at].astype(np.int64))], ["bucket", "yes", "every"])

    counts = marked.select("text", "positive").mapInArrow(run, "bucket int, yes long, every long").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every"))
    no = F.col("every") - F.col("yes")
    a, b = F.col("yes") / F.lit(float(n_yes)), (no + 0.5) / F.lit(float(max(n_all - n_yes, 1)))
    ratio = F.col("yes") * F.log(a / b) - F.lit(float(n_yes)) * (a - b)
    best = counts.where("yes >= 3").where(a > LEAST_LIFT * b).withColumn("ratio", ratio).where(F.col("ratio") > LEAST_RATIO)
    return np.array(sorted(r[0] for r in best.orderBy(F.desc("ratio"), "bucket").limit(most).select("bucket").collect()), np.int64)


class ToxicityModel:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float, any_positive: bool = True):
        self.buckets, self.weights, self.bias, self.any_positive = buckets, weights, bias, any_positive
        self._place = None

    def present(self, bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) of the chosen features, once for each text."""
        if self._place is None:
            self._place = np.full(BUCKETS, -1, np.int32)
            self._place[self.buckets] = np.arange(len(self.buckets))
        at = self._place[bucket]
        own = np.unique(row[at >= 0] * np.int64(max(len(self.buckets), 1)) + at[at >= 0])
        return own % max(len(self.buckets), 1), own // max(len(self.buckets), 1)

    def __getstate__(self):
        return self.__dict__ | {"_place": None}

    def score(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if not self.any_positive:
            return np.zeros(rows)
        z = self.bias + np.bincount(row, self.weights[feature] if len(feature) else None, rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(yes: list[np.ndarray], no: list[np.ndarray], n_features: int, prior: float, apart: float = 0.0, miss: float = MISS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from lists of the features present in each text.

    ``prior`` is the share of positives in all texts, ``apart`` the share of all
    texts that are confirmed positives and so not among ``no``; ``miss`` is the
    cost of a missed positive against that of a false alarm."""
    rest = 1 - apart
    inside = min(max((prior - apart) / rest, 0.0), 1.0)  # the positives among ``no``
    prior = apart + rest * inside
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), -2.0
    gw, gb = np.full(n_features, 1e-6), 1e-6
    n_yes = max(1, min(64, len(yes)))
    epochs = max(epochs, -(-600 * 256 // max(len(no), 1)))  # small samples: at least 600 steps
    for _ in range(epochs):
        order, turn = rng.permutation(len(no)), rng.permutation(len(yes))
        for k, lo in enumerate(range(0, len(no), 256)):
            picked = [yes[turn[(k * n_yes + i) % len(yes)]] for i in range(n_yes)] + [no[i] for i in order[lo : lo + 256]]
            n_no = len(picked) - n_yes
            row = np.repeat(np.arange(len(picked)), [len(x) for x in picked])
            col = np.concatenate(picked) if len(row) else np.zeros(0, np.int64)
            z = b + np.bincount(row, w[col], len(picked))
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            negative = np.logaddexp(0, z[n_yes:]).mean() - inside * np.logaddexp(0, z[:n_yes]).mean()
            g = np.empty(len(picked))
            if negative >= 0:  # the whole risk
                g[:n_yes], g[n_yes:] = (-miss * prior * (1 - s[:n_yes]) - rest * inside * s[:n_yes]) / n_yes, rest * s[n_yes:] / n_no
            else:  # climb back to where the bracket isn't negative
                g[:n_yes], g[n_yes:] = rest * inside * s[:n_yes] / n_yes, -rest * s[n_yes:] / n_no
            step, step_b = np.bincount(col, g[row], n_features) + decay * w, g.sum()
            gw += step * step
            gb += step_b * step_b
            w -= rate * step / np.sqrt(gw)
            b -= rate * step_b / np.sqrt(gb)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_features: int = FEATURES, prior: float | None = None) -> ToxicityModel:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) to learn from."""
    small_batches(docs.sparkSession)
    known, share = confirmed(labels)
    marked = docs.select("doc_id", "text").join(maybe_broadcast(known.withColumn("_yes", F.lit(1)), known.count()), "doc_id", "left").withColumn("positive", F.coalesce("_yes", F.lit(0))).drop("_yes")
    n_all, n_yes = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("positive"), F.lit(0))).first()
    if not n_yes:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    ids = choose_sample(marked, n_all, most_positive, most_unlabelled).cache()  # at most most_positive + most_unlabelled ids
    sample = docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("fit", "positive")), "doc_id").drop("doc_id")
    buckets = choose_features(marked, n_yes, n_all, most_features)
    empty = ToxicityModel(buckets, np.zeros(len(buckets)), 0.0)

    def run(batches):
        for batch in batches:
            for lo, hi, bucket, row in _each(batch):
                feature, at = empty.present(bucket, row)
                cuts = np.searchsorted(at, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature))], ["positive", "features"])

    got = sample.select("positive", "text").mapInArrow(run, "positive int, features array<long>").toArrow()
    sign = got.column("positive").to_numpy()
    flat = got.column("features").combine_chunks()
    values, cuts = flat.flatten().to_numpy(), np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())]).astype(np.int64)
    rows = [values[cuts[i] : cuts[i + 1]] for i in range(len(sign))]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tolist(), sign[i]))  # the same fit however tasks are dealt
    ids.unpersist()
    w, b = fit_nnpu([rows[i] for i in order if sign[i] == 1], [rows[i] for i in order if sign[i] == 0], len(buckets), share if prior is None else prior, n_yes / n_all)
    return ToxicityModel(buckets, w, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` with the score of each text and predicted (or ``names``)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, bucket, row in _each(batch):
                score = model.score(*model.present(bucket, row), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in keep] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, *names])

    return kept.mapInArrow(run, schema + f", {names[0]} double, {names[1]} int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    model = train(docs.where(~F.col("held_out")), labels)
    return score_toxicity(docs, model, ("doc_id", "held_out"))
