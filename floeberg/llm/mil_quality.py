"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 50 words.  Each passage is encoded from
hashed words and character statistics; gated attention
a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))) weighs the passages, and the
weighted mean encoding is scored.  All parts are trained together with numpy
from document labels alone, on at most ``most_labelled`` documents chosen by a
hash of the id; every passage of every document is then encoded and scored.

Cases: null counts as empty; an empty text is one empty passage; equal texts
get equal scores (rounded to 6 places); a doc_id labelled twice takes the
lowest label; without both labels the score is the share of label 1; an empty
table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, lower_ascii, slices, small_batches, text_bytes, word_hashes, words

PASSAGE, BUCKETS, WIDTH, GATE = 50, 1 << 13, 24, 16
MOST_LABELLED = 6_000
THRESHOLD = 0.3

#: Character classes of the passage statistics.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".", b",;:", b"!", b"?", b"|", b"#$%&*", b"()[]{}<>", b"'\"`", b"-_/\\+=~^@")
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
N_CLASS = len(_CLASSES) + 1
N_STATS = N_CLASS + 6


def passages(part: np.ndarray, at: np.ndarray):
    """Word buckets with their passages, statistics and document of each passage."""
    n = len(at) - 1
    starts, ends, rows = words(part, at)
    per = np.bincount(rows, minlength=n)
    bags = np.maximum(-(-per // PASSAGE), 1)
    first = np.cumsum(bags) - bags
    total = int(bags.sum())
    place = np.arange(len(rows)) - (np.cumsum(per) - per)[rows]
    token_bag = first[rows] + place // PASSAGE
    doc = np.repeat(np.arange(n), bags)
    hashes = word_hashes(lower_ascii(part), starts, ends)
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    stats = np.zeros((total, N_STATS))
    if len(starts):
        head = np.ones(len(starts), bool)
        head[1:] = token_bag[1:] != token_bag[:-1]
        edge = starts[head]
        stop = np.append(edge[1:], 0)
        last = np.ones(len(edge), bool)
        last[:-1] = rows[head][1:] != rows[head][:-1]
        stop[last] = at[rows[head][last] + 1]
        wide = stop - edge
        where = np.repeat(token_bag[head], wide)
        byte = np.repeat(edge - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        seen = np.bincount(where * N_CLASS + _CLASS[part[byte]], minlength=total * N_CLASS).reshape(total, N_CLASS)
        size = np.maximum(seen.sum(1, keepdims=True), 1)
        stats[:, :N_CLASS] = np.sqrt(seen / size)
        many = np.maximum(np.bincount(token_bag, minlength=total), 1)
        kinds = np.bincount(np.unique(token_bag * np.int64(1 << 30) + (hashes >> np.uint64(34)).astype(np.int64)) >> 30, minlength=total)
        stats[:, N_CLASS] = np.bincount(token_bag, ends - starts, total) / many / 10
        stats[:, N_CLASS + 1] = kinds / many
        upper = (part[starts] >= 65) & (part[starts] <= 90)
        stats[:, N_CLASS + 2] = np.bincount(token_bag, upper, total) / many
        stats[:, N_CLASS + 3] = np.bincount(token_bag, ends - starts <= 3, total) / many
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (token_bag[1:] == token_bag[:-1])
        stats[:, N_CLASS + 5] = np.sqrt(np.bincount(token_bag, again, total) / many) * 2
        stats[:, N_CLASS + 4] = np.bincount(token_bag, minlength=total) / PASSAGE
    return bucket, token_bag, stats, doc


def _bag_sum(values: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by sorted ``bag``."""
    out = np.zeros((n, values.shape[1]))
    if len(bag):
        heads = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        out[bag[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


class QualityModel:
    def __init__(self, params: dict[str, np.ndarray] | None, share: float):
        self.params, self.share = params, share

    @staticmethod
    def start(rng) -> dict[str, np.ndarray]:
        shape = {"embed": (BUCKETS, WIDTH), "stat": (N_STATS, WIDTH), "shift": (WIDTH,), "v": (WIDTH, GATE), "u": (WIDTH, GATE), "w": (GATE,), "c": (WIDTH,), "b": (1,)}
        scale = {"embed": 0.1, "stat": 0.3, "v": 0.3, "u": 0.3, "w": 0.3, "c": 0.3}
        return {k: rng.normal(0, scale[k], s) if k in scale else np.zeros(s) for k, s in shape.items()}

    def forward(self, bucket, token_bag, stats, doc, n_docs: int) -> dict:
        p, n = self.params, len(doc)
        many = np.maximum(np.bincount(token_bag, minlength=n), 1)[:, None]
        words_in = _bag_sum(p["embed"][bucket], token_bag, n) / np.sqrt(many)
        h = np.tanh(words_in + np.einsum("ij,jk->ik", stats, p["stat"]) + p["shift"])
        t, s = np.tanh(np.einsum("ij,jk->ik", h, p["v"])), 1 / (1 + np.exp(-np.einsum("ij,jk->ik", h, p["u"])))
        e = np.einsum("ij,j->i", t * s, p["w"])
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        e = np.exp(e - np.maximum.reduceat(e, heads)[doc])
        a = e / np.bincount(doc, e, n_docs)[doc]
        z = _bag_sum(a[:, None] * h, doc, n_docs)
        logit = np.einsum("ij,j->i", z, p["c"]) + p["b"]
        return {"many": many, "h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.params is None:
            return np.full(n, self.share)
        return self.forward(*passages(part, at), n)["score"]

    def gradient(self, f: dict, bucket, token_bag, stats, doc, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n_docs = self.params, len(y)
        d_logit = (f["score"] - y) / n_docs
        g = {"c": f["z"].T @ d_logit, "b": np.array([d_logit.sum()])}
        d_z = (d_logit[:, None] * p["c"])[doc]
        d_a = (d_z * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.bincount(doc, f["a"] * d_a, n_docs)[doc])
        g["w"] = (f["t"] * f["s"]).T @ d_e
        d_gate = d_e[:, None] * p["w"]
        d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
        g["v"], g["u"] = f["h"].T @ d_t, f["h"].T @ d_s
        d_h = f["a"][:, None] * d_z + d_t @ p["v"].T + d_s @ p["u"].T
        d_in = d_h * (1 - f["h"] ** 2)
        g["stat"], g["shift"] = stats.T @ d_in, d_in.sum(0)
        spread = (d_in / np.sqrt(f["many"]))[token_bag]
        g["embed"] = np.stack([np.bincount(bucket, spread[:, k], BUCKETS) for k in range(WIDTH)], 1)
        return g


def fit_mil(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    """Adam on the log loss of whole documents."""
    share = float(np.mean(labels)) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return QualityModel(None, share)
    rng = np.random.default_rng(seed)
    model = QualityModel(QualityModel.start(rng), share)
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.params.items()}
    step, epochs = 0, max(epochs, -(-600 * batch // len(texts)))  # small samples: at least 600 steps
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            picked = order[lo : lo + batch]
            data, at = text_bytes(pa.array([texts[i] for i in picked]))
            bags = passages(data, at)
            g = model.gradient(model.forward(*bags, len(picked)), *bags, labels[picked])
            step += 1
            now = rate * (0.5 if epoch >= epochs // 2 else 1.0)
            for k, x in model.params.items():
                grad = g[k] + decay * x
                m[k] += 0.1 * (grad - m[k])
                v2[k] += 0.001 * (grad * grad - v2[k])
                x -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    model.params = {k: x.astype(np.float32).astype(np.float64) for k, x in model.params.items()}
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = 48 << 20) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    The sample is bounded in documents and in bytes: a text that doesn't fit
    in what is left is skipped, and the next ones in hash order are tried."""
    order = F.xxhash64("doc_id", F.lit(23))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    picked = known.orderBy(order, "doc_id").limit(most_labelled)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = got.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.first("quality").alias("quality")).select(order.alias("h"), "doc_id", "n", "quality").collect()  # at most most_labelled rows
    total, chosen = 0, []
    for _, i, n, _ in sorted(tuple(r) for r in sizes):
        if total + n <= most_bytes:
            total += n
            chosen.append((i,))
    if not chosen:
        return QualityModel(None, float(np.mean([r.quality for r in sizes])) if sizes else 0.0)
    ids = docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)
    table = got.join(F.broadcast(ids), "doc_id").select(order.alias("h"), "doc_id", "text", "quality").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    return fit_mil([x or "" for x in table.column("text").to_pylist()], table.column("quality").to_numpy())


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the score of each text and predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                score = np.round(shared.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), 6)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in keep] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return kept.mapInArrow(run, schema + ", score double, predicted int")


def op9_quality_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    model = train(docs.where(~F.col("held_out")), labels)
    return score_quality(docs, model, ("doc_id", "held_out"))
