"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; every decision has a context tree over the
preceding bytes.  Each tree node holds a Krichevsky-Trofimov estimate, and
weighting mixes the estimates of all depths: P_w = (P_kt + prod P_w(child))/2.
Counts come from all training texts: byte grams and word counts are summed
inside each task, then by one shuffle.  All counted contexts are kept: the
trees are weighted in parts that share their last ``SPLIT`` context bytes, and
only the nodes above (bounded by the alphabet) come to the driver.  Each gram of
the texts gets its log P from its part.  What is broadcast is bounded: the
``head_grams`` and ``head_words`` most frequent ones with their values.  All
others are joined by a shuffle, so contexts and vocabulary may grow without bound.

Cases: null counts as empty; an empty text scores its end symbol; repeated
rows are each scored (equal texts get equal scores); an empty table gives no
rows; with no training text every decision has probability 1/2."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, lower_ascii, materialize, merge_counts, slices, small_batches, text_bytes, word_hashes, words

DEPTH = 5
HEAD_GRAMS = 1 << 19
#: Context bytes that a part of the trees shares.
SPLIT = 2
#: Grams that are weighted in one numpy step, if their parts allow.
STEP = 1 << 17
HEAD_WORDS = 1 << 17
#: Bytes of text for one numpy step: its temporaries take about 100 times that.
SLICE = 1 << 18
_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def byte_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each text's end (byte 0): the ``depth`` bytes before it and itself.

    Oldest byte highest; texts start after zeros.  Also the row of each gram."""
    n = len(offsets) - 1
    lens = np.diff(offsets) + 1
    starts = np.cumsum(lens) - lens
    total = int(lens.sum())
    sym = np.zeros(total, np.uint64)
    row = np.repeat(np.arange(n), lens)
    ends = starts + lens - 1
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    sym[~is_end] = data
    since = np.arange(total) - starts[row]
    gram = sym.copy()
    for k in range(1, depth + 1):
        back = np.zeros(total, np.uint64)
        back[k:] = sym[:-k] if k else sym
        back[since < k] = 0
        gram |= back << np.uint64(8 * k)
    return gram, row


class ContextTrees:
    """Weighted trees, one for each of the eight bit positions."""

    def __init__(self, depth: int, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables[d]: sorted (d context bytes, byte) keys and their counts."""
        self.depth = depth
        #: nodes[j][d]: keys (context << 8 | one, j bits), weight of stopping here, P(1), P(1) of the rest child.
        self.nodes = [self._weigh(j, tables, depth)[0] for j in range(8)]
        self.grams = tables[depth][0]
        self.logs = self._slow(self.grams) if len(self.grams) else np.zeros(0)

    @classmethod
    def part(cls, depth: int, tables, first: int, last: int = 0, below=None, top=None) -> tuple[ContextTrees, list]:
        """Trees of the depths first to last, and of each bit position the lowest
        depth's (keys, log weight, zeros, ones).

        ``below`` has these of depth first + 1, ``top`` the nodes of the depths
        under last."""
        self = cls.__new__(cls)
        self.depth = depth
        made = [self._weigh(j, tables, first, last, below and below[j]) for j in range(8)]
        self.nodes = [(top[j] if top else []) + made[j][0] for j in range(8)]
        return self, [m[1] for m in made]

    def _weigh(self, j: int, tables, first: int, last: int = 0, below=None) -> tuple[list[tuple[np.ndarray, ...]], tuple]:
        from math import lgamma

        small = np.array([lgamma(i + 0.5) for i in range(4096)])

        def lg_half(n):  # log gamma(n + 1/2): a table, then Stirling's series
            x = np.maximum(n, 4095) + 0.5
            far = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x)
            return np.where(n < 4096, small[np.minimum(n, 4095).astype(np.int64)], far)

        def lg_one(n):  # log gamma(n + 1)
            x = n + 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                far = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
            return np.where(n < 16, tiny[np.minimum(n, 15).astype(np.int64)], far)

        tiny = np.array([lgamma(i + 1.0) for i in range(16)])
        kt = lambda a, b: lg_half(a) + lg_half(b) - lg_one(a + b) - 1.1447298858494002
        made = []
        for d in range(first, last - 1, -1):
            keys, counts = tables[d]
            byte = keys & np.uint64(255)
            node = (keys >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            own, at = np.unique(node, return_inverse=True)
            n1 = np.bincount(at, counts * bit, len(own))
            n0 = np.bincount(at, counts * ~bit, len(own))
            alone = kt(n0, n1)
            p1 = (n1 + 0.5) / (n0 + n1 + 1)
            if below is None:
                weight, log_w, rest = np.ones(len(own)), alone, np.full(len(own), 0.5)
            else:
                b_keys, b_log, b0, b1 = below
                parent = b_keys & np.uint64((1 << (8 * d + 8)) - 1)
                up = np.searchsorted(own, parent)
                ok = own[np.minimum(up, max(len(own) - 1, 0))] == parent if len(own) else np.zeros(len(parent), bool)
                up = up[ok]
                r0 = np.maximum(n0 - np.bincount(up, b0[ok], len(own)), 0)
                r1 = np.maximum(n1 - np.bincount(up, b1[ok], len(own)), 0)
                split = np.bincount(up, b_log[ok], len(own)) + kt(r0, r1)
                log_w = np.logaddexp(alone, split) - np.log(2)
                weight = np.exp(alone - np.log(2) - log_w)
                rest = (r1 + 0.5) / (r0 + r1 + 1)
            below = own, log_w, n0, n1
            made.append((own, weight.astype(np.float32), p1.astype(np.float32), rest.astype(np.float32)))
        return made[::-1], below

    def _slow(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) from the nodes of all depths."""
        total = np.zeros(len(grams))
        byte = grams & np.uint64(255)
        for j in range(8):
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            key = (grams >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            p, deeper = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
            for d in range(self.depth, -1, -1):
                own, weight, p1, rest = self.nodes[j][d]
                if not len(own):
                    continue
                want = key & np.uint64((1 << (8 * d + 8)) - 1)
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hit = own[at] == want
                under = np.where(deeper, p, rest[at])
                p = np.where(hit, weight[at] * p1[at] + (1 - weight[at]) * under, p)
                deeper |= hit
            total += np.log10(np.where(bit, p, 1 - p))
        return total

    def score(self, grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Sum of log10 P for each row."""
        keys, at = np.unique(grams, return_inverse=True)
        logs = np.empty(len(keys))
        where = np.minimum(np.searchsorted(self.grams, keys), max(len(self.grams) - 1, 0))
        hit = self.grams[where] == keys if len(self.grams) else np.zeros(len(keys), bool)
        logs[hit] = self.logs[where[hit]]
        logs[~hit] = self._slow(keys[~hit])
        return np.bincount(row, logs[at], rows)


def count_corpus(training: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n) of all texts: kind 0 byte grams, 1 words, 2 the number of texts.

    Each task sums its own share before it sends anything."""

    def run(batches):
        grams, seen, texts = _NONE, _NONE, 0
        pending: list = []
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            texts += len(offsets) - 1
            for lo, hi in slices(offsets, SLICE):
                part, at = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                starts, ends, _ = words(part, at)
                pending.append((np.unique(byte_grams(part, at, depth)[0], return_counts=True), np.unique(word_hashes(part, starts, ends), return_counts=True)))
                if len(pending) == 8:
                    grams, seen = merge_counts(grams, [p[0] for p in pending]), merge_counts(seen, [p[1] for p in pending])
                    pending = []
        grams, seen = merge_counts(grams, [p[0] for p in pending]), merge_counts(seen, [p[1] for p in pending])
        total = np.zeros(int(texts > 0), np.uint64), np.full(int(texts > 0), texts)
        for kind, (keys, counts) in ((0, grams), (1, seen), (2, total)):
            for lo in range(0, len(keys), 1 << 16):
                k = keys[lo : lo + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[lo : lo + (1 << 16)].astype(np.int64))], ["kind", "key", "n"])

    small_batches(training.sparkSession)
    out = training.select("text").mapInArrow(run, "kind tinyint, key long, n long")
    return out.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _most_frequent(table: DataFrame, most: int, *more: str) -> tuple[np.ndarray, ...]:
    """The keys above the count that leaves at most ``most`` of them, sorted, with n or the columns ``more``.

    A shortcut only: what is left out is joined by a shuffle."""
    level = F.floor(F.log2("n") * 64)  # some thousand levels, then the counts inside one of them

    def fits(per: DataFrame, room: int) -> tuple[int | None, int]:
        """The first class from above that doesn't fit, and the room before it."""
        for c, k in sorted(((r[0], r[1]) for r in per.collect()), reverse=True):
            if k > room:
                return c, room
            room -= k
        return None, room

    least = 0
    edge, room = fits(table.groupBy(level.alias("level")).agg(F.count(F.lit(1))), most)
    if edge is not None:
        inside = table.where(level == edge)
        split, _ = fits(inside.groupBy("n").agg(F.count(F.lit(1))), room)
        least = split + 1
    names = ["key", *(more or ["n"])]
    got = table.where(F.col("n") >= least).select(*names).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(got.column(c).to_numpy()[order] for c in names[1:])


def _tables(keys: np.ndarray, n: np.ndarray, last: int, depth: int) -> list:
    """Sorted keys and counts of the depths last to depth, from those of depth."""
    made: list = [None] * (depth + 1)
    for d in range(depth, last - 1, -1):
        keys, at = np.unique(keys & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        n = np.bincount(at, n, len(keys))
        made[d] = keys, n
    return made


def _in_parts(grams: DataFrame, depth: int, step, schema: str) -> DataFrame:
    """``step(keys, n)``, which makes record batches, over (key, n) of whole parts of the trees."""
    split = min(SPLIT, depth)
    part = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1))

    def run(batches):
        held: list = []
        rows = 0

        def flush(upto=None):
            part, key, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield from step(key[:upto].view(np.uint64), n[:upto])
            held[:] = [(part[upto:], key[upto:], n[upto:])] if upto else []

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() for c in ("part", "key", "n")))
            rows += batch.num_rows
            last = held[-1][0]
            edge = np.flatnonzero(last[1:] != last[:-1])
            start = int(edge[-1]) + 1 if len(edge) else 0 if len(held) > 1 and held[-2][0][-1] != last[0] else None
            if rows >= STEP and start is not None:  # the last part may go on in the next batch
                yield from flush(rows - len(last) + start)
                rows = len(last) - start
        if held:
            yield from flush()

    return grams.select(part.alias("part"), "key", "n").repartition("part").sortWithinPartitions("part", "key").mapInArrow(run, schema)


class Model:
    """The counts and trees of a training corpus, in parts of written tables."""

    def __init__(self, depth: int, counts: DataFrame):
        self.depth = depth
        self.grams = counts.where("kind = 0").select("key", "n")
        split = self.split = min(SPLIT, depth)

        def roots(keys, n):
            _, low = ContextTrees.part(depth, _tables(keys, n, split, depth), depth, split)
            for j, (own, log_w, n0, n1) in enumerate(low):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), j, np.int32)), pa.array(own.view(np.int64)), pa.array(log_w), pa.array(n0.astype(float)), pa.array(n1.astype(float))], ["bit", "key", "log_w", "n0", "n1"])

        self.top: list = [[] for _ in range(8)]
        if split:
            got = _in_parts(self.grams, depth, roots, "bit int, key long, log_w double, n0 double, n1 double").toArrow()
            bit, key, *rest = (got.column(c).to_numpy() for c in ("bit", "key", "log_w", "n0", "n1"))
            below = [tuple(x[bit == j] for x in (key.view(np.uint64), *rest)) for j in range(8)]
            above = (1 << (8 * split)) - 1
            high = self.grams.groupBy(F.col("key").bitwiseAND(F.lit(above)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
            tables = _tables(high.column("key").to_numpy().view(np.uint64), high.column("n").to_numpy(), 0, split - 1)
            trees, _ = ContextTrees.part(depth, tables, split - 1, 0, below)
            self.top = trees.nodes
        self.logs = materialize(self._logs(self.grams), "ctw-logs")

    def _logs(self, grams: DataFrame) -> DataFrame:
        """(key, n, log10 P) of grams; those with n = 0 were not counted."""
        depth, split = self.depth, self.split
        shared = grams.sparkSession.sparkContext.broadcast(self.top)

        def step(keys, n):
            seen = n > 0
            trees, _ = ContextTrees.part(depth, _tables(keys[seen], n[seen], split, depth), depth, split, top=shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(trees._slow(keys))], ["key", "n", "log_p"])

        return _in_parts(grams, depth, step, "key long, n long, log_p double")

    def logs_of(self, wanted: DataFrame) -> DataFrame:
        """(key, log_p) of the counted grams and of all wanted ones."""
        new = wanted.select("key").distinct().join(self.grams, "key", "left_anti").withColumn("n", F.lit(0).cast("long"))
        if not (new := materialize(new, "ctw-new")).limit(1).count():
            return self.logs.select("key", "log_p")
        return self.logs.select("key", "log_p").unionAll(self._logs(self.grams.unionAll(new)).where("n = 0").select("key", "log_p"))


def train(training: DataFrame, depth: int = DEPTH) -> tuple[Model, DataFrame]:
    """The weighted trees and the written (kind, key, n) counts."""
    counts = materialize(count_corpus(training, depth), "ctw-counts")
    return Model(depth, counts), counts


def _distinct(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array]:
    """Lists of each row's distinct keys and how often they occur."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    firsts = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(rows[firsts], np.arange(n_rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(keys[firsts].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(np.diff(np.append(firsts, len(keys)))))


def score_texts(docs: DataFrame, trees: Model, counts: DataFrame, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, token counts, base_score, score and bits per byte.

    ``docs`` has doc_id, held_out and text; ``counts`` is what train() returns."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = counts.where("kind = 1").select("key", "n")
    n_texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, v_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = n_words + n_texts, v_words + (n_texts > 0)
    head = _most_frequent(vocabulary, head_words)
    depth = trees.depth
    shared = spark.sparkContext.broadcast((_most_frequent(trees.logs, head_grams, "log_p"), head))

    def run(batches):
        (g_keys, g_logs), (h_keys, h_n) = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                part, at = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                m = hi - lo
                grams, g_rows = byte_grams(part, at, depth)
                own, back = np.unique(grams, return_inverse=True)
                pos = np.minimum(np.searchsorted(g_keys, own), max(len(g_keys) - 1, 0))
                hit = g_keys[pos] == own if len(g_keys) else np.zeros(len(own), bool)
                value = np.zeros(len(own))
                value[hit] = g_logs[pos[hit]]
                score = np.bincount(g_rows, value[back], m)
                far = ~hit[back]
                deep = _distinct(grams[far], g_rows[far], m)
                starts, ends, rows = words(part, at)
                hashes = word_hashes(part, starts, ends)
                pos = np.minimum(np.searchsorted(h_keys, hashes), max(len(h_keys) - 1, 0))
                hit = h_keys[pos] == hashes if len(h_keys) else np.zeros(len(hashes), bool)
                known = np.bincount(rows[hit], minlength=m)
                logs = np.bincount(rows[hit], np.log10(h_n[pos[hit]] + 0.1), m) if hit.any() else np.zeros(m)
                tail, t_rows = hashes[~hit], rows[~hit]
                arrays = [pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score), pa.array(np.diff(at) + 1)]
                arrays += [*_distinct(tail, t_rows, m), *deep]
                first = [batch.column(c).slice(lo, m) for c in ("doc_id", "held_out")] + [pa.array(np.bincount(rows, minlength=m) + 1)]
                yield pa.RecordBatch.from_arrays(first + arrays, ["doc_id", "held_out", "n_tokens", "known", "logs", "score", "n_symbols", "tail", "times", "grams", "g_times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, n_symbols long, tail array<long>, times array<long>, grams array<long>, g_times array<long>")
    scored = materialize(scored.withColumn("_uid", F.monotonically_increasing_id()), "ctw-rows")
    # Words beyond the head are in few rows each, so this join has no hot key.
    rare = scored.select("_uid", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("_uid", F.col("w.tail").alias("key"), F.col("w.times").alias("times"))
    added = rare.join(vocabulary, "key").groupBy("_uid").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("_logs"))
    # So are the grams beyond the head.
    deep = scored.select("_uid", F.explode(F.arrays_zip("grams", "g_times")).alias("w")).select("_uid", F.col("w.grams").alias("key"), F.col("w.g_times").alias("times"))
    deeper = deep.join(trees.logs_of(deep), "key").groupBy("_uid").agg(F.sum(F.col("times") * F.col("log_p")).alias("_deep"))
    out = scored.drop("tail", "times", "grams", "g_times").join(added, "_uid", "left").join(deeper, "_uid", "left").withColumn("score", F.col("score") + F.coalesce("_deep", F.lit(0.0)))
    known = F.col("known") + F.coalesce("_known", F.lit(0))
    unknown = F.col("n_tokens") - 1 - known
    below = F.log10(F.lit(n_all + 0.1 * (v_all + 1)))
    base = F.col("logs") + F.coalesce("_logs", F.lit(0.0)) + unknown * F.log10(F.lit(0.1)) + F.log10(F.lit(n_texts + 0.1)) - F.col("n_tokens") * below
    return out.select(
        "doc_id", "held_out", "n_tokens", (known + F.lit(int(n_texts > 0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") * F.log2(F.lit(10.0)) / F.col("n_symbols")).alias("bits_per_byte"))


def op2_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 10) == 0)
    trees, counts = train(docs.where(~F.col("held_out")))
    return score_texts(docs, trees, counts)
