"""Language identification in two steps: the family, then the language within it.

Texts are lower-cased, everything but letters becomes one space, and all runs
of 1 to 5 bytes are counted as shares of a text's runs, hashed to ``BUCKETS``.
Linear support vector machines (squared hinge, dual coordinate descent in numpy)
separate every two families, and within a family every two languages; votes
decide, then margins, then the name.

The machines are fitted on at most ``most_labelled`` documents, spread evenly
over the languages and chosen by a hash of id and text; counts of languages and
predictions cover every row, whole texts.

Cases: texts that are null or hold no letter are ``und`` with score 0; without
any learned language all are; a family or a table with one language needs no
machine and gives 1 for that step; equal texts get equal predictions; labels
that are null teach nothing; languages that ``families`` doesn't list are
families of their own; very long texts are worked through in pieces; an empty
table gives no rows; extra columns are not read."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_mod, merge_counts, small_batches, text_bytes

# Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "finnic": ("et", "fi"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
}
LONGEST, BUCKETS = 5, 1 << 17
MOST_LABELLED = 2_000
#: Bytes of text that one numpy step works on.
STEP = 1 << 16
#: Columns of machines that are worked out for every text at once; beyond them, those of its family only.
AT_ONCE = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.array([32], np.uint8)


def _map() -> np.ndarray:
    """Byte to lower-case letter, or space; bytes of other scripts stay."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for b in range(97, 123):
        out[[b, b - 32]] = b
    return out


_LETTER = _map()


def steps(offsets: np.ndarray):
    """Pieces (row, from, to) of texts in lists of about STEP bytes."""
    own, size = [], 0
    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for at in range(lo, max(hi, lo + 1), STEP):
            own.append((row, at, min(hi, at + STEP)))
            size += own[-1][2] - at + 1
            if size >= STEP:
                yield own
                own, size = [], 0
    if own:
        yield own


def runs(data: np.ndarray, offsets: np.ndarray, pieces: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each piece begins, and for each length the bucket of the run at every place; BUCKETS where none counts.

    A text has a space on both sides.  A piece has the runs that start in it, so
    it is read with the byte before it and LONGEST - 1 after it.  Runs that hold
    two spaces in a row don't count, nor does a space alone."""
    parts, place, size = [], [], []
    for row, lo, hi in pieces:
        begin, end = int(offsets[row]), int(offsets[row + 1])
        parts += [_SPACE if lo == begin else data[lo - 1 : lo], data[lo : min(hi + LONGEST - 1, end)]]
        whole = 1 + len(parts[-1])
        if hi + LONGEST - 1 >= end:
            parts.append(_SPACE)
            whole += 1
        # From the space before a text or the first byte of a later piece, up to the piece's last byte, or the space after a text.
        place.append((int(lo > begin), 1 + hi - lo + (hi == end)))
        size.append(whole)
    stream = _LETTER[np.concatenate(parts)]
    stream[1:] += ((stream[:-1] == 0xC3) & (stream[1:] >= 0x80) & (stream[1:] <= 0x9E) & (stream[1:] != 0x97)) * np.uint8(32)  # U+00C0 to U+00DE
    end = np.cumsum(size)
    first = end - size
    low, high = (first + np.array([p[k] for p in place]) for k in (0, 1))
    mark = np.zeros(len(stream) + 1, np.int8)
    np.add.at(mark, low, 1)
    np.add.at(mark, high, -1)
    outside = np.cumsum(mark[:-1]) == 0
    space = stream == 32
    double = np.append(space[:-1] & space[1:], True)
    s = np.append(stream.astype(np.uint64), np.zeros(LONGEST, np.uint64))
    n_all = len(stream)
    key, bad, out = np.zeros(n_all, np.uint64), outside.copy(), []
    for n in range(1, LONGEST + 1):
        key |= s[n - 1 : n - 1 + n_all] << np.uint64(8 * (n - 1))
        if n > 1:
            bad[: n_all - n + 2] |= double[n - 2 :]
            bad[end - n + 1] = True  # beyond the piece
        bucket = (((key + np.uint64(n << 56)) * _MULT) >> np.uint64(47)).astype(np.int32)
        bucket[bad | space if n == 1 else bad] = BUCKETS
        out.append(bucket)
    return first, out


def counted(data: np.ndarray, offsets: np.ndarray):
    """(row of each piece, its begin, buckets by length) for every step of a batch."""
    for own in steps(offsets):
        yield np.array([p[0] for p in own]), *runs(data, offsets, own)


def has_letter(data: np.ndarray, offsets: np.ndarray, texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_at = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    out = np.diff(ascii_at[offsets]) > 0
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[row] = any(map(str.isalpha, texts[int(row)].as_py()))
    return out


class Machine:
    """Support vector machines between every two of ``names``: a row each of weights by bucket, 0 for no run, and the bias."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights
        self.pairs = list(combinations(range(len(names)), 2))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row of margins (positive: the pair's first), and its confidence."""
        n, many = len(margins), len(self.names)
        if many == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, total, least = np.zeros((n, many)), np.zeros((n, many)), np.full((n, many), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for name, own in ((a, m), (b, -m)):
                total[:, name] += own
                least[:, name] = np.minimum(least[:, name], own)
        winner = np.lexsort((-np.arange(many)[None, :].repeat(n, 0), total, votes), axis=1)[:, -1]
        return winner, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(n), winner], -15, 15)))


def fit_machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 10.0, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (bias last) of the machine that has y = +1 on its positive side; x: (features, values) of each text, bias left out."""
    rng = np.random.default_rng(seed)
    w, alpha, bias = np.zeros(size), np.zeros(len(x)), 0.0
    soft = 1 / (2 * cost)
    norm = np.array([float(v @ v) for _, v in x]) + 1 + soft
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            j, v = x[i]
            new = max(alpha[i] - (y[i] * (w[j] @ v + bias) - 1 + soft * alpha[i]) / norm[i], 0.0)
            if step := new - alpha[i]:
                w[j] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return np.append(w, bias)


class LanguageModel:
    def __init__(self, families: Machine | None, members: list[Machine]):
        self.families, self.members = families, members

    @classmethod
    def fit(cls, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str], families: dict):
        """From the (bucket, share) arrays of each text."""
        if not x:
            return cls(None, [])
        of = {code: family for family, codes in families.items() for code in codes}
        family = [of.get(lang, lang) for lang in langs]
        mean = np.zeros(BUCKETS)
        for j, v in x:
            mean[j] += v / len(x)
        scale = 1 / np.sqrt(mean + 1e-6)
        for k, (j, v) in enumerate(x):  # in place: the sample is held once
            x[k] = j, (v * scale[j]).astype(v.dtype)

        def machine(groups: list[str], want: list[str]) -> Machine:
            at = {name: [i for i, g in enumerate(groups) if g == name] for name in want}
            columns = []
            for a, b in combinations(want, 2):
                own = at[a] + at[b]
                w = fit_machine([x[i] for i in own], np.array([1.0] * len(at[a]) + [-1.0] * len(at[b])), BUCKETS)
                columns.append(np.concatenate([w[:-1] * scale, [0.0], w[-1:]]))
            return Machine(want, np.array(columns, np.float32))

        names = sorted(set(family))
        return cls(machine(family, names), [machine(langs, sorted({k for k, f in zip(langs, family) if f == name})) for name in names])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, every = len(offsets) - 1, [self.families, *self.members]
        cuts = np.cumsum([0, *(len(m.pairs) for m in every)])
        once = cuts[-1] <= AT_ONCE
        found = margins(every if once else every[:1], data, offsets, np.arange(n))
        family, sure = self.families.decide(found[:, : cuts[1]])
        names, score = np.full(n, "", object), sure.copy()
        for k, machine in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            if len(rows):
                winner, own = machine.decide(found[rows, cuts[k + 1] : cuts[k + 2]] if once else margins([machine], data, offsets, rows))
                names[rows], score[rows] = np.array(machine.names, object)[winner], score[rows] * own
        return names.tolist(), np.round(score, 6)


def margins(machines: list[Machine], data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Margin of each pair of the machines, for the texts of ``rows``."""
    columns = [m.weights[c] for m in machines for c in range(len(m.pairs))]
    total, many = np.zeros((len(rows), len(columns))), np.zeros(len(rows))
    if not columns:
        return total
    if len(rows) < len(offsets) - 1:
        lens = np.diff(offsets)[rows]
        ends = np.concatenate([[0], np.cumsum(lens)])
        data = data[np.repeat(offsets[rows] - ends[:-1], lens) + np.arange(ends[-1])]
        offsets = ends
    for row, first, lengths in counted(data, offsets):
        sums = np.zeros((len(row), len(columns)))
        for bucket in lengths:
            np.add.at(many, row, np.add.reduceat(bucket < BUCKETS, first, dtype=np.int64))
            for c, w in enumerate(columns):
                sums[:, c] += np.add.reduceat(w.take(bucket), first, dtype=np.float64)
        np.add.at(total, row, sums)
    return total / np.maximum(many, 1)[:, None] + np.array([w[-1] for w in columns])


def choose_sample(docs: DataFrame, most: int) -> DataFrame:
    """(text, lang) of at most ``most`` labelled rows, the same number of each language where there are enough."""
    sizes = docs.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return docs.select("text", "lang").limit(0)
    quota = max(1, most // len(sizes))
    order = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    bound = docs.sparkSession.createDataFrame([(r[0], int(min(1.0, 1.3 * (quota + 50) / r[1]) * (1 << 30))) for r in sizes], "lang string, bound long")
    near = docs.withColumn("o", order).join(F.broadcast(bound), "lang").where("o <= bound").select("doc_id", "lang", "o", F.xxhash64("text").alias("t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "t"))  # little more than the quota for each language
    ids = near.withColumn("n", nth).where(F.col("n") <= quota).select("lang", "o").distinct()
    return docs.withColumn("o", order).join(F.broadcast(ids), ["lang", "o"], "left_semi").select("text", "lang")


def train(docs: DataFrame, most_labelled: int = MOST_LABELLED, families: dict | None = None) -> LanguageModel:
    """``docs`` (doc_id, text, lang) to learn from."""
    small_batches(docs.sparkSession)

    none = np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            held: list[list] = [[] for _ in range(batch.num_rows)]
            for row, first, lengths in counted(data, offsets):
                for r, lo, hi in zip(row.tolist(), first, np.append(first[1:], len(lengths[0]))):
                    own = np.concatenate([b[lo:hi] for b in lengths])
                    held[r] = [merge_counts((none, none), [*held[r], np.unique(own[own < BUCKETS].astype(np.int64), return_counts=True)])]
            shares = [(j.astype(np.int32), n / max(n.sum(), 1)) for ((j, n),) in held]
            ends = np.cumsum([0, *(len(j) for j, _ in shares)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s[i] for s in shares]) if shares else np.zeros(0), kind)) for i, kind in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists], ["lang", "buckets", "shares"])

    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    got = choose_sample(known, most_labelled).mapInArrow(run, "lang string, buckets array<int>, shares array<float>").toArrow()
    langs = got.column("lang").to_pylist()
    x = [(b.values.to_numpy(), v.values.to_numpy()) for b, v in zip(got.column("buckets"), got.column("shares"))]
    use = sorted((i for i in range(len(x)) if len(x[i][0])), key=lambda i: (langs[i], x[i][0].tobytes(), x[i][1].tobytes()))  # the same fit however tasks are dealt
    return LanguageModel.fit([x[i] for i in use], [langs[i] for i in use], FAMILIES if families is None else families)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("_text")
            data, offsets = text_bytes(texts)
            known = has_letter(data, offsets, texts)
            names, score = model.predict(data, offsets) if model.families else ([""] * len(known), np.zeros(len(known)))
            known &= model.families is not None
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([n if k else "und" for n, k in zip(names, known)], pa.string()), pa.array(np.where(known, score, 0.0))], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema + ", lang_pred string, score double")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model, ("doc_id", "held_out"))
