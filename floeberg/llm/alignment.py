"""Cross-tokenizer alignment: which tokens of two tokenizers end together.

Both encode space+text (the second one adds the space itself).  Over the joined
bytes, the ends of either side's tokens are cumulated lengths; offsets that are
ends on both sides (``intersect1d``) cut the bytes into groups, ``searchsorted``
gives each token its group, and links are made by repeating index ranges.

A text is cut before every space that follows a character other than white
space: with a byte-level vocabulary and a piece vocabulary whose pieces hold a
space only at their start, no token of either side reaches over such a place, so
each stretch between two of them is encoded once and remembered (at most
``MOST_HELD`` stretches in a worker).  Where a vocabulary doesn't promise this,
the stretch is the whole text.

Counts of id pairs over the corpus are summed in two shuffles, salted by row and
then by pair.  The documents' distinct pairs meet these counts in a join: the most
frequent pairs by broadcast (``HEAD`` at most), all others, none of which is
frequent, by a shuffle.

Cases: null and empty texts, and texts whose joined tokens of either side aren't
space+text (such as those that hold U+2581), have no tokens: all counts 0 and an
empty groups_sha256; a repeated row counts as a row of its own; very long texts
are worked through in pieces of ``PIECE`` characters, except within a stretch;
strings of special tokens are plain text; a null doc_id stays; an empty table
gives no rows; extra columns are not read."""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, materialize, maybe_broadcast, merge_counts, small_batches

TOKENIZERS = "/opt/tokenizers"
PIECE, MOST_HELD, HEAD, SALTS = 1 << 18, 1 << 18, BROADCAST_ROWS, 16
#: Stretches that are encoded at once.
RUN = 1024
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= (?s:.))")  # a last space alone is no stretch: the piece vocabulary gives an empty text no space
_SPACES = re.compile(r"\s | $")
_ODD = re.compile("\\s$|\u2581")


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteTokenizer:
    """A byte-level vocabulary in a JSON file."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        said = json.loads(blob)
        self.model = Tokenizer.from_str(blob.decode())
        self.model.encode_special_tokens = True
        byte = byte_alphabet()
        words = {i: w for w, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in (words.get(i, "") for i in range(max(words) + 1))]
        before = said["pre_tokenizer"] or {}
        self.cuts_at_spaces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said["normalizer"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokenizer:
    """A piece vocabulary with byte fallback in a model file; it puts a space before each text."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.cuts_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.encode("  a", out_type=str) != self.model.encode(" a", out_type=str)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def expand(first_a, count_a, first_b, count_b) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of range k of one side with range k of the other, by repeats."""
    many = count_a * count_b
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = np.repeat(count_b, many)
    return np.repeat(first_a, many) + within // np.maximum(wide, 1), np.repeat(first_b, many) + within % np.maximum(wide, 1)


def align(len_a: np.ndarray, len_b: np.ndarray, links: str = "ends"):
    """Cuts, group of each token on either side, and links (index pairs) of two token streams over the same bytes.

    ``links``: "ends" for tokens that end together, "groups" for all pairs within a group."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    common = np.intersect1d(end_a[np.diff(end_a, prepend=-1) > 0], end_b[np.diff(end_b, prepend=-1) > 0], assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    if links == "ends":
        lo_a, hi_a, lo_b, hi_b = (np.searchsorted(e, common, side) for e in (end_a, end_b) for side in ("left", "right"))
    else:
        k = np.arange(len(common))
        lo_a, hi_a, lo_b, hi_b = (np.searchsorted(g, k, side) for g in (group_a, group_b) for side in ("left", "right"))
    return common, group_a, group_b, *expand(lo_a, hi_a - lo_a, lo_b, hi_b - lo_b)


class Aligner:
    """Both tokenizers and the stretches seen so far, by number; lives in a worker."""

    def __init__(self, blob_a: bytes, blob_b: bytes, links: str):
        self.a, self.b, self.links = ByteTokenizer(blob_a), PieceTokenizer(blob_b), links
        #: Id with the sign that follows it: inside a group, and as the last of its side.
        self.signs = [np.array([f"{i}{x}" for i in range(len(t.bytes)) for x in (",", end)], object) for t, end in ((self.a, "|"), (self.b, ";"))]
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.cuts = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []  # the groups as text
        self.counts = np.zeros((0, 4), np.int64)  # tokens of a, of b, groups, links; -1 where a side isn't the text
        self.from_, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text that begins with a space, each without its first space."""
        if not self.cuts:
            return [text[1:]]
        if _SPACES.search(text) is None:
            return text[1:].split(" ")
        return [s[1:] for s in _BEFORE_SPACE.split(text)]

    def tokens(self, tokenizer, size: np.ndarray, new: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all stretches in a row, and how many each has; -1 where they aren't the stretch.

        ``joined``: encode long runs of stretches at once; None if their tokens don't end with the stretches."""
        if not joined:
            ids = tokenizer.encode(new)
            many = [len(x) if s.encode() == b"".join([tokenizer.bytes[i] for i in x]) else -1 for s, x in zip(new, ids)]
            return np.fromiter((i for n, x in zip(many, ids) if n >= 0 for i in x), np.int64), np.array(many, np.int64)
        ids = list(chain.from_iterable(tokenizer.encode(["".join(new[k : k + RUN]) for k in range(0, len(new), RUN)])))
        till = np.cumsum(np.fromiter(map(len, map(str.encode, new)), np.int64, len(new)))
        flat = np.array(ids, np.int64)
        ends = np.cumsum(size[flat])
        last = np.searchsorted(ends, till)
        if b"".join(map(tokenizer.bytes.__getitem__, ids)) != "".join(new).encode() or not np.array_equal(ends[np.minimum(last, len(ends) - 1)], till):
            return None
        return flat, np.diff(last + 1, prepend=0)

    def learn(self, new: list[str]) -> None:
        """Encode stretches, align them as one stream and remember them."""
        sides = (self.a, self.size_a), (self.b, self.size_b)
        # Where one stretch follows another, the first must not end in white space.
        both = [self.tokens(*x, new, True) for x in sides] if self.cuts and not any(map(_ODD.search, new)) else [None]
        (flat_a, many_a), (flat_b, many_b) = both if all(both) else [self.tokens(*x, new, False) for x in sides]
        bad = (many_a < 0) | (many_b < 0)
        if bad.any():  # no tokens: they don't shift the stream
            flat_a, flat_b = (flat[np.repeat(~bad[many >= 0], many[many >= 0])] for flat, many in ((flat_a, many_a), (flat_b, many_b)))
            many_a, many_b = np.where(bad, 0, many_a), np.where(bad, 0, many_b)
        common, group_a, group_b, at_a, at_b = align(self.size_a[flat_a], self.size_b[flat_b], self.links)
        # Each stretch has whole groups; its last token ends its last group.
        till_a, till_b = np.concatenate([[0], np.cumsum(many_a)]), np.concatenate([[0], np.cumsum(many_b)])
        groups = np.concatenate([[0], group_a + 1])[till_a]
        linked = np.searchsorted(group_a[at_a], groups)
        self.counts = np.concatenate([self.counts, np.where(bad[:, None], -1, np.stack([many_a, many_b, np.diff(groups), np.diff(linked)], 1))])
        self.from_ = np.concatenate([self.from_, self.from_[-1] + linked[1:]])
        self.pairs = np.concatenate([self.pairs, flat_a[at_a] << 32 | flat_b[at_b]])
        # Each group's ids of a, then of b, each with the sign that follows it.
        cut_a, cut_b = (np.searchsorted(g, np.arange(len(common) + 1)) for g in (group_a, group_b))
        word = np.empty(len(flat_a) + len(flat_b), object)
        for flat, group, cut, before, sign in ((flat_a, group_a, cut_a, cut_b[:-1], self.signs[0]), (flat_b, group_b, cut_b, cut_a[1:], self.signs[1])):
            k = np.arange(len(flat))
            word[k + before[group]] = sign[flat * 2 + (cut[group + 1] == k + 1)]
        word, ends = word.tolist(), (till_a + till_b).tolist()
        for k, s in enumerate(new):
            self.number[s[1:]] = len(self.said)
            self.said.append("".join(word[ends[k] : ends[k + 1]]))

    def add(self, work: list[tuple[int, str]], into: dict) -> None:
        """Add pieces of texts (row, piece) to their rows' states."""
        if len(self.said) > MOST_HELD:
            self.forget()
        cut = [self.stretches(piece) for _, piece in work]
        new = set(chain.from_iterable(cut)).difference(self.number)
        odd = set(filter(_ODD.search, new))
        for part in (new - odd, odd):
            if part:
                self.learn([" " + s for s in part])
        for (row, _), own in zip(work, cut):
            k = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
            state = into[row]
            counts = self.counts[k]
            state.ok &= bool((counts[:, 0] >= 0).all())
            if not state.ok:
                continue
            state.counts += counts.sum(0)
            state.hash.update((";" * state.begun + "".join(map(self.said.__getitem__, k.tolist()))[:-1]).encode())
            state.begun = True
            many = counts[:, 3]
            at = np.repeat(self.from_[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            state.pairs.append(np.unique(self.pairs[at], return_counts=True))
            if len(state.pairs) > 16:
                state.pairs = [merge_counts(state.pairs[0], state.pairs[1:])]


class _State:
    def __init__(self):
        self.ok, self.begun, self.counts, self.hash, self.pairs = True, False, np.zeros(4, np.int64), hashlib.sha256(), []

    def row(self):
        if not (self.ok and self.begun):
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return *self.counts.tolist(), self.hash.hexdigest(), *merge_counts(self.pairs[0], self.pairs[1:])


def pieces(text: str, cuts: bool):
    """space+text, cut where tokens end anyway, into pieces of about PIECE characters."""
    text, at = " " + text, 0
    while cuts and len(text) - at > PIECE and (found := _BEFORE_SPACE.search(text, at + PIECE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


_aligners: dict[tuple, Aligner] = {}


def _aligner(key: tuple, blobs: list[bytes]) -> Aligner:
    """The worker's aligner, which later tasks find again with what it has seen."""
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*blobs, key[-1])
    return _aligners[key]


def encoded(docs: DataFrame, file_a: str, file_b: str, links: str = "ends") -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs (a << 32 | b) with their number of links."""
    small_batches(docs.sparkSession)
    blobs = []
    for name in (file_a, file_b):
        with open(name, "rb") as f:  # a vocabulary of a few MB, sent to the executors
            blobs.append(f.read())
    key = (*(hashlib.sha256(b).hexdigest() for b in blobs), links)
    shared = docs.sparkSession.sparkContext.broadcast(blobs)

    def run(batches):
        aligner = _aligner(key, shared.value)
        for batch in batches:
            texts = batch.column("text")
            states, work, size = {}, [], 0
            out = []
            for row in range(batch.num_rows):
                states[row] = _State()
                for piece in pieces(text, aligner.cuts) if (text := texts[row].as_py()) else ():
                    work.append((row, piece))
                    size += len(piece)
                    if size >= PIECE:
                        aligner.add(work, states)
                        work, size = [], 0
            aligner.add(work, states)
            out = [states[row].row() for row in range(batch.num_rows)]
            ends = np.cumsum([0, *(len(x[5]) for x in out)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64))) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], pa.int64()) for k in range(4)), pa.array([x[4] for x in out], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, links, best): links of each id pair over all rows of (_row, pair, times); best: no pair with the same second id has more."""
    salted = links.groupBy("pair", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("links"))
    counts = salted.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b", F.expr("pair & 4294967295L"))
    counts = materialize(counts, "align-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))  # at most the second vocabulary
    return counts.join(maybe_broadcast(most, most.count()), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of ``table`` in two: at most ``most`` of the highest counts, and the rest (None if there is none)."""
    n = table.count()
    if n <= most:
        return table, None
    bound = int(table.agg(F.percentile_approx("links", 1 - most / n, 10_000)).first()[0])
    while table.where(F.col("links") > bound).count() > most:
        bound = 2 * bound + 1
    return table.where(F.col("links") > bound), table.where(F.col("links") <= bound)


def alignment(docs: DataFrame, file_a: str, file_b: str, links: str = "ends", head: int = HEAD) -> DataFrame:
    """Per document: encoded() with n_best (its links whose pair's count is the highest of its second id) and count_sum (counts over its links)."""
    done = materialize(encoded(docs, file_a, file_b, links).withColumn("_row", F.monotonically_increasing_id()), "align-docs")
    own = done.select("_row", F.inline(F.arrays_zip("pairs", "times"))).toDF("_row", "pair", "times")
    table = materialize(pair_counts(own), "align-pairs")
    common, rare = frequent(table, head)
    if rare is None:
        met = own.join(F.broadcast(common), "pair")
    else:
        near = own.join(F.broadcast(common), "pair", "left")
        met = near.where("links is not null").unionByName(near.where("links is null").drop("links", "best").join(rare.hint("merge"), "pair").select(*near.columns))
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    out = done.drop("pairs", "times").join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
