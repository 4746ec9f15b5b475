"""Methods against brute force on small inputs."""

import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib
from collections import Counter
from fractions import Fraction
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floeberg.llm import bestfit, ctw, dartminhash as dart, exact_dedup, mil_quality as mil, pfair, sharding, toxicity, winnowing
from floeberg.llm.common import lower_ascii, text_bytes
from floeberg.llm.secret_scan import find_secrets, redact


def test_hilbert_curve_walks_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        order = grid[np.argsort(sharding.hilbert_numbers(grid, bits))]
        assert sorted(sharding.hilbert_numbers(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_shard_files(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    ranges = sharding.write_shards(docs, str(tmp_path / "s"), 4).collect()
    assert sum(r["rows"] for r in ranges) == len(odd[1]) and len(ranges) == 4


def _brute_ctw(train, text, depth):
    """Weighted probabilities by recursion over exact fractions."""
    counts = Counter()
    for t in train:
        raw = b"\0" * depth + t.encode() + b"\0"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                ctx = raw[i - d : i]
                for j in range(8):
                    counts[ctx, 1 << j | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1] += 1

    def kt(a, b):
        p = Fraction(1)
        for k in range(a):
            p *= Fraction(2 * k + 1, 2 * (k + 1))
        for k in range(b):
            p *= Fraction(2 * k + 1, 2 * (a + k + 1))
        return p

    def weighted(ctx, node):
        a, b = counts[ctx, node, 0], counts[ctx, node, 1]
        if len(ctx) == depth:
            return kt(a, b)
        under = Fraction(1)
        for c in range(256):
            child = bytes([c]) + ctx
            if counts[child, node, 0] + counts[child, node, 1]:
                under *= weighted(child, node)
        return (kt(a, b) + under) / 2

    total, raw = 0.0, b"\0" * depth + text.encode() + b"\0"
    for i in range(depth, len(raw)):
        for j in range(8):
            node, bit = 1 << j | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1
            before = weighted(b"", node)
            path = [(raw[i - d : i], node, bit) for d in range(depth + 1)]
            for p in path:
                counts[p] += 1
            total += log10(weighted(b"", node) / before)
            for p in path:
                counts[p] -= 1
    return total


def test_context_trees_equal_the_recursion():
    train, depth = ["abab", "aba", "b"], 2
    tables = []
    for d in range(depth + 1):
        data, at = text_bytes(pa.array(train))
        keys, n = np.unique(ctw.byte_grams(data, at, depth)[0] & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True)
        tables.append((keys, n))
    trees = ctw.ContextTrees(depth, tables)
    texts = ["ab", "", "bz"]
    data, at = text_bytes(pa.array(texts))
    got = trees.score(*ctw.byte_grams(data, at, depth), len(texts))
    assert got == pytest.approx([_brute_ctw(train, t, depth) for t in texts], abs=1e-5)


def test_deeper_contexts_shorten_held_out_text(spark):
    rng = random.Random(1)
    parts = ["th", "er", "ing", "on", "ea", "st", "re"]

    def word():  # mostly predictable, often unseen as a whole
        k = rng.randrange(7)
        out = [parts[k]]
        for _ in range(rng.randint(2, 9)):
            k = (k + 1) % 7 if rng.random() < 0.9 else rng.randrange(7)
            out.append(parts[k])
        return "".join(out)

    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(300)], "doc_id long, text string")
    docs = docs.withColumn("held_out", F.col("doc_id") % 10 == 0)
    total = []
    for depth in (0, 2, 5):
        trees, counts = ctw.train(docs.where("not held_out"), depth)
        total.append(ctw.score_texts(docs, trees, counts, head_words=16).where("held_out").agg(F.sum("score")).first()[0])
    assert total[0] < total[1] < total[2]


def test_all_contexts_count_whatever_the_head(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 40))) for _ in range(60)] + ["zq"]
    docs = spark.createDataFrame([(i, i % 4 == 0, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    train = [t for i, t in enumerate(texts) if i % 4]
    for depth in (1, 3):
        data, at = text_bytes(pa.array(train))
        grams = ctw.byte_grams(data, at, depth)[0]
        tables = [np.unique(grams & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True) for d in range(depth + 1)]
        data, at = text_bytes(pa.array(texts))
        want = ctw.ContextTrees(depth, tables).score(*ctw.byte_grams(data, at, depth), len(texts))
        model, counts = ctw.train(docs.where("not held_out"), depth)
        for head in (7, 1 << 19):
            got = dict(ctw.score_texts(docs, model, counts, head_grams=head).select("doc_id", "score").collect())
            assert [got[i] for i in range(len(texts))] == pytest.approx(list(want), abs=1e-4)
    many = spark.range(9).selectExpr("id as key", "100000 + id as n")  # all counts over 65,536
    assert list(ctw._most_frequent(many, 4)[0]) == [5, 6, 7, 8]


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = dart.mix64(np.arange(60).astype(np.uint64))
    w1 = rng.random(60) * 3
    w2 = w1 * (0.6 + 0.4 * rng.random(60))
    same = [(lambda s: (s[0] == s[1]).mean())(dart.dart_minhash(dart.mix64(np.r_[e, e] + np.uint64(q)), np.repeat([0, 1], 60), 2, weights=np.r_[w1, w2])[0]) for q in range(60)]
    assert np.mean(same) == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.02)


def _near_brute(rows):
    """Class of each row: exact weighted Jaccard of five-word shingles, all pairs."""
    sets, words = [], []
    for _, t in rows:
        w = lower_ascii(np.frombuffer((t or "").encode() or b" ", np.uint8)).tobytes().split()
        words.append(tuple(w))
        c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        sets.append(frozenset((s, k) for s, n in c.items() for k in range(n)))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or (sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def _same_classes(got, rows):
    classes = {}
    for (i, _), c in zip(rows, _near_brute(rows), strict=True):
        classes.setdefault(c, []).append(i)
    want = Counter((i, min((x for x in v if x is not None), default=None), len(v)) for v in classes.values() for i in v)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)


def test_near_duplicates_equal_all_pairs(spark, odd):
    rows = [(r[0], r[1]) for r in odd[1]]
    _same_classes(dart.near_duplicates(spark.read.parquet(f"{odd[0]}/documents.parquet")).collect(), rows)


def test_large_near_group_in_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(160):
        t = list(base)
        for i in rng.sample(range(150), rng.randint(0, 8)):
            t[i] = f"z{rng.random()}"
        rows.append((k, " ".join(t)))
    _same_classes(dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_star_shaped_group_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(dart, "BLOCK", 64)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 500):
        t = list(base)
        for i in rng.sample(range(6, 114), 2):
            t[i] = f"z{rng.random()}"
        rows.append((k, " ".join(t)))
    _same_classes(dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_pfair_stays_within_a_block():
    for shares in ({"a": 7, "b": 2, "c": 1}, {"a": 341, "b": 341, "c": 342}, {"a": 1}):
        plan, period = pfair.earliest_deadline(shares), sum(shares.values())
        served = Counter()
        for slot, (s, i, release, deadline) in enumerate(plan):
            assert release <= slot < deadline and i == served[s]
            served[s] += 1
            assert all(abs(served[x] - (slot + 1) * n / period) < 1 for x, n in shares.items())
        assert served == shares


def test_mixing_places_every_row_once(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    got = pfair.pfair_mix(docs, {"a": 0.5, "b": 0.3}, block=4, period=10, record=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd[1])
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = {r.slot: r.source for r in got}
    assert sorted(slots) == list(range(len(slots)))
    ordered = pfair.in_mixed_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(got)


def test_mixing_holds_target_weights(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(3000)], "doc_id long, source string")
    rows = pfair.pfair_mix(docs, {"a": 0.6, "b": 0.3, "c": 0.1}, block=5).select("slot", "source", "phase").distinct().orderBy("slot").collect()
    served, weight = Counter(), {"a": 0.6, "b": 0.3, "c": 0.1}
    for k, r in enumerate([r for r in rows if r.phase == 0]):
        served[r.source] += 1
        assert all(abs(served[s] - (k + 1) * w) < 1.6 for s, w in weight.items())  # weights are held in 1024ths
    assert served["a"] > 190


@pytest.mark.parametrize("weights", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.37, "b": 0.33, "c": 0.2, "d": 0.0999, "e": 0.0001}, {"a": 1, "b": 2, "c": 1000}])
def test_pfair_holds_any_target_for_a_million_slots(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    blocks = {s: int(Fraction(str(w)) / total * 1_000_000) + 7 for s, w in weights.items()}
    first = pfair.phases(blocks, weights, pfair.EXACT)[0]
    assert first["length"] * first["repeat"] > 980_000
    served = Counter()
    for k, (s, i, release, deadline) in enumerate(first["plan"]):
        w = Fraction(str(weights[s])) / total
        assert release == int(i / w) <= k < deadline == -int(-(i + 1) / w // 1) and i == served[s]
        served[s] += 1
        assert all(abs(served[x] - (k + 1) * Fraction(str(v)) / total) < 1 for x, v in weights.items())
    # A period ends on the target, so all that follow are as near to it.
    assert all(served[x] == first["length"] * Fraction(str(v)) / total for x, v in weights.items())


def _plain_schedule(blocks, weights):
    """Earliest deadline first, slot by slot, with windows from the exact weights."""
    out, start, done = [], 0, Counter()
    while left := {s for s in blocks if done[s] < blocks[s]}:
        total = sum(weights[s] for s in left)
        base, slot = Counter(done), 0
        while all(done[s] < blocks[s] for s in left):
            ready = []
            for s in left:
                i, w = done[s] - base[s], Fraction(weights[s], total)
                if int(i / w) <= slot:
                    ready.append((-int(-(i + 1) / w // 1), -weights[s], s))
            s = min(ready)[2]
            out.append(s)
            done[s] += 1
            slot += 1
        start += slot
    return out


def test_mixing_equals_the_plain_schedule(spark):
    weights, rows = {"a": 5, "b": 3, "c": 2}, {"a": 37, "b": 90, "c": 11}
    docs = spark.createDataFrame([(f"{s}{i}", s) for s, n in rows.items() for i in range(n)], "doc_id string, source string")
    got = pfair.pfair_mix(docs, weights, block=3).select("slot", "source").distinct().orderBy("slot").collect()
    assert [r.source for r in got] == _plain_schedule({s: -(-n // 3) for s, n in rows.items()}, weights)


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(pfair, "MOST_SOURCES", 20)
    monkeypatch.setattr(pfair, "GROUPS", 4)
    docs = spark.createDataFrame([(i, f"s{i * i % 97}") for i in range(900)], "doc_id long, source string")
    got = pfair.pfair_mix(docs, {"s1": 3, "s4": 1}, block=2, record=True).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, f"s{i * i % 97}") for i in range(900))
    slots = {r.slot for r in got}
    assert slots == set(range(len(slots))) and len({(r.slot, r.place) for r in got}) == 900


@pytest.mark.parametrize("n", [5, 600])
def test_every_source_keeps_its_own_weight_however_many_there_are(spark, n):
    """Sources of 4 rows and three of 64: each stays within a block of its weight, and each goes on to its end."""
    rows = {f"s{k}": 4 for k in range(n)} | {f"t{k}": 64 for k in range(3)}
    docs = spark.createDataFrame([(f"{s}-{k}", s) for s, m in rows.items() for k in range(m)], "doc_id string, source string")
    got = pfair.pfair_mix(docs, block=2).collect()
    assert Counter(r.source for r in got) == rows and len({(r.slot, r.place) for r in got}) == len(got)
    slots = {r.slot: (r.source, r.phase, r.block) for r in got}
    assert sorted(slots) == list(range(len(slots))) and all(r.release <= r.slot < r.deadline for r in got)
    total, served = sum(m**0.5 for m in rows.values()), Counter()
    for k in range(len(slots)):
        s, phase, block = slots[k]
        assert block == served[s]
        served[s] += 1
        if phase == 0:
            assert all(abs(served[x] - (k + 1) * m**0.5 / total) < 1.2 for x, m in rows.items())  # shares are 1024ths


def test_classes_do_not_depend_on_how_many_sources_there_are(spark):
    """A source's class and its turns are its own size's, with 6 sources as with 601."""
    for n in (5, 600):
        sizes = spark.createDataFrame([*((f"s{k}", 4) for k in range(n)), ("t", 64)], "_source string, _rows long")
        got = {r._source: (r._class, r._members, r._member) for r in pfair.classes_of(sizes, None, 2, 0.5).collect()}
        assert got["t"] == ("n64", 1, 0) and {got[f"s{k}"] for k in range(n)} == {("n4", n, k) for k in range(n)}


def _sizes_of(n):
    return {f"z{k}": 2 * k + 1 for k in range(n)} | {"t": 3000, "u": 1700}


def test_weights_do_not_depend_on_how_many_sizes_there_are():
    """The shares of two sources are in one proportion, with 5 other sizes as with 600."""
    got = []
    for n in (5, 510, 511, 600):
        shares = pfair.shares_of({s: m**0.5 for s, m in _sizes_of(n).items()}, pfair.PERIOD)
        assert all(abs(shares[s] / shares["t"] / (m / 3000) ** 0.5 - 1) < 1 / 1000 for s, m in _sizes_of(n).items())
        got.append(Fraction(shares["u"], shares["t"]))
    assert len(set(got)) == 1


def test_many_sizes_are_mixed_by_their_own_weights(spark):
    """600 sizes: every block has the window of its source's weight, as the weight is with a few sources."""
    rows = _sizes_of(600)
    docs = spark.createDataFrame(list(rows.items()), "source string, n long").selectExpr("source", "explode(sequence(1L, n)) AS k").selectExpr("concat(source, '-', k) AS doc_id", "source")
    got = pfair.pfair_mix(docs, block=64).select("source", "phase", "block", "slot", "release", "deadline").distinct().collect()
    assert sorted(r.slot for r in got) == list(range(sum(-(-m // 64) for m in rows.values()))) and all(r.release <= r.slot < r.deadline for r in got)
    weight = {s: pfair.held(m**0.5, pfair.PERIOD) for s, m in rows.items()}
    first = [r for r in got if r.phase == 0]
    assert len(first) > 600
    for r in first:
        w = weight[r.source] / sum(weight.values())
        assert (r.release, r.deadline) == (int(r.block / w), -int(-(r.block + 1) / w // 1))


def test_given_weights_of_any_length_are_exact():
    weights = {"a": 0.70711, "b": 0.57735, "c": 0.44721}
    first = pfair.phases({s: int(w * 300_000) for s, w in weights.items()}, weights)[0]
    total, served = sum(Fraction(str(w)) for w in weights.values()), Counter()
    assert first["length"] * first["repeat"] > 170_000
    for k, (s, *_) in enumerate(first["plan"]):
        served[s] += 1
        assert all(abs(served[x] - (k + 1) * Fraction(str(w)) / total) < 1 for x, w in weights.items())


def test_very_small_weights_are_scheduled(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "doc_id long, source string")
    got = pfair.pfair_mix(docs, {"a": 1, "b": 1e-30}, block=2).collect()
    assert {r.slot: r.source for r in got} == {k: "ab"[k // 5] for k in range(10)}


SECRET = 'password="hunter2222"'
ENCODERS = [
    lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: s.encode().hex(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(bz2.compress(s.encode())).decode(), lambda s: lzma.compress(s.encode()).hex(), lambda s: base64.b64encode(zlib.compress(s.encode(), wbits=-15)).decode(),
]


@pytest.mark.parametrize("first", range(len(ENCODERS)))
@pytest.mark.parametrize("second", range(-1, len(ENCODERS)))
def test_nested_layers(first, second):
    inner = ENCODERS[first](SECRET)
    hidden = inner if second < 0 else ENCODERS[second](inner)
    text = f"çé {hidden} end"
    base, spans = find_secrets(text)
    assert set(base) <= set(spans)
    found = [(a, b) for a, k, b in spans if k == 0]
    assert found and all(3 <= a < b <= 3 + len(hidden) for a, b in found)
    assert "end" in redact(text)


@pytest.mark.parametrize("hide", [
    lambda s: base64.encodebytes(b"lorem ipsum \xc3\xa9 " * 3 + b"x" * 7 + s + b" dolor sit amet " * 4).decode(),
    lambda s: base64.encodebytes(gzip.compress(random.Random(1).randbytes(300).hex().encode() + b" " + s)).decode().replace("\n", "\r\n"),
    lambda s: "example.com/path/" + base64.b64encode(s).decode(), lambda s: base64.b64encode(s + b" ab").decode() + "-suffix",
    lambda s: "example.com/a/" + base64.urlsafe_b64encode(zlib.compress(s)).decode(),
    lambda s: "0x" + s.hex(), lambda s: "0x" + zlib.compress(s).hex(), lambda s: base64.b64encode(b"\x00\xff\x01" + s + b"\xfe").decode(),
])
def test_wrapped_and_glued_layers(hide):
    hidden = hide(SECRET.encode())
    text = f"çé {hidden} end"
    found = [(a, b) for a, k, b in find_secrets(text)[1] if k == 0]
    assert found and all(3 <= a < b <= 3 + len(hidden) for a, b in found)


def test_plain_text_has_no_layers_and_loops_end():
    assert find_secrets("100%25 %zz \\u12 &#999999999; AKIA" * 50)[1] == []
    text = "token=abcdef1"
    for _ in range(6):
        text = base64.b64encode(text.encode()).decode()
    assert find_secrets(text)[1]
    bomb = base64.b64encode(gzip.compress(b"z " * 2_000_000 + SECRET.encode())).decode()
    assert find_secrets(bomb, max_layer=1 << 20)[1] == [(0, 0, len(bomb.rstrip("=")))]
    for pack in (bz2.compress, lzma.compress):
        bomb = base64.b64encode(pack(b"z " * 2_000_000 + SECRET.encode())).decode()
        assert (0, 0, len(bomb.rstrip("="))) in find_secrets(bomb, max_layer=1 << 20)[1]


def test_nnpu_learns_from_unlabelled():
    rng = np.random.default_rng(2)
    make = lambda toxic: np.unique(np.r_[rng.integers(2, 20, 6), [0] if toxic else []].astype(np.int64))
    yes, no = [make(True) for _ in range(100)], [make(rng.random() < 0.2) for _ in range(800)]
    w, b = toxicity.fit_nnpu(yes, no, 20, 0.2)
    score = lambda x: 1 / (1 + np.exp(-(b + w[x].sum())))
    assert np.mean([score(make(True)) >= 0.3 for _ in range(200)]) > 0.95
    assert np.mean([score(make(False)) >= 0.3 for _ in range(200)]) < 0.05


def test_attention_gradients():
    texts = [" ".join(f"w{(i * k) % 17}" for i in range(130)) + "!" * k for k in range(4)] + [""]
    data, at = text_bytes(pa.array(texts))
    bags = mil.passages(data, at)
    assert bags[3].tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    model = mil.QualityModel(mil.QualityModel.start(np.random.default_rng(0)), 0.5)
    y = np.array([1.0, 0, 1, 0, 1])
    loss = lambda: -np.mean(y * np.log((s := model.forward(*bags, 5)["score"])) + (1 - y) * np.log(1 - s))
    g = model.gradient(model.forward(*bags, 5), *bags, y)
    rng = np.random.default_rng(1)
    for name, x in model.params.items():
        for _ in range(4):
            at_ = tuple(rng.integers(0, n) for n in x.shape) if name != "embed" else (bags[0][rng.integers(len(bags[0]))], rng.integers(x.shape[1]))
            old = x[at_]
            x[at_] = old + 1e-5
            up = loss()
            x[at_] = old - 1e-5
            down = loss()
            x[at_] = old
            assert g[name][at_] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_on_held_out_passages():
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices([f"word{i}" for i in range(200)], k=120)) + "."
    bad = lambda: " | ".join(rng.choices(["%%%", "###", "BUY", "NOW!!"], k=120))
    texts, labels = [], []
    for i in range(120):
        texts.append(good() if i % 3 else bad())
        labels.append(float(bool(i % 3)))
    model = mil.fit_mil(texts[:90], np.array(labels[:90]))
    score = model.score(*text_bytes(pa.array(texts[90:])))
    assert ((score >= 0.3) == (np.array(labels[90:]) == 1)).mean() > 0.95


def test_winnowing_equals_the_naive_choice(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 1, 3, 5, 6, 19, 20, 21, 60, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.fp for r in winnowing.with_fingerprint(df, "text", "fp").collect()}
    token = {r.w: r.h for r in spark.createDataFrame([(c,) for c in "abcdefgh"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    mask = (1 << 64) - 1
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & mask
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, t in enumerate(texts):
        h = [token[w] & mask for w in t.split()]
        if len(h) >= 5:
            raw = [turn(h[k], 4) ^ turn(h[k + 1], 3) ^ turn(h[k + 2], 2) ^ turn(h[k + 3], 1) ^ h[k + 4] for k in range(len(h) - 4)]
        else:
            raw = [0] if h else []
            for x in h:
                raw = [turn(raw[0], 1) ^ x]
        g = [r.h for r in spark.createDataFrame([(k, signed(x)) for k, x in enumerate(raw)], "k long, x long").orderBy("k").select(F.xxhash64("x").alias("h")).collect()] if raw else []
        kept = []
        for start in range(max(1, len(g) - 15)) if g else ():
            at = min(range(start, min(start + 16, len(g))), key=lambda k: (g[k] >> 26, -k))
            if at not in kept:
                kept.append(at)
        assert got[i] == ",".join(f"{k}:{g[k] & mask:X}" for k in kept)


def test_shared_runs_share_a_fingerprint(spark):
    rng = random.Random(8)
    words = [f"q{i}" for i in range(5000)]
    run = rng.sample(words, winnowing.GRAM + winnowing.WINDOW - 1)
    texts = [" ".join(rng.sample(words, k) + run + rng.sample(words, 40)) for k in (0, 3, 77)]
    sets = [set(r.fp_set) for r in winnowing.with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "fp").collect()]
    assert sets[0] & sets[1] and sets[1] & sets[2] and sets[0] & sets[2]


def test_colliding_digests_are_told_apart(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    key = lambda d: Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in d.collect())
    assert key(exact_dedup.exact_duplicates(docs, digest=weak)) == key(exact_dedup.exact_duplicates(docs))


def test_stream_state_continues(spark, tmp_path):
    path, state = str(tmp_path / "r"), str(tmp_path / "s")
    schema = "doc_id long, _loc string, n_chars long, digest string"
    spark.createDataFrame([(5, "a", 3, "x"), (6, "b", 3, "y")], schema).write.parquet(path)
    records = spark.read.parquet(path)
    assert exact_dedup.stream_state(path, records.schema, state, spark, 2).count() == 2
    spark.createDataFrame([(1, "c", 3, "x")], schema).write.mode("append").parquet(path)
    got = {r.digest: (r.best.doc_id, r.group_size) for r in exact_dedup.stream_state(path, records.schema, state, spark, 3).collect()}
    assert got == {"x": (1, 2), "y": (6, 1)}


def _plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], {}
    order = sorted((-(n - 1) % capacity - capacity if n > capacity else -n, i) for i, n in enumerate(sizes))
    for minus, i in sorted((-(n - (n - 1) // capacity * capacity), i) for i, n in enumerate(sizes)):
        n = -minus
        fits = [b for b in bins if b[0] >= n and clusters[i] not in b[2]]
        best = min((b for b in fits if sources[i] not in b[1]), key=lambda b: (b[0], b[3]), default=None) or min(fits, key=lambda b: (b[0], b[3]), default=None)
        if best is None:
            best = [capacity, set(), set(), len(bins)]
            bins.append(best)
        best[0] -= n
        best[1].add(sources[i])
        best[2].add(clusters[i])
        out[i] = best[3]
    del order
    return out


def test_best_fit_equals_the_plain_search():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(1, 80)
        sizes = [rng.randint(1, 100) for _ in range(n)]
        sources, clusters = [rng.choice("abc") for _ in range(n)], [rng.randint(0, 25) for _ in range(n)]
        placed = bestfit.best_fit(sizes, sources, clusters, 100)
        plain = _plain_best_fit(sizes, sources, clusters, 100)
        groups = lambda pairs: sorted(sorted(i for i, b in pairs if b == x) for x in {b for _, b in pairs})
        assert groups([(p[0], p[2]) for p in placed]) == groups(list(plain.items()))
        seen = {}
        for i, _, b, _, _ in placed:
            assert clusters[i] not in seen.setdefault(b, set())
            seen[b].add(clusters[i])


def _run_of(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_two_runs_share_one_state(spark, tmp_path):
    state = str(tmp_path / "state")
    key = lambda d: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in d.collect())
    first = _run_of(spark, [(1, "a b"), (2, "ab"), (3, "c"), (4, None)], str(tmp_path / "1"))
    assert key(exact_dedup.exact_duplicates(first, state_path=state)) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)]
    second = _run_of(spark, [(5, "ab"), (6, " c "), (7, "d"), (8, ""), (9, "\n")], str(tmp_path / "2"))
    for _ in range(2):  # a named run counts once
        got = exact_dedup.exact_duplicates(second, state_path=state, run="second")
        # a copy of an earlier text, a longer original, a new text, and empty ones
        assert key(got) == [(5, 1, 3, False), (6, 6, 2, True), (7, 7, 1, True), (8, 9, 3, False), (9, 9, 3, True)]
    third = _run_of(spark, [(10, "c")], str(tmp_path / "3"))
    assert key(exact_dedup.exact_duplicates(third, state_path=state)) == [(10, 6, 3, False)]


def test_digests_that_collide_between_runs(spark, tmp_path):
    state = str(tmp_path / "state")
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 0)  # noqa: E731  all digests are equal
    texts = ["x y", "q", "xy", "q q", "qq", "z"]
    for k in range(3):
        rows = [(2 * k, texts[2 * k]), (2 * k + 1, texts[2 * k + 1])]
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(_run_of(spark, rows, str(tmp_path / f"r{k}")), digest=weak, state_path=state).collect()}
        assert set(got) == {2 * k, 2 * k + 1}
        for i, t in rows:
            group = [j for j in range(2 * k + 2) if texts[j].replace(" ", "") == t.replace(" ", "")]
            best = min(group, key=lambda j: (-len(texts[j]), j))
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(group), best == i)


def test_oversized_labelled_texts_are_skipped(spark):
    docs = spark.createDataFrame([(i, ("w%d " % (i % 2)) * (9 if i % 5 else 9000)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = mil.train(docs, labels, most_bytes=5000)
    assert model.params is not None
    assert mil.train(docs, labels, most_bytes=1).share == pytest.approx(0.5)


def test_strict_sources_never_meet():
    rng = random.Random(8)
    sizes = [rng.randint(1, 260) for _ in range(70)]
    sources, clusters = [rng.choice("abcd") for _ in sizes], list(range(70))
    seen = {}
    for i, _, b, _, n in bestfit.best_fit(sizes, sources, clusters, 100, strict_sources=True):
        if n < 100:
            assert sources[i] not in seen.setdefault(b, set())
            seen[b].add(sources[i])


def test_nnpu_without_the_confirmed_ones():
    rng = np.random.default_rng(5)
    make = lambda toxic: np.unique(np.r_[rng.integers(2, 20, 6), [0] if toxic else []].astype(np.int64))
    yes, no = [make(True) for _ in range(100)], [make(rng.random() < 1 / 9) for _ in range(900)]
    w, b = toxicity.fit_nnpu(yes, no, 20, 0.2, apart=0.1)
    score = lambda x: 1 / (1 + np.exp(-(b + w[x].sum())))
    assert np.mean([score(make(True)) >= 0.3 for _ in range(200)]) > 0.95
    assert np.mean([score(make(False)) >= 0.3 for _ in range(200)]) < 0.05


def test_template_family_in_tiny_blocks(spark, monkeypatch):
    monkeypatch.setattr(dart, "BLOCK", 32)
    monkeypatch.setattr(dart, "HUBS", 1)
    rng = random.Random(12)
    frame = [f"t{i}" for i in range(90)]
    rows = []
    for k in range(300):  # twins share 12 words of their own; the others share the frame only
        own = [f"o{k}x{j}" for j in range(40)]
        text = frame[:45] + own + frame[45:]
        rows.append((2 * k, " ".join(text)))
        if k % 2:
            text[rng.randrange(46, 84)] = f"z{k}"
            rows.append((2 * k + 1, " ".join(text)))
    _same_classes(dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    monkeypatch.setattr(dart, "HUBS", 16)
    with pytest.raises(ValueError):
        dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))


def test_whole_order_of_shards(spark):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 50), rng.choice("abc"), rng.choice(["en", "de", None]), rng.randint(0, 9000)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.hilbert_shards(docs, 7).collect()}

    def number(x):
        return int.from_bytes((x or "").encode().ljust(6, b"\0"), "big")

    cells = []
    for column, of in ((2, number), (3, number), (4, int)):
        values = sorted(of(r[column]) for r in rows)
        cuts = sorted({values[max(-(-len(values) * i // 64) - 1, 0)] for i in range(1, 64)})
        cells.append([sum(of(r[column]) >= c for c in cuts) for r in rows])
    curve = sharding.hilbert_numbers(np.array(cells).T, sharding.BITS)
    order = sorted(rows, key=lambda r: (curve[r[0]], zlib.crc32(r[1].encode()), r[0]))
    firsts = [-(-500 * s // 7) for s in range(7)]
    for rank, r in enumerate(order):
        shard = rank * 7 // 500
        assert got[r[0]] == (shard, rank - firsts[shard])
