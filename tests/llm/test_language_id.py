"""Language identification: runs against loops, held-out accuracy, folds, hierarchy, cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from floeberg.llm import language_id as L

PARTS = {
    "en": ["the", "ing", "and", "th", "er", "ould", "wh"],
    "de": ["der", "ung", "sch", "ein", "pf", "lich", "ß"],
    "fr": ["eau", "que", "les", "tion", "oi", "ment", "é"],
    "es": ["ción", "ado", "rr", "ll", "mente", "os", "ñ"],
}


def plain(text):
    """Buckets of all runs of a text."""
    b = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), text.encode().lower())
    b = b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", b) + b" "
    out = Counter()
    for n in range(1, L.LONGEST + 1):
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if b"  " not in w and w != b" ":
                out[((int.from_bytes(w, "little") + (n << 56)) * 0x9E3779B97F4A7C15) % (1 << 64) >> 47] += 1
    return out


@pytest.mark.parametrize("step", [1 << 16, 3, 8])
def test_runs_and_pieces(monkeypatch, step):
    monkeypatch.setattr(L, "STEP", step)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abÉé ÀXy.,1 日\n") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = [Counter() for _ in texts]
    for row, first, lengths in L.counted(data, offsets):
        for r, lo, hi in zip(row.tolist(), first, np.append(first[1:], len(lengths[0]))):
            for b in lengths:
                got[r].update(x for x in b[lo:hi].tolist() if x < L.BUCKETS)
    assert got == [plain(t) for t in texts]


def made(n, seed, langs=tuple(PARTS)):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(PARTS[k], k=rng.randint(1, 4)))
    return [(i, " ".join(word(k) for _ in range(rng.randint(1, 60))).capitalize() + ".", k) for i, k in ((i, rng.choice(langs)) for i in range(n))]


def test_query_on_held_out_rows(spark, tmp_path):
    rows = made(900, 2) + [(2000, None, "en"), (2001, "", "de"), (2002, "123 ... %%", "fr"), (2003, "日本語", "es"), (None, "the thing and", "en"), (2004, "the thing and", None)]
    rows += [(3000 + i, rows[7][1], rows[7][2]) for i in range(40)]  # copies
    rows.append((2005, "schung der " * 40_000, "de"))
    frame = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, held_out string, score double")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op11_language_id(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    said = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*PARTS, "und"} for r in got)
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (2000, 2001, 2002))
    assert said[2003].lang_pred != "und" and said[2004].lang_pred == said[None].lang_pred == "en" and said[2005].lang_pred == "de"
    assert len({(said[3000 + i].lang_pred, said[3000 + i].score) for i in range(40)}) == 1
    held = [r for r in rows[:900] if said[r[0]].held_out]
    assert len(held) > 100 and sum(said[i].lang_pred == k for i, _, k in held) >= 0.97 * len(held)


def test_held_out_labels_teach_nothing(spark, tmp_path):
    rows = made(300, 3)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    out = []
    for k, change in enumerate((False, True)):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, "xx" if change and held(i) else lang) for i, t, lang in rows], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
        out.append(sorted(L.op11_language_id(spark, at).collect()))
    assert out[0] == out[1]


def test_languages_are_sought_within_the_family():
    rng = np.random.default_rng(1)
    x, langs = [], []
    for k, name in enumerate(("en", "de", "nl", "fr", "it", "zz")):
        for _ in range(20):
            j = np.unique(rng.integers(0, 40, 15) + 40 * k)
            x.append((j, np.full(len(j), 1 / len(j))))
            langs.append(name)
    model = L.LanguageModel.fit(x, langs, L.FAMILIES)
    assert model.families.names == ["germanic", "romance", "zz"]
    assert [m.names for m in model.members] == [["de", "en", "nl"], ["fr", "it"], ["zz"]]
    assert [len(m.pairs) for m in (model.families, *model.members)] == [3, 3, 1, 0]
    winner, sure = model.families.decide(np.array([[1.0, 2.0, -1.0], [-1.0, 1.0, 1.0], [-1.0, -1.0, -2.0], [1.0, -1.0, 1.0]]))
    assert winner.tolist() == [0, 1, 2, 0] and ((0 < sure) & (sure < 1)).all()


def test_family_by_family_equals_all_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    rows = made(80, 5)
    data, offsets = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8), np.cumsum([0, *(len(r[1].encode()) for r in rows)])
    w = lambda k: rng.normal(size=(k, L.BUCKETS + 2)).astype(np.float32)
    model = L.LanguageModel(L.Machine(["f", "g"], w(1)), [L.Machine(["a", "b", "c"], w(3)), L.Machine(["d", "e"], w(1))])
    want = model.predict(data, offsets)
    monkeypatch.setattr(L, "AT_ONCE", 0)
    got = model.predict(data, offsets)
    assert want[0] == got[0] and np.array_equal(want[1], got[1])


def test_machine_reaches_the_optimum():
    """The machine against plain gradient descent on the same squared hinge."""
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(60, 5))
    y = np.sign(dense @ rng.normal(size=5) + 0.3 + 0.5 * rng.normal(size=60))
    x = [(np.arange(5), row) for row in dense]
    w = L.fit_machine(x, y, 5, cost=1.0, epochs=2000)
    full = np.hstack([dense, np.ones((60, 1))])
    loss = lambda w: 0.5 * w @ w + (np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    v = np.zeros(6)
    for _ in range(20_000):
        v -= 1e-3 * (v - 2 * full.T @ (y * np.maximum(0, 1 - y * (full @ v))))
    assert loss(w) <= loss(v) * 1.001


def test_one_language_or_none(spark):
    rows = made(40, 6, ("en",))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(docs, L.train(docs)).collect()} == {("en", 1.0)}
    model = L.train(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in L.identify(docs, model).collect()} == {("und", 0.0)}
