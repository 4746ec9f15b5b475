"""Token alignment against plain loops over whole texts."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from floeberg.llm import alignment as A

FILES = f"{A.TOKENIZERS}/byte_bpe_50k.json", f"{A.TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="no vocabularies")


def plain(texts):
    """What each text gets, encoding it whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    byte, rows, counts = A.byte_alphabet(), [], Counter()
    for t in texts:
        said = (" " + (t or "")).encode()
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if not t or b"".join(bx) != said or b"".join(by) != said:
            rows.append((0, 0, [], []))
            continue
        groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b and i < len(x):
                at_a += len(bx[i])
                ga.append(x[i])
                i += 1
            else:
                at_b += len(by[j])
                gb.append(y[j])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        counts.update(links)
        rows.append((len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, k in rows]


def texts():
    rng = random.Random(3)
    words = ["the", "and", "naïve", "don't", "123", "x1", "<|endoftext|>", "</s>", "ééé", "日本語", " ", "　", "\t", "\n\n", "  ", "", "a" * 40, "😀", "​", "\x1f", "'s", "é"]
    out = [None, "", " ", "  ", "\n", " a", "a ", "a  ", "▁", "a▁b c", "\x00", "<0x41>", "a \n b", "x" * 3000, "ab " * 90_000]
    return out + ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n "]) for _ in range(rng.randint(1, 60))) for _ in range(120)]


def as_rows(got):
    return Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


@pytest.mark.parametrize("head", [A.HEAD, 40])
def test_against_whole_texts(spark, tmp_path, head):
    every = texts()
    every += every[20:30]  # repeated rows
    docs = spark.createDataFrame([(None if i == 3 else i, t, 0, 1) for i, t in enumerate(every)], "doc_id int, text string, pairs int, _row int")
    got = A.alignment(docs.repartition(3), *FILES, head=head).collect()
    assert as_rows(got) == Counter(plain(every))
    want = plain(every)
    assert all(want[r.doc_id][:4] == (r.n_a, r.n_b, r.n_groups, r.n_links) for r in got if r.doc_id is not None)


def test_query(spark, odd):
    folder, rows = odd
    got = A.op13_token_alignment(spark, folder).collect()
    assert as_rows(got) == Counter(plain([r[1] for r in rows])) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_pieces_and_forgetting_change_nothing(monkeypatch):
    every = [t for t in texts() if t]
    blobs = [open(f, "rb").read() for f in FILES]

    def run():
        aligner, states = A.Aligner(*blobs, "ends"), {}
        for k, t in enumerate(every):
            states[k] = A._State()
            aligner.add([(k, p) for p in A.pieces(t, aligner.cuts)], states)
        return [(*s.row()[:5], s.row()[5].tolist(), s.row()[6].tolist()) for s in states.values()]

    want = run()
    monkeypatch.setattr(A, "PIECE", 50)
    monkeypatch.setattr(A, "MOST_HELD", 30)
    monkeypatch.setattr(A, "RUN", 3)
    assert run() == want


def test_links_by_repeats():
    rng = np.random.default_rng(1)
    for mode in ("ends", "groups"):
        for _ in range(30):
            n = int(rng.integers(2, 40))
            cut = [np.unique(np.append(rng.integers(1, n, 9), n)) for _ in range(2)]
            la, lb = (np.diff(c, prepend=0) for c in cut)
            common, ga, gb, x, y = A.align(la, lb, mode)
            assert common.tolist() == sorted(set(cut[0]) & set(cut[1]))
            same = (cut[0][:, None] == cut[1]) if mode == "ends" else (ga[:, None] == gb)
            assert sorted(zip(x.tolist(), y.tolist())) == sorted(zip(*map(list, np.nonzero(same)))) or not same.any()
