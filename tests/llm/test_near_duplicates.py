"""Near-duplicate classes: null and repeated ids at size, and recall on supplied documents against all pairs."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from floeberg.llm import dartminhash as D

SF = "/root/testdata/sf0.01"


def families(n, seed):
    """Texts of 60 words: one of each three is a light edit of the one before."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 1:
            words = out[-1].split()
            words[rng.randrange(60)] = f"e{rng.random()}"
        else:
            words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("ids", ["null", "one"])
def test_ids_that_are_null_or_repeat_cost_no_more(spark, tmp_path, ids):
    texts = families(6000, 1)
    name = F.lit(None).cast("long") if ids == "null" else F.lit(7).cast("long")
    docs = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    docs.withColumn("doc_id", name).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    located = D.with_locator(read)
    signed = D.sign(located.select("doc_id", "text", "_loc"))
    # Every wanted text is read once, whatever its id.
    assert D._sets(located.select("text", "_loc"), signed, signed.count()).count() == 6000
    got = D.near_duplicates(read)
    sizes = Counter(r.class_size for r in got.collect())
    assert sizes[2] == 4000 and sizes[1] == 2000


def test_rows_without_files_are_named_once(spark):
    docs = spark.createDataFrame([(None, t) for t in families(60, 2)], "doc_id long, text string").repartition(5)
    assert Counter(r.class_size for r in D.near_duplicates(docs.where("text is not null")).collect()) == {2: 40, 1: 20}


def weighted(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else Counter([tuple(words)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")
def test_recall_on_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: weighted(r.text) for r in docs.collect()}
    having = defaultdict(list)
    for i, own in sets.items():
        for shingle in own:
            having[shingle].append(i)
    seen, links = set(), []
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = sum((sets[a] & sets[b]).values())
                    if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                        links.append((a, b))
    of = {r.doc_id: r.class_id for r in D.near_duplicates(docs).collect()}
    caught = sum(of[a] == of[b] for a, b in links)
    assert len(links) > 20 and caught >= 0.99 * len(links)
    # No class joins texts that the links don't join.
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        top[root(a)] = root(b)
    assert all(root(i) == root(c) for i, c in of.items())
