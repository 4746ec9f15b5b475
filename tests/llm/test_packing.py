"""The whole result of the packing query: every text once, bins within their capacity, no source and no cluster twice in a bin."""

import os
from collections import defaultdict

import pytest

from floeberg.llm import bestfit as B

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")
def test_bins_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r.doc_id: r for r in docs.select("doc_id", "source", B.token_estimate().alias("size"), B.cluster_of().alias("cluster")).collect()}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in B.op10_best_fit_packing(spark, SF).collect():
        bins[r.window, r.bin].append(r)
        pieces[r.doc_id].append(r)
    assert pieces.keys() == of.keys()
    for i, own in pieces.items():
        assert sorted(r.piece for r in own) == list(range(len(own))) and sum(r.length for r in own) == of[i].size
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and own[-1].start + own[-1].length <= B.CAPACITY
        for what in ("source", "cluster"):
            seen = [getattr(of[r.doc_id], what) for r in own]
            assert len(seen) == len(set(seen))
    # No bin could take all that another holds: its texts would have gone there.
    assert len(bins) < 1.15 * sum(r.size for r in of.values()) / B.CAPACITY + 1
