"""Best-fit packing under conflicts.

Texts longer than a bin are cut into full bins and a rest.  Pieces go, largest
first, to the bin with the smallest room that takes them (the successor of the
piece's size in an order of bins by room).  Bins carry bitmaps of sources and of
duplicate clusters: the search moves on to the next larger room until a bin is
found that has no piece of the same cluster and, better, none of the same
source either; if every bin that fits has the source, the tightest one
without the cluster is taken, and if none is free of the cluster, a new bin
opens.  So no bin ever holds two pieces of one cluster.  With ``strict_sources``
no bin holds two pieces of one source either: the source bitmap is a rule like the
cluster's, at the price of more and emptier bins where sources are few.

Windows of about WINDOW texts are packed independently, in parallel; a window
is the unit of work whatever the corpus size.

Cases: null text or source counts as empty, which is a value of its own; empty
texts take one unit (their end); repeated rows share a cluster and so never a
bin; very long texts span many bins; ids may have any type; an empty table gives
no rows."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CAPACITY, WINDOW = 2048, 4096


def token_estimate(text: str = "text") -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and one for the end."""
    return (F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4) + 1).cast("long")


def cluster_of(text: str = "text") -> Column:
    """Exact-duplicate cluster: a hash of the text in lower case without white space."""
    return F.xxhash64(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), " \t\n\x0b\x0c\r", ""))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, strict_sources: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, bin, start in the bin, length), bins numbered from 0."""
    count: dict = {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    s_bit: dict = {}
    c_bit: dict = {}
    for s in sources:
        s_bit.setdefault(s, 1 << len(s_bit))
    for c in clusters:
        if count[c] > 1:
            c_bit.setdefault(c, 1 << len(c_bit))
    out, room, s_map, c_map = [], [], [], []
    rest = []
    for i, n in enumerate(sizes):
        piece = 0
        while n > capacity:  # a full bin of one piece
            out.append((i, piece, len(room), 0, capacity))
            room.append(0)
            s_map.append(0)
            c_map.append(0)
            n -= capacity
            piece += 1
        rest.append((-n, i, piece))
    order: list[tuple[int, int]] = []  # (room, bin), rooms over 0
    for minus, i, piece in sorted(rest):
        n, s, c = -minus, s_bit[sources[i]], c_bit.get(clusters[i], 0)
        found = spare = -1
        for k in range(bisect_left(order, (n, -1)), len(order)):
            b = order[k][1]
            if c_map[b] & c:
                continue
            if not s_map[b] & s:
                found = k
                break
            if spare < 0 and not strict_sources:
                spare = k
        k = found if found >= 0 else spare
        if k >= 0:
            b = order.pop(k)[1]
        else:
            b = len(room)
            room.append(capacity)
            s_map.append(0)
            c_map.append(0)
        out.append((i, piece, b, capacity - room[b], n))
        room[b] -= n
        s_map[b] |= s
        c_map[b] |= c
        if room[b]:
            insort(order, (room[b], b))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, strict_sources: bool = False) -> DataFrame:
    """Pack items (window, doc_id, size, source, cluster) window by window.

    One row per piece: doc_id, piece, window, bin (in the window), start, length."""
    kind = items.schema["doc_id"].dataType.simpleString()
    window = items.schema["window"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "cluster"], kind="stable").reset_index(drop=True)
        placed = best_fit(part["size"].tolist(), part["source"].tolist(), part["cluster"].tolist(), capacity, strict_sources)
        at = [p[0] for p in placed]
        out = pd.DataFrame({"doc_id": part["doc_id"].take(at).to_numpy(), "piece": [p[1] for p in placed], "window": part["window"].take(at).to_numpy(), "bin": [p[2] for p in placed], "start": [p[3] for p in placed], "length": [p[4] for p in placed]})
        return out[["doc_id", "piece", "window", "bin", "start", "length"]]

    # pandas has no null integers: a null id travels as text, and so do all others.
    ready = items.select("window", F.col("doc_id").cast("string").alias("doc_id"), "size", F.coalesce("source", F.lit("\x00null")).alias("source"), "cluster")
    out = ready.groupBy("window").applyInPandas(one, f"doc_id string, piece int, window {window}, bin int, start int, length int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def by_hash(docs: DataFrame, rows: int, size: int = WINDOW) -> Column:
    """Windows of about ``size`` rows whatever the ids and sources: by id and text,
    so that rows that repeat an id spread too."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(max(1, -(-rows // size)))).cast("string")


def place_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Written docs with their window: ``size`` neighbouring rows, counted on through
    the files in the order of their names.  Keeps the order of a mix."""
    marked = docs.withColumn("_name", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index"))
    total, starts = 0, []
    for name, n in sorted((r[0], r[1]) for r in marked.groupBy("_name").count().collect()):  # one row per file
        starts.append((name, total))
        total += n
    firsts = docs.sparkSession.createDataFrame(starts, "_name string, _start long")
    return marked.join(F.broadcast(firsts), "_name").withColumn("window", F.floor((F.col("_start") + F.col("_row")) / size).cast("string")).drop("_name", "_row", "_start")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = docs.select(by_hash(docs, docs.count()).alias("window"), "doc_id", token_estimate().alias("size"), "source", cluster_of().alias("cluster"))
    return pack(items, strict_sources=True)
