"""Document fingerprints by winnowing.

Tokens are runs of non-white characters in lower case, at most 16 characters
each.  A cyclic polynomial over the token hashes gives a rolling hash of every
GRAM tokens; of each WINDOW neighbouring grams the least is selected, the rightmost if
several are least, and kept with its position.  So any run of GRAM + WINDOW - 1
tokens that two texts share yields a common fingerprint, and no match shorter than
GRAM tokens is reported.  All steps are array functions; the minimum over
windows takes log2(WINDOW) passes.  Hashes are ordered by their upper 33 bits,
so that positions have as many bits as an array has places.

Cases: null counts as empty; the empty text has the empty fingerprint and two
empty ones have likeness 1; a text under GRAM tokens is one gram of all its tokens;
with fewer than WINDOW grams one is selected; equal texts have equal
fingerprints; null ids come first in the order of ids; of rows with equal ids the
next one follows by a hash of the text; ids may have any type that has an order; an
empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import materialize, maybe_broadcast

GRAM, WINDOW = 5, 16
_PLACES = 31
_MASK = (1 << _PLACES) - 1
#: Ids in one block of neighbours, and in one that is too full.
NEIGHBOURS = 256
CROWDED = 32 * NEIGHBOURS


def _turn(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(high: Column, low: Column, by: int) -> Column:
    """Hash of a stretch from the hashes of its two parts, the second ``by`` tokens long."""
    return F.zip_with(high, low, lambda x, y: _turn(x, by).bitwiseXOR(y))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``name`` (position:hash, comma-joined) and ``name_set`` (the hashes)."""
    t, n = f"_{name}_h", f"_{name}_n"
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))
    df = df.withColumn(t, F.transform(tokens, lambda w: F.xxhash64(w))).withColumn(n, F.size(t))
    far = lambda col, k: F.slice(col, F.lit(k + 1), F.greatest(F.col(n), F.lit(1)))
    df = df.withColumn(f"{t}2", _joined(F.col(t), far(t, 1), 1))
    df = df.withColumn(f"{t}4", _joined(F.col(f"{t}2"), far(f"{t}2", 2), 2))
    whole = F.aggregate(F.col(t), F.lit(0).cast("long"), lambda a, x: _turn(a, 1).bitwiseXOR(x))
    grams = F.when(F.col(n) >= GRAM, F.slice(_joined(F.col(f"{t}4"), far(t, 4), 1), F.lit(1), F.greatest(F.col(n) - (GRAM - 1), F.lit(1)))).when(F.col(n) > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))
    g = f"_{name}_g"
    df = df.withColumn(g, F.transform(grams, lambda x: F.xxhash64(x)))
    packed = F.transform(F.col(g), lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.lit(_MASK).cast("long") - i))
    m = f"_{name}_m"
    df = df.withColumn(m, packed)
    step = 1
    while step < WINDOW:
        wide = f"{m}{step}"
        df = df.withColumn(wide, F.zip_with(F.col(m), far(m, step), lambda x, y: F.least(x, y)))
        m, step = wide, step * 2
    least = F.array_distinct(F.slice(F.col(m), F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))))
    places = f"_{name}_p"
    df = df.withColumn(places, F.transform(least, lambda x: (F.lit(_MASK).cast("long") - x.bitwiseAND(F.lit(_MASK).cast("long"))).cast("int")))
    df = df.withColumn(name, F.array_join(F.transform(F.col(places), lambda p: F.concat(p.cast("string"), F.lit(":"), F.hex(F.get(F.col(g), p)))), ","))
    df = df.withColumn(f"{name}_set", F.array_distinct(F.transform(F.col(places), lambda p: F.get(F.col(g), p))))
    return df.drop(*(c for c in df.columns if c.startswith(f"_{name}_")))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprint sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _following(blocks: DataFrame) -> DataFrame:
    """(block, after): the first id of the next block that has rows.

    Blocks are ordered inside groups of NEIGHBOURS; only the groups' firsts are
    ordered in one task, a 65,536th of the ids."""
    inner = Window.partitionBy("_group").orderBy("block")
    grouped = blocks.withColumn("_group", F.shiftright("block", NEIGHBOURS.bit_length() - 1))
    inside = grouped.withColumn("_after", F.lead("first").over(inner))
    firsts = grouped.groupBy("_group").agg(F.min("first").alias("_first"))
    lead = F.lead("_first").over(Window.orderBy("_group"))
    start = F.min("_first").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    jumps = firsts.select("_group", F.coalesce(lead, start).alias("_jump"))
    return inside.join(jumps, "_group").select("block", F.coalesce("_after", "_jump").alias("after"))


def _dense(ids: DataFrame) -> DataFrame:
    """(doc_id, _id): the rank of every distinct id.  Only ids are range-partitioned and written."""
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    at = F.monotonically_increasing_id()
    ordered = ids.select("doc_id").distinct().repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered = materialize(ordered.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_in": at.bitwiseAND((1 << 33) - 1)}), "winnow-ids")
    total, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy("_part").count().collect()):  # one row per partition
        starts.append((part, total))
        total += n
    firsts = spark.createDataFrame(starts, "_part int, _start long")
    return ordered.join(F.broadcast(firsts), "_part").select(F.col("doc_id").alias("_own"), (F.col("_start") + F.col("_in")).alias("_id"))


def _in_blocks(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids with _id and block, in the order of ids, and the written blocks.

    Whole numbers spread evenly fall into blocks by their upper bits.  Others, and
    those that crowd in few blocks, are numbered first, which costs a join."""
    if isinstance(ids.schema["doc_id"].dataType, T.IntegralType):
        low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
        span = int(high) - int(low) + 1 if n else 1
        bits = max(span * NEIGHBOURS // max(n, 1), NEIGHBOURS).bit_length() - 1
        even = ids.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("block", F.shiftright("_id", min(bits, 63)))
        blocks = materialize(even.groupBy("block").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")), "winnow-blocks")
        if (blocks.agg(F.max("n")).first()[0] or 0) <= CROWDED:
            return even, blocks
    ranks = _dense(ids)
    even = ids.join(maybe_broadcast(ranks, ranks.count()), F.col("doc_id").eqNullSafe(F.col("_own"))).drop("_own").withColumn("block", F.shiftright("_id", NEIGHBOURS.bit_length() - 1))
    return even, materialize(even.groupBy("block").agg(F.min("_id").alias("first")), "winnow-blocks")


def with_next(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """doc_id, text, its fingerprint, and text and fingerprint set of the next document.

    One shuffle of the texts, into blocks of neighbouring ids (and one more where
    ids must be numbered).  The last row of a block takes the first text of the
    next block, 1/NEIGHBOURS of the texts."""
    ids, blocks = _in_blocks(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    after = materialize(_following(blocks), "winnow-after")
    n = after.count()
    order = Window.partitionBy("block").orderBy("_id", F.xxhash64("text"))
    firsts = ids.join(maybe_broadcast(after.select(F.col("after").alias("_id"), F.col("block").alias("_before")), n), "_id")
    firsts = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy("_before").orderBy(F.xxhash64("text")))).where("_rank = 1")
    firsts = with_fingerprint(firsts.select(F.col("_before").alias("block"), F.col("text").alias("_text")), "_text", "first").select("block", "_text", F.col("first_set").alias("_set"))
    rows = ids.withColumn("next_text", F.lead("text").over(order)).withColumn("_last", F.lead(F.lit(1)).over(order).isNull())
    rows = with_fingerprint(rows, "text", name).withColumn("next_set", F.lead(f"{name}_set").over(order))
    joined = rows.alias("r").join(firsts.alias("f"), (F.col("r.block") == F.col("f.block")) & F.col("r._last"), "left")
    return joined.select("r.doc_id", "r.text", f"r.{name}", f"r.{name}_set", F.coalesce("r.next_text", "f._text").alias("next_text"), F.coalesce("r.next_set", "f._set").alias("next_set"))


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("_half")))
    rows = rows.withColumn("_edited", edited).drop("text", "next_text")
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint_set", "edited_fingerprint_set").alias("near_edited"), likeness("fingerprint_set", "next_set").alias("near_next"))
