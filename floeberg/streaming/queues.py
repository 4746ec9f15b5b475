"""Message passing: queues keyed by destination.

In a batch, a queue is the rows of a destination in sequence order.  As a
stream, counting and accumulating on arrival are keyed state; running with
``availableNow`` ends when everything sent was received."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def receive(messages: DataFrame, dst: str, order: str) -> DataFrame:
    """Messages with their place in the destination's queue, first in first out."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy(dst).orderBy(order)))


def poll(messages: DataFrame, dst: str, order: str, payload: str) -> DataFrame:
    """(dst, first, n): what each queue shows first, and its length; a plain
    aggregate, so no queue is gathered in one task."""
    return messages.groupBy(dst).agg(F.min_by(payload, order).alias("first"), F.count(F.lit(1)).alias("n"))


def streaming_histogram(stream: DataFrame, index: str) -> DataFrame:
    """Running tally of a stream; write with output mode ``update`` or ``complete``."""
    return stream.groupBy(F.col(index).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def countdown(stream: DataFrame) -> DataFrame:
    """Accumulate on arrival: rows (dst, value, deps) emit (dst, total) once ``deps``
    values have arrived, whatever their order."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, sent = state.get if state.exists else (0, 0.0, False)
        deps = 0
        for frame in frames:
            seen, total, deps = seen + len(frame), total + float(frame.value.sum()), int(frame.deps.max())
        ready = not sent and seen >= deps > 0
        state.update((seen, total, sent or ready))
        if ready:
            yield pd.DataFrame({"dst": [key[0]], "total": [total]})

    return stream.groupBy("dst").applyInPandasWithState(update, "dst long, total double", "seen long, total double, sent boolean", "append", GroupStateTimeout.NoTimeout)


def latency(trace: DataFrame) -> DataFrame:
    """Mean latency of each pair and round of a trace (src, dst, round, ns)."""
    return trace.groupBy("src", "dst", "round").agg(F.avg("ns").alias("ns"))


def write_trace(messages: DataFrame, path: str) -> None:
    """``phase,source,dest,size`` lines."""
    messages.select("phase", "source", "dest", "size").write.mode("overwrite").csv(path)
