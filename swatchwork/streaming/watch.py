"""Change tracking and rate limits as streaming jobs with state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose value differs from that before; late rows, older than the state, are left out."""
    seq, last = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        if seq is not None and r.seq <= seq:
            continue
        if seq is not None and r.value != last:
            out.append((key[0], r.seq, last, r.value))
        seq, last = int(r.seq), r.value
    if seq is not None:
        state.update((seq, last))
    yield pd.DataFrame(out, columns=["key", "seq", "before", "value"])


def watch(snapshots: DataFrame) -> DataFrame:
    """Changes of each key's value in a stream of (key long, seq long, value string)."""
    return snapshots.groupBy("key").applyInPandasWithState(_watch, "key long, seq long, before string, value string", "seq long, value string", "append", GroupStateTimeout.NoTimeout)


def _limit(most: int, window_ms: int):
    def limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, hits = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ms", "seq"]).itertuples(index=False):
            if start is None or r.ms - start >= window_ms:
                start, hits = int(r.ms), 0
            hits += 1
            out.append((key[0], r.seq, hits <= most, max(0, most - hits)))
        state.update((start, hits))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "remaining"])

    return limit


def rate_limit(hits: DataFrame, most: int = 10, window_ms: int = 60_000) -> DataFrame:
    """Which hits of (key long, seq long, ms long) a window allows that begins at the first hit and again once it has passed."""
    return hits.groupBy("key").applyInPandasWithState(_limit(most, window_ms), "key long, seq long, allowed boolean, remaining long", "start long, hits long", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of (ts timestamp, kind, value) in tumbling windows behind a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def drained(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives its rows, written as Parquet where append allows it."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def told(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Runs a stream in update mode over all that is there now and gives every row that it told, of this run and of those before in this folder.

    Each batch is written to a folder of its own number, so that one that runs again after a failure takes its own place. Not
    for streams whose state has a time to live: these go on as long as the clock does.
    """
    out = f"{folder}/{name}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)
