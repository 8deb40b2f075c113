"""Snapshots over time, and references between tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.sources.storage import stored


def changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots (key, ts, seq, value) whose value differs from that before, with both."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("ts", "seq"))
    return snapshots.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("value"))).select("key", "seq", "before", "value")


def retained(snapshots: DataFrame, n: int = 50) -> DataFrame:
    """The newest n snapshots of each key."""
    line = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    return snapshots.withColumn("age", F.row_number().over(line)).where(F.col("age") <= n)


def resolve_references(tokens: DataFrame) -> DataFrame:
    """Follows values such as {a.b} from token to token (path, value), however far; null where a chain leads nowhere or in a circle.

    Pointers double their length in each round. On a chain with an end, each round settles some tokens until all are, so
    after a round that settles none only circles, and what leads into them or nowhere, are left.
    """
    to = F.regexp_extract("value", r"^\{(.+)\}$", 1)
    tokens = tokens.groupBy("path").agg(F.min("value").alias("value"))
    rows = stored(tokens.select("path", "value", F.when(to != "", to).alias("to"), F.when(to != "", 1).otherwise(0).alias("hops")))
    settled, open_ = rows.where(F.col("to").isNull()), rows.where(F.col("to").isNotNull())
    while True:
        ends = settled.union(open_).select(F.col("path").alias("at"), "value", F.col("to").alias("next"), F.col("hops").alias("more"))
        near = open_.select("path", F.col("to").alias("at"), "hops")
        moved = stored(near.join(ends, "at").select("path", "value", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops")))
        done = moved.where(F.col("to").isNull())
        if done.isEmpty():
            break
        settled, open_ = settled.union(done), moved.where(F.col("to").isNotNull())
    return rows.select("path").join(settled.select("path", F.col("value").alias("resolved"), "hops"), "path", "left")
