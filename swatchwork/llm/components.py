"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchwork.llm import common

#: Parts into which the members of one component are dealt when they look up their label's label.
SALTS = 32


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): component is the smallest node that is reachable.

    Each round hands every node the smallest label among its neighbours and then the label of its label, so that the
    distance to the smallest node about halves; it ends when no label moved. Labels are written as a table to the
    checkpoint folder each round: a plan that reads a table stays small, however many rounds there are. A node with very
    many links meets its label in parts, and so do the members of a very large component. Links in either direction,
    repeated links and loops are fine; null ends are left out; no link, no row.
    """
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = both.union(both.select(F.col("b"), F.col("a"))).distinct()
    both = common.stored(both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    # only a node of many links is worth copying its label for
    hubs = common.stored(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SALTS * 8).select(F.col("b").alias("node")))
    while True:
        far = labels.join(hubs, "node", "left_semi").select(F.col("node").alias("b"), "label", salts)
        by_hub = both.join(far, ["b", "salt"]).select("a", "label")
        by_node = both.join(labels.join(hubs, "node", "left_anti").select(F.col("node").alias("b"), "label"), "b").select("a", "label")
        near = by_hub.union(by_node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = common.stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        used = step.groupBy("label").agg(F.count("*").alias("members"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further")).join(used, "label").select("label", "further", salts)
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        step = common.stored(salted.join(jump, ["label", "salt"]).select("node", "old", F.least("label", "further").alias("label")))
        moved = step.where(F.col("label") != F.col("old")).limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
