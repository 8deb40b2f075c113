"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words by its weight; a target ends at CAP times what the source has, and what is over goes
to the other sources by weight. A document's expected number of copies follows from its source's target and its size
class: longer texts are drawn on less often than short ones (by a small power of their length), so that no few of them
make up a source. The whole part of that number is taken for certain. The rest is its inclusion probability p for one
more copy, for which the documents of a source are ranked by [u/(1-u)] / [p/(1-p)] with a random u that the id and the
text fix, and taken from the front. The sample's size is fixed in words, the unit of the target: it ends where the next
document would go beyond it, and the last gap is filled with the documents behind the cut that fit it best, one by one.

Ranks are never put in one line: sums over bins of the rank's value find the bin in which the target is reached, and that
bin is cut into finer ones, until a bin is one of 2**33. All that is known of a source is a row or two, which is sent to
the documents, so a source may hold any share of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchwork.llm import common

CAP = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Power of a document's length class by which its expected copies go down.
TILT = 0.125
#: Ranks are whole numbers of RANK_BITS bits, looked at BIN_BITS at a time; documents that fill a source's last gap.
RANK_BITS, BIN_BITS, FILLERS = 33, 11, 8
#: Share of its target by which a source may miss it before its cut goes back.
NEAR = 0.002
SEED = 17


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from a row for each source (source, source_size). Targets add up to all words, or to CAP times all."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, not for each document
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = common.stored(sizes.select("source", "source_size", weight.alias("weight")))
    most = F.col("source_size") * float(CAP)
    level, full = 0.0, -1
    while True:  # each turn fixes the sources that reach their cap; ends when a turn fixes no more
        capped = most <= F.col("weight") * level
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, most)).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if r["n"] == full or not r["open"]:
            break
        full, level = r["n"], ((r["all"] or 0) - (r["capped"] or 0.0)) / r["open"]
    return rows.select("source", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def _copies(classes: pd.DataFrame) -> pd.DataFrame:
    """Expected copies of each size class of one source, so that their words add up to its target."""
    tilt = 2.0 ** (-TILT * classes["size_class"].to_numpy(float))
    words, target = classes["words"].to_numpy(float), float(classes["target"].iloc[0])
    capped = tilt < 0
    while True:
        left, open_ = target - CAP * words[capped].sum(), (words * tilt)[~capped].sum()
        rate = left / open_ if open_ > 0 else 0.0
        more = ~capped & (rate * tilt >= CAP)
        if not more.any():
            break
        capped |= more
    copies = pd.Series(rate * tilt).where(~capped, float(CAP)).clip(0.0, float(CAP))
    return classes.assign(whole=copies.astype(int), part=copies - copies.astype(int))[["source_key", "size_class", "whole", "part"]]


def _key(source: Column) -> Column:
    """A key for joins, which a null source has too."""
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))


def _cuts(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(source_key, cut, gap) of the sources that do not take all drawn documents: those with a rank below ``cut`` are taken, ``gap`` words are then missing."""
    found = plan.select("source_key", "rest").distinct().select("source_key", "rest", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"))
    for left in range(RANK_BITS - BIN_BITS, -1, -BIN_BITS):  # three turns
        size = 1 << left
        found = common.small(common.stored(found))
        inside = units.join(found, "source_key").where((F.col("rank") >= F.col("cut")) & (F.col("rank") < F.col("cut") + size * (1 << BIN_BITS)))
        bins = inside.groupBy("source_key", "rest", "cut", "before", F.floor((F.col("rank") - F.col("cut")) / size).alias("bin")).agg(F.sum("words").alias("words"))
        up_to = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 2**BIN_BITS rows at most
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(up_to))
        passed = bins.where(F.col("upto") > F.col("rest")).groupBy("source_key", "rest").agg(F.min(F.struct("bin", "cut", (F.col("upto") - F.col("words")).alias("before"))).alias("first"))
        found = passed.select("source_key", "rest", (F.col("first.cut") + F.col("first.bin") * size).alias("cut"), F.col("first.before").alias("before"))
    return found.select("source_key", "cut", (F.col("rest") - F.col("before")).alias("gap"))


def _fillers(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source_key, cut, gap, fillers): the ranks behind the cut that are taken too, each the one whose words come nearest to what is missing, from below if one does, by rank if several do."""
    now = common.stored(cuts.withColumn("fillers", F.array().cast("array<long>")))
    for _ in range(FILLERS):
        behind = units.join(common.small(now), "source_key").where((F.col("rank") >= F.col("cut")) & ~F.array_contains("fillers", F.col("rank")))
        miss = F.abs(F.col("words") - F.col("gap"))
        best = behind.where(miss < F.col("gap")).groupBy("source_key").agg(F.min(F.struct((F.col("words") > F.col("gap")).alias("over"), miss.alias("miss"), "rank", "words")).alias("best"))
        best = common.stored(best)
        if best.isEmpty():
            break
        now = now.join(best, "source_key", "left").select("source_key", "cut", (F.col("gap") - F.coalesce("best.words", F.lit(0))).alias("gap"), F.when(F.col("best").isNull(), F.col("fillers")).otherwise(F.array_append("fillers", F.col("best.rank"))).alias("fillers"))
        now = common.stored(now)
    return now


def _ends(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(source_key, cut, gap, fillers) of the sources that do not take all drawn documents.

    Where what is left behind the cut is too long for the gap, the cut goes back by as much as the shortest of it is long,
    and the larger gap is filled; of the two ends, the nearer to the target counts.
    """
    first = _fillers(units, _cuts(units, plan))
    far = first.join(plan.select("source_key", "rest", "target").distinct(), "source_key").where(F.abs("gap") > NEAR * F.col("target")).select("source_key", "cut", "gap", "fillers", "rest")
    far = common.small(common.stored(far))
    left = units.join(far, "source_key").where((F.col("rank") >= F.col("cut")) & ~F.array_contains("fillers", F.col("rank")))
    lower = common.stored(left.groupBy("source_key", "rest").agg(F.min("words").alias("need")).where("need <= rest"))
    if lower.isEmpty():
        return first
    lower = common.small(lower)
    cuts = _cuts(units, lower.select("source_key", (F.col("rest") - F.col("need")).alias("rest"))).join(lower, "source_key")
    again = _fillers(units, cuts.select("source_key", "cut", (F.col("gap") + F.col("need")).alias("gap")))
    nearer = F.min_by(F.struct("cut", "gap", "fillers"), F.abs("gap")).alias("end")
    return first.unionByName(again).groupBy("source_key").agg(nearer).select("source_key", "end.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, certain, chance), a row for each row of ``docs`` (doc_id, text, source).

    ``size`` counts runs of what is not white space; a null text has 0 words and none are taken of it. A null source is a
    source of its own, after all others. ``taken`` is copies times size, CAP times size at most; ``certain`` copies are
    taken whatever is drawn, and one more with the inclusion probability ``chance``. Equal rows (same id and text) are taken or left together. Reruns with one ``seed`` give
    the same mix. If there are no words, targets are 0. Whole texts of any length count. An empty table gives an empty
    table; other columns are not looked at.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "source", size.alias("size"), u.alias("u")).withColumn("source_key", _key(F.col("source")))
    rows = rows.withColumn("size_class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    rows = common.stored(rows)
    classes = common.stored(rows.groupBy("source_key", "source", "size_class").agg(F.sum("size").alias("words")))
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    sources = common.stored(sources.withColumn("source_key", _key(F.col("source"))).drop("source"))
    copies = classes.join(sources, "source_key").select("source_key", "size_class", "words", "target")
    copies = copies.groupBy("source_key").applyInPandas(_copies, "source_key string, size_class int, whole int, part double")  # at most 63 rows each
    whole = classes.join(copies, ["source_key", "size_class"]).groupBy("source_key").agg(F.sum(F.col("words") * F.col("whole")).alias("certain"))
    plan = copies.join(sources, "source_key").join(whole, "source_key")
    plan = common.stored(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain"))))
    # plan has a row for each source and size class
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    drawn = (F.col("part") > 0) & (F.col("size") > 0)
    rank = F.when(drawn, F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("long"))
    rows = rows.join(common.small(plan), ["source_key", "size_class"]).withColumn("rank", rank)
    units = common.stored(rows.where("rank is not null").groupBy("source_key", "rank").agg(F.sum("size").alias("words")))
    ends = common.stored(_ends(units, plan))
    rows = rows.join(common.small(ends.select("source_key", "cut", "fillers")), "source_key", "left")
    more = F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("rank") < F.col("cut")) | F.coalesce(F.array_contains("fillers", F.col("rank")), F.lit(False)))
    n = F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"), n.cast("int").alias("copies"), F.col("whole").alias("certain"), F.col("part").alias("chance"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
