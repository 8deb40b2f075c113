"""Scales and clusters: base units, natural breaks, anchored and chained clusters, ratios, colour clusters.

Folds run over the few distinct values of a page, not over its elements.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T

#: Base units that are tried, and type ratios by name.
UNITS = (2, 4, 5, 6, 7, 8, 10, 12, 16)
RATIOS = {"minor second": 1.067, "major second": 1.125, "minor third": 1.2, "major third": 1.25, "perfect fourth": 1.333, "augmented fourth": 1.414, "perfect fifth": 1.5, "golden": 1.618}


def whole_pixels(text: Column) -> Column:
    return T.half_up(T.number(text))


def spacing_values(elements: DataFrame, least: float = 0, most: float = 500) -> DataFrame:
    """Distinct spacings of each page, whole pixels."""
    # a page has few distinct texts of spacings: only these are read
    texts = elements.select("page_id", F.explode(F.array("padding", "margin")).alias("text")).distinct()
    # out of an outer explode, as a filter on the text alone is pushed below the distinct, where every element would be read
    v = F.explode_outer(F.array(whole_pixels(F.col("text")))).alias("value")
    return texts.select("page_id", v).where((F.col("value") > least) & (F.col("value") < most)).distinct()


def natural_breaks(values: DataFrame) -> DataFrame:
    """Groups of a page's values, parted where a gap is larger than the upper median gap, by their smallest value."""
    line = Window.partitionBy("page_id").orderBy("value")
    gaps = values.withColumn("gap", F.col("value") - F.lag("value").over(line))
    sorted_gaps = F.array_sort(F.collect_list("gap"))
    median = gaps.groupBy("page_id").agg(F.get(sorted_gaps, F.floor(F.size(sorted_gaps) / 2).cast("int")).alias("median"))
    rows = gaps.join(median, "page_id").withColumn("group", F.sum(F.when(F.col("gap") > F.col("median"), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page_id", "group").agg(F.min("value").alias("value"), F.count("*").alias("members")).select("page_id", "value", "members")


def unit_fit(values: DataFrame) -> DataFrame:
    """(page_id, n_values, base_unit, score, on_base) as in ``base_unit``, with how many values the unit divides, 0 without one."""
    unit = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(u).alias("unit")) for i, u in enumerate(UNITS)))).alias("u")
    divides = F.col("value") % F.col("unit") == 0
    share = F.avg(F.when(divides, 1.0).otherwise(0.0)) + F.when(F.col("unit").isin(4, 8), 0.04).otherwise(0.0)
    rows = values.select("page_id", "value", unit).select("page_id", "value", "u.*").groupBy("page_id", "rank", "unit").agg(F.count("*").alias("n"), F.round(share, 6).alias("score"), F.count(F.when(divides, 1)).alias("hits"))
    best = rows.groupBy("page_id").agg(F.max("n").alias("n_values"), F.max(F.struct("score", (-F.col("rank")).alias("minus"), "unit", "hits")).alias("best"))
    good = (F.col("n_values") >= 3) & (F.col("best.score") >= 0.6)
    return best.select("page_id", "n_values", F.when(good, F.col("best.unit")).alias("base_unit"), F.when(good, F.col("best.score")).alias("score"), F.when(good, F.col("best.hits")).otherwise(0).alias("on_base"))


def base_unit(values: DataFrame) -> DataFrame:
    """The unit that divides most values, with 0.04 more for 4 and 8; first of equals; null below 0.6 or with under 3 values."""
    return unit_fit(values).drop("on_base")


def anchored_clusters(values: DataFrame, threshold: float) -> DataFrame:
    """Sorted values join a group while they are within the threshold of its first value: (page_id, anchor, members)."""
    xs = values.groupBy("page_id").agg(F.array_sort(F.collect_set(F.col("value").cast("double"))).alias("xs"))
    step = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x - F.element_at(a, -1) <= threshold, a).otherwise(F.concat(a, F.array(x)))
    anchors = xs.withColumn("anchors", F.aggregate("xs", F.array().cast("array<double>"), step))
    rows = anchors.select("page_id", F.explode("xs").alias("x"), "anchors")
    own = F.array_max(F.filter("anchors", lambda a: a <= F.col("x")))
    return rows.groupBy("page_id", own.alias("anchor")).agg(F.count("*").alias("members"))


def chained_clusters(values: DataFrame, tolerance: float) -> DataFrame:
    """Values (value, uses) join while within max(1, last * tolerance) of the last member; named by the most used member."""
    line = Window.partitionBy("page_id").orderBy("value")
    last = F.lag("value").over(line)
    rows = values.withColumn("apart", F.when(F.col("value") - last > F.greatest(F.lit(1.0), last * tolerance), 1).otherwise(0))
    rows = rows.withColumn("group", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("uses", (-F.col("value")).alias("minus")))
    return rows.groupBy("page_id", "group").agg((-best["minus"]).alias("value"), F.sum("uses").alias("uses"), F.count("*").alias("members")).drop("group")


def scale_ratios(values: DataFrame) -> DataFrame:
    """Mean and population variance of the ratios of neighbouring values between 1.01 and 3."""
    ratio = F.col("value") / F.lag("value").over(Window.partitionBy("page_id").orderBy("value"))
    rows = values.withColumn("ratio", ratio).where("ratio > 1.01 and ratio < 3")
    return rows.groupBy("page_id").agg(F.count("*").alias("steps"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.var_pop("ratio"), 6).alias("variance"))


def type_ratio(values: DataFrame) -> DataFrame:
    """The named ratio whose whole powers come nearest to the steps of a page's sizes (page_id, value).

    (page_id, steps, ratio_name, ratio, fit, coverage, anchor): steps counts the distinct sizes. The error of a step is
    relative to the power expected; a power above 3 costs 0.5 more and the mean power 0.03 for each beyond the first. Below
    a fit of one half the name is ``irregular``; with under three sizes, or under two steps between 1.01 and 3, it is
    ``none``. Coverage is the share of sizes within 5 percent of the ladder that grows from the best of them, the anchor.
    """
    line = Window.partitionBy("page_id").orderBy("value")
    sizes = values.where("value > 0").select("page_id", F.col("value").cast("double").alias("value")).distinct()
    rows = sizes.withColumn("step", F.col("value") / F.lag("value").over(line))
    pages = values.select("page_id").distinct().join(sizes.groupBy("page_id").agg(F.array_sort(F.collect_list("value")).alias("sizes")), "page_id", "left")
    steps = rows.where("step > 1.01 and step < 3")
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.lit(r).alias("ratio")) for i, (n, r) in enumerate(RATIOS.items())))).alias("t")
    fits = steps.select("page_id", "step", named).select("page_id", "step", "t.*")
    fits = fits.withColumn("power", F.greatest(F.lit(1.0), T.half_up(F.log("step") / F.log("ratio"))))
    off = F.abs(F.col("step") / F.pow("ratio", "power") - 1) + F.when(F.col("power") > 3, 0.5).otherwise(0.0)
    fits = fits.groupBy("page_id", "rank", "name", "ratio").agg(F.count("*").alias("n"), F.round(F.avg(off) + 0.03 * (F.avg("power") - 1), 9).alias("error"))
    best = fits.where("n > 1").groupBy("page_id").agg(F.min(F.struct("error", "rank", "name", "ratio")).alias("best"))
    rows = pages.join(best, "page_id", "left").select("page_id", F.coalesce(F.size("sizes"), F.lit(0)).alias("steps"), "sizes", F.when(F.size("sizes") >= 3, F.col("best")).alias("best"))
    fit = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("best.error") / 0.15)), F.lit(0.0))
    rows = rows.withColumn("fit", fit).withColumn("ratio", F.when(F.col("fit") >= 0.5, F.col("best.ratio")))
    rung = lambda a, s: a * F.pow("ratio", T.half_up(F.log(s / a) / F.log("ratio")))
    hits = lambda a: F.size(F.filter("sizes", lambda s: F.abs(s / rung(a, s) - 1) <= 0.05))
    ladder = F.array_max(F.transform("sizes", lambda a: F.struct(hits(a).alias("hits"), (-a).alias("minus"))))
    rows = rows.withColumn("ladder", F.when(F.col("ratio").isNotNull(), ladder))
    name = F.when(F.col("best").isNull(), "none").when(F.col("ratio").isNull(), "irregular").otherwise(F.col("best.name"))
    two = lambda x: T.half_up(x * 100) / 100
    return rows.select("page_id", "steps", name.alias("ratio_name"), "ratio", two(F.col("fit")).alias("fit"), F.coalesce(two(F.col("ladder.hits") / F.col("steps")), F.lit(0.0)).alias("coverage"), (-F.col("ladder.minus")).alias("anchor"))


def near_duplicate_colors(colors: DataFrame, limit: float = 8.0) -> DataFrame:
    """Pairs of a page's colours (page_id, hex) that differ by less than the limit, cut into cells so that only near ones meet."""
    rows = colors.select("page_id", "hex", C.parse_color(F.col("hex")).alias("c"))
    cell = lambda k, shift: (F.floor(F.col("c")[k] / limit) + shift).alias(k)
    home = rows.select("page_id", "hex", "c", *(cell(k, 0) for k in "rgb"))
    # of two cells beside each other one looks for the other: 13 of the 26 around, and its own
    steps = [(0, 0, 0), *(d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0))]
    around = rows.select("page_id", F.col("hex").alias("other"), F.col("c").alias("d"), F.explode(F.array(*(F.struct(F.lit(d == (0, 0, 0)).alias("own"), *(cell(k, n) for k, n in zip("rgb", d, strict=True))) for d in steps))).alias("at")).select("page_id", "other", "d", "at.*")
    pairs = home.join(around, ["page_id", "r", "g", "b"]).where("not own or hex < other").select("page_id", F.least("hex", "other").alias("first"), F.greatest("hex", "other").alias("second"), F.round(C.rgb_distance(F.col("c"), F.col("d")), 4).alias("distance"))
    return pairs.where(F.col("distance") < limit).where("first != second")


def _seeded(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column("line")
            rows, count = line.flatten(), line.value_lengths().to_numpy()
            c = np.stack([pc.fill_null(rows.field(k), -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in "rgb"], 1)
            seed = np.full(len(c), -1)
            for end, n in zip(np.cumsum(count), count, strict=True):
                free = np.arange(end - n, end)
                free = free[(c[free] >= 0).all(1)]
                while len(free):  # the first that no seed has taken is the next seed
                    near = np.sqrt(((c[free] - c[free[0]]) ** 2).sum(1)) < threshold
                    near[0] = True
                    seed[free[near]], free = free[0] - (end - n), free[~near]
            pages = batch.column("page_id").take(pa.array(np.repeat(np.arange(len(count)), count)))
            yield pa.RecordBatch.from_arrays([pages, *(rows.field(k) for k in ("hex", "uses", "first_place")), pa.array(seed, pa.int32())], names=["page_id", "hex", "uses", "first_place", "seed"])

    return run


def color_clusters(usage: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Clusters of a page's colours (page_id, hex, uses, first_place): each joins the first seed nearer than the threshold, or becomes a seed, in order of first places.

    (page_id, hex, uses, members, rank): the most used member, the first of equals, stands for its cluster. A page's distinct
    colours meet in one task, where each seed takes in one step what no earlier one has.
    """
    rgb = [F.conv(F.substring("hex", k, 2), 16, 10).cast("int").alias(c) for k, c in ((2, "r"), (4, "g"), (6, "b"))]
    rows = usage.select("page_id", "hex", F.col("uses").cast("long").alias("uses"), F.col("first_place").cast("long").alias("first_place"), *rgb)
    line = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("first_place", "hex", "uses", "r", "g", "b"))).alias("line"))
    schema = S.StructType([line.schema["page_id"], *S.StructType.fromDDL("hex string, uses long, first_place long, seed int").fields])
    rows = line.mapInArrow(_seeded(threshold), schema)
    best = F.max(F.struct("uses", (-F.col("first_place")).alias("minus"), "hex"))["hex"]
    clusters = rows.groupBy("page_id", "seed").agg(best.alias("hex"), F.sum("uses").alias("uses"), F.count("*").alias("members"), F.min("first_place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("uses"), F.asc("first"), F.asc("hex")))
    return clusters.select("page_id", "hex", "uses", "members", rank.alias("rank"))


def lightness_band(c: Column) -> Column:
    """Five bands of OKLab lightness."""
    return F.least(F.floor(C.to_oklab(c)["l"] * 5), F.lit(4)).cast("int")
