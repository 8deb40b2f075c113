"""Pages against pages: coverage, consistency, overlap, differences, reconciliation, brand matrices, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions import csstext as T
from swatchwork.operators.usage import top


def coverage(rows: DataFrame) -> DataFrame:
    """Values (site, page, value, uses) by the pages of their site that have them, and their scope by the unrounded share."""
    pages = rows.groupBy("site").agg(F.countDistinct("page").alias("total"))
    values = rows.groupBy("site", "value").agg(F.countDistinct("page").alias("pages"), F.sum("uses").alias("uses")).join(pages, "site")
    share = F.col("pages") / F.col("total")
    scope = F.when(share >= 0.8, "site-wide").when(share >= 0.4, "recurring").otherwise("local")
    return values.select("site", "value", "pages", "total", "uses", F.round(share, 2).alias("coverage"), scope.alias("scope"))


def consistency(covered: DataFrame) -> DataFrame:
    """Share of uses that are of site-wide values; null for a site of one page."""
    ratio = F.sum(F.when(F.col("scope") == "site-wide", F.col("uses")).otherwise(0)) / F.sum("uses")
    return covered.groupBy("site").agg(F.max("total").alias("pages"), F.when(F.max("total") > 1, F.round(ratio, 4)).alias("consistency"))


def off_system(covered: DataFrame, n: int = 25) -> DataFrame:
    """Values of one page alone that are used at least twice and not site-wide, the most used first."""
    rows = covered.where("pages = 1 and uses >= 2 and scope != 'site-wide'")
    return top(rows.select("site", "value", "uses"), ["site"], n, F.desc("uses"), F.asc("value"))


def pair_overlap(sets: DataFrame) -> DataFrame:
    """Jaccard of each two pages of a site (site, page, value) that share any value, by an inverted index: pages without a shared value make no row."""
    rows = sets.select("site", "page", "value").distinct()
    sizes = rows.groupBy("page").agg(F.count("*").alias("n"))
    a, b = rows.toDF("site", "a", "value"), rows.toDF("site", "b", "value")
    both = a.join(b, ["site", "value"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    both = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return both.select("a", "b", "overlap", union.alias("union_size"), F.round(F.col("overlap") / union, 6).alias("ratio"))


def multiset_overlap(counts: DataFrame, left: Column, right: Column) -> DataFrame:
    """Sum of minima over sum of maxima of the uses of two sides of (key, value, uses)."""
    sides = counts.groupBy("key", "value").agg(F.coalesce(F.sum(F.when(left, F.col("uses"))), F.lit(0)).alias("x"), F.coalesce(F.sum(F.when(right, F.col("uses"))), F.lit(0)).alias("y"))
    return sides.groupBy("key").agg(F.round(F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y")), 6).alias("jaccard"))


def shared_values(sets: DataFrame) -> DataFrame:
    """Values that all pages have."""
    total = sets.agg(F.countDistinct("page").alias("total"))
    return sets.groupBy("value").agg(F.countDistinct("page").alias("pages")).join(F.broadcast(total)).where("pages = total").select("value", "pages")


def unique_values(sets: DataFrame, n: int = 20) -> DataFrame:
    """Values that one page alone has, n of each page at most."""
    rows = sets.groupBy("value").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("page")).where("pages = 1")
    return top(rows.select("page", "value"), ["page"], n, F.asc("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keyed values (key, value) of two sides: only-a, only-b, changed or shared."""
    rows = a.select("key", F.col("value").alias("a_value"), F.lit(1).alias("in_a")).join(b.select("key", F.col("value").alias("b_value"), F.lit(1).alias("in_b")), "key", "full_outer")
    status = F.when(F.col("in_b").isNull(), "only-a").when(F.col("in_a").isNull(), "only-b").when(F.col("a_value").eqNullSafe(F.col("b_value")), "shared").otherwise("changed")
    return rows.select("key", "a_value", "b_value", status.alias("status"))


def reconcile_routes(tokens: DataFrame) -> DataFrame:
    """Tokens (route, token, value): shared if all routes have one value, changed if several values, added if one route alone has them."""
    total = tokens.agg(F.countDistinct("route").alias("total"))
    rows = tokens.groupBy("token").agg(F.countDistinct("route").alias("routes"), F.countDistinct("value").alias("values")).join(F.broadcast(total))
    status = F.when((F.col("values") == 1) & (F.col("routes") == F.col("total")), "shared").when(F.col("routes") == 1, "added").otherwise("changed")
    return rows.select("token", "routes", "values", status.alias("status"))


def brand_matrix(rows: DataFrame, brands: list[str]) -> DataFrame:
    """Properties by brand (property, brand, value): a column for each brand named."""
    return rows.groupBy("property").pivot("brand", brands).agg(F.round(F.sum("value"), 2))


#: Weights of the sub-scores.
WEIGHTS = {"color": 18, "typography": 18, "spacing": 18, "shadow": 9, "radius": 9, "accessibility": 15, "tokens": 5, "css": 8}


def _steps(name: str, last: int, *steps: tuple[int, int]) -> Column:
    """The score of the first step (most, score) that the count does not pass, ``last`` beyond all."""
    return F.coalesce(*(F.when(F.col(name) <= most, score) for most, score in steps), F.when(F.col(name).isNotNull(), last))


def system_score(usage: DataFrame) -> DataFrame:
    """Eight sub-scores, their weighted mean with halves up, and its grade. A sub-score that is null, as css without a stylesheet, leaves the weights.

    ``usage``: page_id; counts colors, families, weights, sizes, spacings, on_base (spacings that the base unit divides),
    shadows, radii, variables; whether there is a primary colour (has_primary) and a base unit (has_base); contrast, the
    score of pairs; unused (percent), important, duplicates of the stylesheet, null if there is none.
    """
    off = lambda name, *steps: F.coalesce(*(F.when(F.col(name) >= least, points) for least, points in steps), F.lit(0))
    color = _steps("colors", 35, (12, 100), (25, 92), (40, 80), (60, 65), (100, 50)) - F.when(F.col("has_primary"), 0).otherwise(15)
    kinds = F.least(_steps("families", 50, (2, 100), (3, 80)), _steps("weights", 100, (3, 100), (5, 90), (7, 80)))
    kinds = F.least(kinds - F.when(F.col("weights") > 7, 15).otherwise(0), _steps("sizes", 100, (8, 100), (14, 92), (20, 82)))
    share = F.col("on_base") / F.nullif("spacings", F.lit(0))
    based = F.when(F.col("has_base"), F.when(share >= 0.8, 100).when(share >= 0.6, 85).otherwise(75)).otherwise(F.when(F.col("variables") >= 20, 70).otherwise(55))
    css = 100 - off("unused", (70, 30), (50, 20), (30, 10)) - off("important", (20, 20), (5, 10), (1, 5)) - off("duplicates", (20, 15), (5, 8), (1, 3))
    parts = {
        "color": color,
        "typography": kinds - F.when(F.col("sizes") > 20, 10).otherwise(0),
        "spacing": based - off("spacings", (51, 15), (36, 5)),
        "shadow": _steps("shadows", 50, (0, 85), (5, 100), (10, 90), (18, 78), (28, 62)),
        "radius": _steps("radii", 45, (4, 100), (7, 90), (10, 80), (15, 65)),
        "accessibility": F.coalesce("contrast", F.lit(0)),
        "tokens": 20 + off("variables", (20, 80), (10, 55), (1, 30)),
        "css": F.when(F.coalesce("unused", "important", "duplicates").isNotNull(), F.greatest(css, F.lit(0))),
    }
    rows = usage.select("page_id", *(part.cast("int").alias(name) for name, part in parts.items()))
    total = sum((F.coalesce(F.greatest(F.col(name), F.lit(0)) * w, F.lit(0)) for name, w in WEIGHTS.items()), F.lit(0))
    weights = sum((F.when(F.col(name).isNotNull(), w).otherwise(0) for name, w in WEIGHTS.items()), F.lit(0))
    score = F.coalesce(T.half_up(total / F.nullif(weights, F.lit(0))), F.lit(0)).cast("int")
    grade = F.coalesce(*(F.when(score >= least, letter) for letter, least in (("A", 90), ("B", 80), ("C", 70), ("D", 60))), F.lit("F"))
    return rows.select("*", score.alias("score"), grade.alias("grade"))


def stagger(observations: DataFrame) -> DataFrame:
    """Per key of (key, delay): steps between sorted delays, their median, and the share of steps near it; tolerance max(20, half the median)."""
    line = Window.partitionBy("key").orderBy("delay")
    steps = observations.withColumn("step", F.col("delay") - F.lag("delay").over(line)).where("step > 0")
    median = steps.groupBy("key").agg(T.half_up(F.percentile("step", 0.5)).alias("median"))
    near = F.abs(F.col("step") - F.col("median")) <= F.greatest(F.lit(20.0), F.col("median") * 0.5)
    return steps.join(median, "key").groupBy("key", "median").agg(F.count("*").alias("steps"), F.count(F.when(near, 1)).alias("regular"))
