"""Thirty measurements of a page's design, none of them guessed, and the vector that they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T
from swatchwork.operators.vectors import normalise

#: Axis, measurement, and the bounds that become 0 and 1.
SPEC = [
    ("color", "chroma_mean", 0, 1),
    ("color", "chroma_max", 0, 1),
    ("color", "hue_count", 0, 6),
    ("color", "hue_spread", 0, 1),
    ("color", "neutral_temp", 0, 0.15),
    ("color", "surface_levels", 1, 6),
    ("color", "surface_lightness", 0, 1),
    ("color", "accent_delta", 0, 1),
    ("type", "scale_ratio", 1, 1.8),
    ("type", "scale_regularity", 0, 1),
    ("type", "display_contrast", 1, 6),
    ("type", "body_line_height", 1, 2),
    ("type", "weight_range", 0, 700),
    ("type", "family_count", 1, 4),
    ("space", "base_unit", 2, 16),
    ("space", "ramp_regularity", 0, 1),
    ("space", "scale_depth", 2, 12),
    ("space", "scale_spread", 1, 16),
    ("shape", "radius_median", 0, 32),
    ("shape", "radius_variance", 0, 16),
    ("shape", "pill_rate", 0, 1),
    ("shape", "border_weight", 0, 4),
    ("shape", "shadow_softness", 0, 1),
    ("shape", "elevation_levels", 1, 5),
    ("motion", "duration_median", 0, 800),
    ("motion", "duration_spread", 0, 800),
    ("motion", "springiness", 0, 1),
    ("motion", "ease_out_share", 0, 1),
    ("motion", "linear_share", 0, 1),
    ("motion", "scroll_linked", 0, 1),
]
AXES = ["color", "type", "space", "shape", "motion"]
VERSION = 1
#: Saturation from which a colour has a hue, radius from which a corner is a pill, springs that make a page all spring.
CHROMATIC, PILL, SPRINGS = 0.12, 100, 3

PROFILE = """page_id long, colors array<string>, primary string, secondary string, accent string, backgrounds array<string>, neutrals array<string>,
    scale array<struct<size:double,line_height:string>>, body struct<size:double,line_height:string>, weights array<string>, families array<string>,
    spacing array<double>, base double, radii array<double>, widths array<double>, shadows array<struct<x:double,y:double,blur:double,weight:double,label:string,inset:boolean>>,
    durations array<double>, easings array<struct<family:string,count:long>>, springs array<string>, scroll_linked boolean"""


def _some(values: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an array that holds something, or else null, as least and greatest pass over nulls."""
    return F.when(F.size(values) > 0, use(values))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    at = lambda k: F.get(ordered, k.cast("int"))
    half = F.floor(F.size(values) / 2)
    return F.when(F.size(values) % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)


def _deviation(values: Column) -> Column:
    """Of a population; 0 for fewer than two."""
    mean = _mean(values)
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(T.bound(F.struct(values.alias("v"), mean.alias("m")), lambda s: F.sqrt(_mean(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"]))))))


def _present(values: Column) -> Column:
    return F.array_compact(F.coalesce(values, F.array().cast("array<double>")))


def _hsl(hexes: Column) -> Column:
    """Structs of h (degrees), s and l (0 to 1) of those texts of an array that are colours."""

    def exact(c: Column) -> Column:
        r, g, b = (c[k] / 255.0 for k in "rgb")
        top, low = F.greatest(r, g, b), F.least(r, g, b)
        light, d = (top + low) / 2, top - low
        s = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
        h = F.when(d == 0, 0.0).when(top == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
        return F.struct((h * 60).alias("h"), s.alias("s"), light.alias("l"))

    read = F.transform(F.coalesce(hexes, F.array().cast("array<string>")), lambda x: T.bound(C.parse_color(x), lambda c: F.when(c.isNotNull(), exact(c))))
    return F.array_compact(read)


def _ratio(line_height: Column, size: Column) -> Column:
    """A line height as a share of the size: a length by the size, a bare number as it is, anything else null."""
    n = T.number(line_height)
    return F.when(n > 0, F.when(F.trim(line_height).rlike("px$"), F.when(size > 0, n / size)).otherwise(n))


def raw_features(profiles: DataFrame) -> DataFrame:
    """The measurements of SPEC for each row of ``profiles`` (PROFILE): page_id and a column of doubles for each, null where nothing was found to measure."""
    # arrays that several measurements read, made once
    rows = profiles.select(
        "page_id", _hsl(F.col("colors")).alias("all"), *(_hsl(F.array(c)).alias(c) for c in ("primary", "secondary", "accent")), _hsl(F.col("backgrounds")).alias("backs"), _hsl(F.col("neutrals")).alias("grey"),
        F.filter(F.coalesce("scale", F.array().cast("array<struct<size:double,line_height:string>>")), lambda s: s["size"] > 0).alias("scale"), "body", "families",
        F.array_compact(F.transform(F.coalesce("weights", F.array().cast("array<string>")), lambda w: w.try_cast("double"))).alias("weights"),
        F.filter(_present(F.col("spacing")), lambda v: v > 0).alias("spacing"), F.when(F.col("base") > 0, F.col("base")).alias("base"),
        _present(F.col("radii")).alias("radii"), _present(F.col("widths")).alias("widths"),
        F.filter(F.coalesce("shadows", F.array().cast("array<struct<x:double,y:double,blur:double,weight:double,label:string,inset:boolean>>")), lambda s: s.isNotNull() & ~F.coalesce(s["inset"], F.lit(False))).alias("shadows"),
        F.filter(_present(F.col("durations")), lambda v: v > 0).alias("durations"), "easings", "springs", "scroll_linked",
    )
    rows = rows.withColumn("named", F.concat("primary", "secondary", "accent")).withColumn("pool", F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("named")))
    rows = rows.withColumn("hued", F.filter("pool", lambda x: x["s"] > CHROMATIC)).withColumn("sizes", F.array_sort(F.array_distinct(F.transform("scale", lambda s: s["size"]))))
    steps = F.transform(F.sequence(F.lit(1), F.size("sizes") - 1), lambda k: F.get("sizes", k) / F.get("sizes", k - 1))
    rows = rows.withColumn("steps", F.when(F.size("sizes") >= 3, steps)).withColumn("ratio", _median(F.col("steps"))).withColumn("corners", F.filter("radii", lambda v: v < PILL))
    rows = rows.withColumn("heights", F.array_compact(F.transform("scale", lambda s: _ratio(s["line_height"], s["size"]))))
    rows = rows.withColumn("uses", F.aggregate(F.coalesce("easings", F.array().cast("array<struct<family:string,count:long>>")), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["count"], F.lit(0))))
    of = lambda name, part: F.transform(name, lambda x: x[part])
    turned = lambda f: _mean(F.transform("hued", lambda x: f(F.radians(x["h"]))))
    first = F.get("named", F.lit(0))
    surface = _some(of("backs", "l"), _mean)
    body = F.coalesce(F.col("body.size"), _some(F.col("sizes"), _median))
    weight = lambda s: F.when(s["weight"] > 0, s["weight"]).otherwise(F.sqrt(F.coalesce(s["x"], F.lit(0.0)) ** 2 + F.coalesce(s["y"], F.lit(0.0)) ** 2) + F.coalesce(s["blur"], F.lit(0.0)))
    soft = lambda s: F.when(weight(s) > 0, F.coalesce(s["blur"], F.lit(0.0)) / weight(s)).otherwise(0.0)
    level = lambda s: F.coalesce(F.nullif(s["label"], F.lit("")), T.half_up(F.coalesce(s["weight"], F.lit(0.0))).cast("string"))
    share = lambda family: F.when(F.size("easings") > 0, F.coalesce(F.aggregate(F.filter("easings", lambda e: e["family"] == family), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["count"], F.lit(0))) / F.nullif("uses", F.lit(0)), F.lit(0.0)))
    on_base = F.filter("spacing", lambda v: F.abs(v / F.col("base") - T.half_up(v / F.col("base"))) < 0.01)
    found = {
        "chroma_mean": _some(F.col("pool"), lambda _: F.coalesce(_some(of("hued", "s"), _mean), F.lit(0.0))),
        "chroma_max": _some(F.col("pool"), lambda _: F.greatest(F.lit(0.0), F.array_max(of("pool", "s")))),
        "hue_count": _some(F.col("pool"), lambda _: F.size(F.array_distinct(F.transform("hued", lambda x: F.floor(x["h"] / 30) % 12)))),
        "hue_spread": F.when(F.size("hued") == 1, 0.0).when(F.size("hued") > 1, 1 - F.sqrt(turned(F.cos) ** 2 + turned(F.sin) ** 2)),
        "neutral_temp": _some(of("grey", "s"), _mean),
        "surface_levels": _some(F.col("backs"), lambda _: F.size(F.array_distinct(F.transform("backs", lambda x: T.half_up(x["l"] * 20))))),
        "surface_lightness": surface,
        "accent_delta": F.abs(first["l"] - surface),
        "scale_ratio": F.col("ratio"),
        "scale_regularity": _some(F.col("steps"), lambda v: 1 - F.least(F.lit(1.0), _mean(F.transform(v, lambda s: F.abs(s - F.col("ratio")) / F.col("ratio"))))),
        "display_contrast": _some(F.col("sizes"), lambda _: F.when(body > 0, F.array_max("sizes") / body)),
        "body_line_height": F.coalesce(_ratio(F.col("body.line_height"), F.col("body.size")), _some(F.col("heights"), _median)),
        "weight_range": _some(F.col("weights"), lambda w: F.array_max(w) - F.array_min(w)),
        "family_count": F.nullif(F.size("families"), F.lit(0)),
        "base_unit": F.col("base"),
        "ramp_regularity": _some(F.col("spacing"), lambda s: F.when(F.col("base").isNotNull(), F.size(on_base) / F.size(s))),
        "scale_depth": F.nullif(F.size("spacing"), F.lit(0)),
        "scale_spread": _some(F.col("spacing"), lambda s: F.array_max(s) / F.col("base")),
        "radius_median": F.coalesce(_some(F.col("corners"), _median), _some(F.col("radii"), lambda _: F.lit(0.0))),
        "radius_variance": F.coalesce(_some(F.col("corners"), _deviation), _some(F.col("radii"), lambda _: F.lit(0.0))),
        "pill_rate": _some(F.col("radii"), lambda r: F.size(F.filter(r, lambda v: v >= PILL)) / F.size(r)),
        "border_weight": _some(F.col("widths"), _mean),
        "shadow_softness": _some(F.transform("shadows", soft), _mean),
        "elevation_levels": _some(F.col("shadows"), lambda s: F.size(F.array_distinct(F.transform(s, level)))),
        "duration_median": _some(F.col("durations"), _median),
        "duration_spread": _some(F.col("durations"), lambda d: F.array_max(d) - F.array_min(d)),
        "springiness": F.when(F.col("springs").isNotNull(), F.least(F.lit(1.0), F.size("springs") / SPRINGS)),
        "ease_out_share": share("ease-out"),
        "linear_share": share("linear"),
        "scroll_linked": F.col("scroll_linked").cast("int"),
    }
    return rows.select("page_id", *(found[name].cast("double").alias(name) for _, name, *_ in SPEC))


def design_vectors(raw: DataFrame) -> DataFrame:
    """(page_id, version, vector, coverage) of ``raw_features`` rows: each measurement within its bounds as 0 to 1, null where it is missing, and the share that is there."""
    vector = F.array(*(normalise(F.col(name), low, high) for _, name, low, high in SPEC))
    rows = raw.select("page_id", F.lit(VERSION).alias("version"), vector.alias("vector"))
    return rows.withColumn("coverage", F.size(F.array_compact("vector")) / len(SPEC))


def axis_of(feature: Column) -> Column:
    """The axis of a place in the vector."""
    return F.element_at(F.array(*(F.lit(axis) for axis, *_ in SPEC)), feature + 1)


def _apart(a: Column, b: Column, places: list[int]) -> tuple[Column, Column]:
    """Mean absolute difference over the places where both have something, null without any, and how many these are."""
    pick = lambda v: F.transform(F.array(*map(F.lit, places)), lambda k: F.get(v, k))
    d = F.array_compact(F.zip_with(pick(a), pick(b), lambda x, y: F.abs(x - y)))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(d), F.lit(0)), F.size(d)


def design_distances(pairs: DataFrame) -> DataFrame:
    """Pairs (..., a, b of vectors) with distance and compared, over all and by axis: columns distance, compared, and <axis>, <axis>_compared."""
    out = {}
    for axis in (None, *AXES):
        places = [k for k, (own, *_) in enumerate(SPEC) if axis in (None, own)]
        out[axis or "distance"], out[f"{axis}_compared" if axis else "compared"] = _apart(F.col("a"), F.col("b"), places)
    return pairs.select(*(c for c in pairs.columns if c not in ("a", "b")), *(value.alias(name) for name, value in out.items()))


def axis_percentiles(ranks: DataFrame) -> DataFrame:
    """(id, axis, percentile, features): the mean of an id's percentiles (id, feature, percentile) on each axis, over those that there are."""
    return ranks.groupBy("id", axis_of(F.col("feature")).alias("axis")).agg(F.avg("percentile").alias("percentile"), F.count("*").alias("features"))
