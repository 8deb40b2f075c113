"""How near a rebuilt page comes to its original: by motion, by bands, together, and what to mend first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T

MOTION = "struct<feel:string,durations:array<double>,easings:array<struct<family:string,count:long>>,springs:long,kinds:array<string>,scroll_linked:boolean,staggers:array<double>>"
#: Weights of the aspects of motion, in order; feelings that are near each other; what is left for motion that only the rebuilt page has.
WEIGHTS = {"feel": 2.0, "durations": 2.0, "easings": 2.0, "springs": 1.5, "keyframes": 1.5, "scroll_linked": 1.0, "choreography": 1.0}
NEIGHBOURS = {"springy": ["responsive"], "responsive": ["springy", "smooth"], "smooth": ["responsive", "mechanical"], "mechanical": ["smooth"], "mixed": ["responsive", "smooth"]}
INVENTED_TIMING, INVENTED = 0.7, 0.6
#: Checks of a band, tolerances of backgrounds (OKLab) and heights (share), score below which an aspect is mended, gains of high and medium priority.
CHECKS, COLOR_NEAR, HEIGHT_NEAR, MEND, HIGH, MEDIUM = 5, 0.08, 0.15, 0.75, 6, 3


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bound2(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    return T.bound(F.struct(a.alias("a"), b.alias("b")), lambda s: use(s["a"], s["b"]))


def _closeness(a: Column, b: Column) -> Column:
    """Mean closeness of the original's durations to the nearest of the rebuilt page's; a quarter, 40 ms at least, is a match in full at no distance and none at four times that."""
    off = lambda ms: F.array_min(F.transform(b, lambda x: F.abs(x - ms)))
    each = F.transform(a, lambda ms: F.greatest(F.lit(0.0), 1 - off(ms) / (F.greatest(F.lit(40.0), ms * 0.25) * 4)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) == 0, INVENTED_TIMING).when(F.size(b) == 0, 0.0).otherwise(_sum(each) / F.size(a))


def _alike(a: Column, b: Column) -> Column:
    """One less half of the distance between two distributions of (family, count)."""
    uses = lambda x: F.coalesce(F.nullif(x["count"], F.lit(0)), F.lit(1)).cast("double")
    share = lambda v, name: _sum(F.transform(F.filter(v, lambda x: x["family"] == name), uses)) / F.greatest(_sum(F.transform(v, uses)), F.lit(1.0))
    names = F.array_union(F.transform(a, lambda x: x["family"]), F.transform(b, lambda x: x["family"]))
    return F.when(F.size(names) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - _sum(F.transform(names, lambda n: F.abs(share(a, n) - share(b, n)))) / 2))


def _overlap(a: Column, b: Column) -> Column:
    """Shared over all of two bags of texts; 1 for two empty ones."""
    many = lambda v, name: F.size(F.filter(v, lambda x: x == name))
    names = F.array_union(a, b)
    total = lambda f: _sum(F.transform(names, lambda n: f(many(a, n), many(b, n)).cast("double")))
    return F.when(F.size(names) == 0, 1.0).otherwise(total(F.least) / total(F.greatest))


def _parity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(a, 0.0).otherwise(INVENTED)


def motion_fidelity(pairs: DataFrame) -> DataFrame:
    """(id, score, aspects) of (id, original, rebuilt), both of MOTION: aspects are (aspect, score from 0 to 1, weight); the score is their weighted mean in percent, halves up.

    Nulls mean that there is nothing of the kind; a null motion has none at all. A feeling that is missing counts as mixed
    where there are durations or easings. ``kinds`` are those of the keyframes that play.
    """
    rows = pairs.select("id", *(F.col(c).cast(MOTION).alias(c[0]) for c in ("original", "rebuilt")))
    of = lambda side, name, kind: _list(F.col(f"{side}.{name}"), kind)
    easing = "struct<family:string,count:long>"
    feel = lambda s: F.coalesce(F.nullif(F.col(f"{s}.feel"), F.lit("")), F.when((F.size(of(s, "durations", "double")) > 0) | (F.size(of(s, "easings", easing)) > 0), "mixed"))
    near = F.create_map(*(x for name, others in NEIGHBOURS.items() for x in (F.lit(name), F.array(*map(F.lit, others)))))
    felt = lambda a, b: F.when(a.eqNullSafe(b), 1.0).when(F.coalesce(F.array_contains(F.try_element_at(near, a), b), F.lit(False)), 0.5).otherwise(0.0)
    timed = lambda s: F.filter(of(s, "durations", "double"), lambda x: x > 0)
    has = lambda s, c: F.coalesce(c(s), F.lit(False))
    steps = lambda s: of(s, "staggers", "double")
    first = lambda s: F.coalesce(F.get(steps(s), F.lit(0)), F.lit(0.0))
    staggered = F.greatest(F.lit(0.0), 1 - F.abs(first("o") - first("r")) / (F.greatest(F.lit(20.0), first("o") * 0.4) * 4))
    many = [F.size(steps(s)) > 0 for s in "or"]
    scores = {
        "feel": _bound2(feel("o"), feel("r"), felt),
        "durations": _bound2(timed("o"), timed("r"), _closeness),
        "easings": _bound2(of("o", "easings", easing), of("r", "easings", easing), _alike),
        "springs": _parity(*(has(s, lambda s: F.col(f"{s}.springs") > 0) for s in "or")),
        "keyframes": _bound2(of("o", "kinds", "string"), of("r", "kinds", "string"), _overlap),
        "scroll_linked": _parity(*(has(s, lambda s: F.col(f"{s}.scroll_linked")) for s in "or")),
        "choreography": F.when(many[0] & many[1], staggered).otherwise(_parity(*many)),
    }
    aspects = F.array(*(F.struct(F.lit(name).alias("aspect"), scores[name].alias("score"), F.lit(weight).alias("weight")) for name, weight in WEIGHTS.items()))
    rows = rows.select("id", aspects.alias("aspects"))
    total = _sum(F.transform("aspects", lambda x: x["score"] * x["weight"])) / sum(WEIGHTS.values())
    return rows.select("id", T.half_up(F.round(total * 100, 9)).cast("int").alias("score"), "aspects")


BANDS = "id long, place int, overlay boolean, role string, color string, image string, video boolean, columns int, media string, h double"


def band_pairs(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(id, i, o, r, role, background, columns, media, height): bands (BANDS) of both sides that are no overlays, by their turn; what a side has more stands alone, without checks."""
    names = [x.split()[0] for x in BANDS.split(", ")]

    def turned(bands: DataFrame, side: str) -> DataFrame:
        rows = bands.where(~F.coalesce("overlay", F.lit(False)))
        return rows.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1).alias("i"), F.struct(*names[1:]).alias(side))

    rows = turned(original, "o").join(turned(rebuilt, "r"), ["id", "i"], "full_outer")
    a, b = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"r.{c}"))
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")).isNotNull(), F.lit(False))
    no = F.lit(False)
    lab = lambda c: T.bound(C.parse_color(c), C.to_oklab)
    near = F.coalesce(_bound2(lab(a("color")), lab(b("color")), C.space_distance) <= COLOR_NEAR, no)
    either = lambda f: f(a) | f(b)
    both = lambda f: f(a) & f(b)
    video, image = (lambda s: F.coalesce(s("video"), no)), (lambda s: some(s("image")))
    background = F.when(either(video), both(video)).when(either(image), both(image)).when(~(some(a("color")) & some(b("color"))), ~(some(a("color")) | some(b("color")))).otherwise(near)
    tall = F.greatest(F.coalesce(a("h"), F.lit(0.0)), F.coalesce(b("h"), F.lit(0.0)))
    height = (tall == 0) | (F.abs(F.coalesce(a("h"), F.lit(0.0)) - F.coalesce(b("h"), F.lit(0.0))) / F.nullif(tall, F.lit(0.0)) <= HEIGHT_NEAR)
    count = lambda s: F.coalesce(F.nullif(s("columns"), F.lit(0)), F.lit(1))
    kind = lambda s: F.coalesce(F.nullif(s("media"), F.lit("")), F.lit("none"))
    checks = {"role": a("role").eqNullSafe(b("role")), "background": background, "columns": count(a) == count(b), "media": kind(a) == kind(b), "height": height}
    met = F.col("o").isNotNull() & F.col("r").isNotNull()
    return rows.select("id", "i", "o", "r", *(F.when(met, check).alias(name) for name, check in checks.items()))


def blueprint_fidelity(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(id, score, matched, total, aligned, unmatched, drift) of bands (BANDS) of both sides: a band that only one side has fails all its checks."""
    pairs = band_pairs(original, rebuilt)
    hits = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("role", "background", "columns", "media", "height")), F.lit(0))
    aligned = F.count(F.when(F.col("role").isNotNull(), 1))
    rows = pairs.groupBy("id").agg(F.sum(hits).alias("matched"), (F.count("*") * CHECKS).alias("total"), aligned.alias("aligned"), (F.count("*") - aligned).alias("unmatched"))
    return rows.select("id", T.half_up(100 * F.col("matched") / F.col("total")).cast("int").alias("score"), "matched", "total", "aligned", "unmatched", (F.col("unmatched") > 0).alias("drift"))


#: What either side weighs in the whole.
VISUAL, MOVING = 0.6, 0.4


def combined(scores: DataFrame) -> DataFrame:
    """(id, visual, motion, overall, grade) of (id, visual, motion): the weighted mean, halves up, or what there is of the two."""
    both = F.when(F.col("visual").isNotNull() & F.col("motion").isNotNull(), T.half_up(F.round((F.col("visual") * VISUAL + F.col("motion") * MOVING) / (VISUAL + MOVING), 9)))
    rows = scores.withColumn("overall", F.coalesce(both, F.col("visual").cast("double"), F.col("motion").cast("double")).cast("int"))
    grade = F.coalesce(*(F.when(F.col("overall") >= least, letter) for letter, least in (("A", 90), ("B", 80), ("C", 70), ("D", 60))), F.when(F.col("overall").isNotNull(), "F"), F.lit("unknown"))
    return rows.select("id", "visual", "motion", "overall", grade.alias("grade"))


def correction_plan(scored: DataFrame, mend: float = MEND) -> DataFrame:
    """(id, rank, aspect, gain, priority) of ``motion_fidelity`` rows: aspects that score below ``mend``, by what mending them gains (two decimals), then in their order."""
    rows = scored.select("id", F.posexplode("aspects").alias("at", "x")).where(F.col("x.score") < mend)
    gain = F.round(F.round(F.col("x.weight") * (1 - F.col("x.score")), 9), 2)
    rows = rows.select("id", "at", F.col("x.aspect").alias("aspect"), gain.alias("gain"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("gain"), "at"))
    return rows.select("id", rank.alias("rank"), "aspect", "gain", F.when(F.col("gain") >= HIGH, "high").when(F.col("gain") >= MEDIUM, "medium").otherwise("low").alias("priority"))
