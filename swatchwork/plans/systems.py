"""Queries over whole systems: short palettes, ramps, the tokens that a site's pages share, and its grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchwork.functions import csstext as T
from swatchwork.operators import components, features, palettes, synthesis, tokendoc, usage, vectors
from swatchwork.plans.readers import _expressions
from swatchwork.plans.catalog import _ACTS, _SPACING, _USES, BG, E_, FG, PX, query
from swatchwork.sources import elements, stylesheets
from swatchwork.sources.storage import stored

_LIN = "(CASE WHEN ({0}) / 255.0::DOUBLE <= 0.04045 THEN ({0}) / 255.0::DOUBLE / 12.92 ELSE pow((({0}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
_BYTE = "('0x' || {0}[{1}:{2}])::INT"


def _rgb(hex_: str) -> str:
    return ", ".join(f"{_LIN.format(_BYTE.format(hex_, k, k + 1))} AS l{c}" for k, c in ((2, "r"), (4, "g"), (6, "b")))


_DOT = lambda m: " + ".join(f"{w}::DOUBLE * l{c}" for w, c in zip(m, "rgb", strict=True))
_OK = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_TO = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab_sql(rows: str, key: str) -> str:
    """``rows`` with ol, oa, ob of the colour ``key``, as a table expression."""
    cones = ", ".join(f"cbrt({_DOT(m)}) AS c{n}" for m, n in zip(_OK, "lms", strict=True))
    axes = ", ".join(" + ".join(f"{w}::DOUBLE * c{n}" for w, n in zip(m, "lms", strict=True)) + f" AS o{c}" for m, c in zip(_TO, "lab", strict=True))
    return f"(SELECT * EXCLUDE (lr, lg, lb, cl, cm, cs), {axes} FROM (SELECT *, {cones} FROM (SELECT *, {_rgb(key)} FROM {rows})))"


# --- palettes ----------------------------------------------------------------------------------------------------------
_K = 12
_XYZ = [f"({_DOT(m)}) / {w}::DOUBLE" for m, w in zip(((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)), (0.95047, 1.0, 1.08883), strict=True)]
_F = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END)"
_D2 = lambda x, y: f"((pow({x}.l - {y}.l, 2) + pow({x}.a - {y}.a, 2)) + pow({x}.b - {y}.b, 2))"
_MEAN = lambda c: f"list_sum(list_transform(list_filter(own, lambda q: q.j = n), lambda q: q.{c} * q.u)) / list_sum(list_transform(list_filter(own, lambda q: q.j = n), lambda q: q.u))"
PALETTE_SQL = f"""WITH RECURSIVE {E_}, {_USES}, h AS (SELECT page_id, hex, count(*)::DOUBLE AS u, min(ord * 2 + (context = 'background')::INT) AS place FROM uses GROUP BY ALL),
  x AS (SELECT *, {", ".join(f"{v} AS x{k}" for k, v in enumerate(_XYZ))} FROM (SELECT *, {_rgb("hex")} FROM h)), f AS (SELECT *, {", ".join(f"{_F(f'x{k}')} AS f{k}" for k in range(3))} FROM x),
  p AS (SELECT page_id, list({{'hex': hex, 'u': u, 'l': 116 * f1 - 16, 'a': 500 * (f0 - f1), 'b': 200 * (f1 - f2)}} ORDER BY place, hex) AS pts FROM f GROUP BY page_id),
  s AS (SELECT page_id, pts, [pts[list_position(list_transform(pts, lambda y: y.u), list_max(list_transform(pts, lambda y: y.u)))]] AS cs FROM p WHERE len(pts) > {_K}
    UNION ALL SELECT page_id, pts, list_concat(cs, [pts[list_position(far, list_max(far))]]) FROM (SELECT *, list_transform(pts, lambda y: list_min(list_transform(cs, lambda c: {_D2("y", "c")})) * ln(1 + y.u)) AS far FROM s WHERE len(cs) < {_K})),
  k AS (SELECT page_id, pts, list_transform(cs, lambda c: {{'l': c.l, 'a': c.a, 'b': c.b}}) AS cs, 0 AS it, list_transform(pts, lambda y: {{'hex': y.hex, 'u': y.u, 'l': y.l, 'a': y.a, 'b': y.b, 'j': 0}}) AS own, 1e9 AS moved FROM s WHERE len(cs) = {_K}
    UNION ALL SELECT page_id, pts, new, it + 1, own, list_sum(list_transform(range(1, {_K + 1}), lambda n: {_D2("new[n]", "cs[n]")})) FROM (
      SELECT *, list_transform(range(1, {_K + 1}), lambda n: CASE WHEN len(list_filter(own, lambda q: q.j = n)) = 0 THEN cs[n] ELSE {{'l': {_MEAN("l")}, 'a': {_MEAN("a")}, 'b': {_MEAN("b")}}} END) AS new FROM (
        SELECT page_id, pts, cs, it, moved, list_transform(pts, lambda y: {{'hex': y.hex, 'u': y.u, 'l': y.l, 'a': y.a, 'b': y.b,
          'j': list_position(list_transform(cs, lambda c: {_D2("y", "c")}), list_min(list_transform(cs, lambda c: {_D2("y", "c")})))}}) AS own FROM k WHERE it < {palettes.ROUNDS} AND moved >= {palettes.STILL}))),
  l AS (SELECT page_id, cs, own FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY it DESC) = 1),
  m AS (SELECT page_id, q.hex AS hex, q.u AS u, q.j AS j, place, round({_D2("q", "cs[q.j]")}, 9) AS off FROM (SELECT page_id, cs, unnest(own) AS q, generate_subscripts(own, 1) AS place FROM l)),
  c AS (SELECT page_id, j, arg_min(hex, (off, place)) AS hex, sum(u)::BIGINT AS uses, count(*)::INT AS members, string_agg(hex, ',' ORDER BY place) AS hexes FROM m GROUP BY page_id, j)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, j)::INT AS rank, hex, uses, members, hexes FROM c
UNION ALL SELECT page_id, place::INT, y.hex, y.u::BIGINT, 1, y.hex FROM (SELECT page_id, unnest(pts) AS y, generate_subscripts(pts, 1) AS place FROM p WHERE len(pts) <= {_K})"""


@query("palette_kmeans", PALETTE_SQL)
def palette_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = usage.color_usage(elements.from_lineitem(spark, sf_dir)).select("page_id", "hex", "uses", F.col("first_place").alias("place"))
    return palettes.compressed_palettes(used, _K).withColumn("hexes", F.array_join("hexes", ","))


_STEPS = ", ".join(f"({i}, '{n}', {v}::DOUBLE, {max(palettes.LEAST_CHROMA, 1 - (abs(v - palettes.PEAK) / palettes.PEAK) ** palettes.FALL)!r}::DOUBLE)" for i, (n, v) in enumerate(palettes.STEPS.items()))
_ENC = lambda x: f"printf('%02x', floor((CASE WHEN {x} <= 0.0031308 THEN 12.92 * least(greatest({x}, 0), 1) ELSE 1.055 * pow(least(greatest({x}, 0), 1), 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5)::INT)"
RAMP_SQL = f"""WITH {E_}, {_USES}, st AS (SELECT * FROM (VALUES {_STEPS}) t(i, step, light, share)), h AS (SELECT DISTINCT hex AS base FROM uses),
  o AS (SELECT base, ol, sqrt(oa * oa + ob * ob) AS c, CASE WHEN degrees(atan2(ob, oa)) < 0 THEN degrees(atan2(ob, oa)) + 360 ELSE degrees(atan2(ob, oa)) END AS hue FROM {oklab_sql("h", "base")}),
  a AS (SELECT base, arg_min(step, (abs(light - ol), i)) AS anchor FROM o, st GROUP BY base),
  x AS (SELECT o.base, anchor, hue, c, step, light AS l, greatest(0, c * share) * cos(radians(hue)) AS a, greatest(0, c * share) * sin(radians(hue)) AS b FROM o JOIN a USING (base), st),
  y AS (SELECT *, pow(l + 0.3963377774::DOUBLE * a + 0.2158037573::DOUBLE * b, 3) AS cl, pow(l - 0.1055613458::DOUBLE * a - 0.0638541728::DOUBLE * b, 3) AS cm, pow(l - 0.0894841775::DOUBLE * a - 1.2914855480::DOUBLE * b, 3) AS cs FROM x),
  z AS (SELECT *, 4.0767416621::DOUBLE * cl - 3.3077115913::DOUBLE * cm + 0.2309699292::DOUBLE * cs AS r, -1.2684380046::DOUBLE * cl + 2.6097574011::DOUBLE * cm - 0.3413193965::DOUBLE * cs AS g, -0.0041960863::DOUBLE * cl - 0.7034186147::DOUBLE * cm + 1.7076147010::DOUBLE * cs AS bb FROM y)
SELECT base, anchor, floor(hue + 0.5)::INT AS hue, floor(c * 1000 + 0.5) / 1000 AS chroma, step, CASE WHEN step = anchor THEN base ELSE '#' || {_ENC("r")} || {_ENC("g")} || {_ENC("bb")} END AS hex FROM z"""
query("tonal_ramps", RAMP_SQL)(lambda s, d: palettes.tonal_ramps(usage.distinct_colors(elements.from_lineitem(s, d))))

# --- site synthesis ----------------------------------------------------------------------------------------------------
#: Names of a site's ten pages: those of one kind share theirs.
KINDS = ["home", "docs", "blog", "blog", "pricing", "about", "docs", "legal", "team", "jobs"]


def site_uses(e: DataFrame) -> DataFrame:
    """What the pages of each site use, by category, for ``synthesis.canonical``; the place is the page's and the key's rank in it."""
    rows = synthesis.page_uses(e)
    place = F.row_number().over(Window.partitionBy("page_id", "category").orderBy("turn", "key"))
    page = F.col("page_id") % elements.SITE
    return rows.select(F.floor(F.col("page_id") / elements.SITE).alias("site"), "category", "key", "value", _kind().alias("page"), "uses", (page * (1 << 32) + place).alias("place"))


def _kind() -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % len(KINDS) + 1).cast("int"))


def site_pages(e: DataFrame) -> DataFrame:
    return e.select("page_id").distinct().groupBy(F.floor(F.col("page_id") / elements.SITE).alias("site"), _kind().alias("page")).agg(F.count("*").alias("n"))


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = elements.from_lineitem(spark, sf_dir)
    return synthesis.canonical(site_uses(e), site_pages(e)), site_pages(e)


_SHADOW = "'0px ' || shadow_y || 'px ' || shadow_y * 4 || 'px rgba(0, 0, 0, 0.2)'"
_INT = lambda c: f"({PX.format(c)})::INT::VARCHAR"
_SITE = elements.SITE
CANONICAL_SQL = f"""WITH RECURSIVE {E_}, {_USES}, {_SPACING}, cu AS (SELECT page_id, hex, count(*) AS uses, count(*) FILTER (context = 'background' AND {_ACTS}) AS acts, min(ord * 2 + (context = 'background')::INT) AS place FROM uses GROUP BY ALL),
  parts AS (SELECT 'colors' AS category, page_id, hex AS key, hex AS value, uses, place AS turn FROM cu
    UNION ALL SELECT 'backgrounds', page_id, {BG} AS h, h, 1, min(ord) FROM elements WHERE area > 50000 GROUP BY ALL
    UNION ALL SELECT 'text', page_id, h, h, 1, rank FROM (SELECT page_id, {FG} AS h, row_number() OVER (PARTITION BY page_id ORDER BY min(ord)) AS rank FROM elements GROUP BY 1, 2) WHERE rank <= 10
    UNION ALL SELECT 'primary', page_id, hex, hex, acts, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY acts DESC, place) AS k FROM cu WHERE acts > 0) WHERE k = 1
    UNION ALL SELECT 'typography', page_id, lower(trim(split_part(font_family, ',', 1))), trim(split_part(font_family, ',', 1)), count(*), min(ord) FROM elements WHERE split_part(font_family, ',', 1) <> 'system-ui' GROUP BY ALL
    UNION ALL SELECT 'typeScale', page_id, {_INT("font_size")}, arg_min(font_weight, ord), count(*), ({PX.format("font_size")})::BIGINT FROM elements GROUP BY page_id, font_size
    UNION ALL SELECT 'spacing', page_id, value::VARCHAR, value::VARCHAR, 1, value FROM v
    UNION ALL SELECT 'borders', page_id, {_INT("radius")}, {_INT("radius")}, count(*), ({PX.format("radius")})::BIGINT FROM elements WHERE radius <> '0px' GROUP BY page_id, radius
    UNION ALL SELECT 'shadows', page_id, {_SHADOW}, CASE WHEN shadow_y = 0 THEN 'flat' WHEN shadow_y * 4 <= 4 THEN 'low' WHEN shadow_y * 4 <= 12 THEN 'mid' ELSE 'high' END, 1, shadow_y * 4 FROM elements WHERE shadow_y IS NOT NULL GROUP BY page_id, shadow_y),
  su AS (SELECT page_id // {_SITE} AS site, category, key, value, {KINDS}[page_id % {_SITE} + 1] AS page, uses, (page_id % {_SITE}) * {1 << 32} + row_number() OVER (PARTITION BY page_id, category ORDER BY turn, key) AS place FROM parts),
  tot AS (SELECT site, count(*) AS total FROM (SELECT DISTINCT page_id // {_SITE} AS site, page_id FROM elements) GROUP BY site),
  tl AS (SELECT site, category, key, arg_max(value, (uses, -place)) AS value, count(DISTINCT page) AS pages, sum(uses)::BIGINT AS uses, min(place) AS place, any_value(total) AS total FROM su JOIN tot USING (site) GROUP BY site, category, key),
  r AS (SELECT site, category, key, uses, ol AS l, oa AS a, ob AS b, row_number() OVER (PARTITION BY site, category ORDER BY floor(pages / total * 100 + 0.5) DESC, uses DESC, place, key) AS i FROM {oklab_sql("(SELECT * FROM tl WHERE category IN ('colors', 'backgrounds', 'text', 'primary'))", "key")}),
  g AS (SELECT site, category, i, key, 1::BIGINT AS hit, [{{'u': uses, 'l': l, 'a': a, 'b': b}}] AS cs FROM r WHERE i = 1
    UNION ALL SELECT site, category, i, key, hit, CASE WHEN hit > len(cs) THEN list_concat(cs, [x]) WHEN x.u > cs[hit].u THEN list_concat(list_concat(cs[:hit - 1], [x]), cs[hit + 1:]) ELSE cs END FROM (
      SELECT r.site, r.category, r.i, r.key, g.cs, {{'u': r.uses, 'l': r.l, 'a': r.a, 'b': r.b}} AS x,
        coalesce(list_position(list_transform(g.cs, lambda c: sqrt(pow(c.l - r.l, 2) + pow(c.a - r.a, 2) + pow(c.b - r.b, 2)) <= {synthesis.NEAR}::DOUBLE), true), len(g.cs) + 1) AS hit FROM g JOIN r ON r.site = g.site AND r.category = g.category AND r.i = g.i + 1)),
  ld AS (SELECT g.site, g.category, g.hit, arg_max(g.key, (r.uses, -g.i)) AS lead FROM g JOIN r ON r.site = g.site AND r.category = g.category AND r.i = g.i GROUP BY ALL),
  mc AS (SELECT site, category, key, (hit - 1)::INT AS cluster, lead FROM g JOIN ld USING (site, category, hit)),
  gr AS (SELECT site, category, cluster, lead AS key, count(DISTINCT page) AS pages, sum(uses)::BIGINT AS uses, count(DISTINCT key) AS merged FROM su JOIN mc USING (site, category, key) GROUP BY ALL),
  al AS (SELECT site, category, key, tl.value, gr.pages, gr.uses, merged, total, cluster::BIGINT AS turn FROM gr JOIN tl USING (site, category, key)
    UNION ALL SELECT site, category, key, value, pages, uses, 1, total, place FROM tl WHERE category NOT IN ('colors', 'backgrounds', 'text', 'primary')),
  cn AS (SELECT *, floor(pages / total * 100 + 0.5) / 100 AS coverage, CASE WHEN pages / total >= 0.8 THEN 'site-wide' WHEN pages / total >= 0.4 THEN 'section' ELSE 'page-local' END AS scope FROM al),
  cr AS (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY coverage DESC, uses DESC, turn, key) AS rank FROM cn)"""
query("site_canonical", f"{CANONICAL_SQL} SELECT site, category, rank, key, value, pages, uses, coverage, scope, merged, total FROM cr WHERE CASE category " + " ".join(f"WHEN '{c}' THEN rank <= {n}" for c, n in synthesis.LISTED.items()) + " ELSE true END")(
    lambda s, d: synthesis.elected(_canonical(s, d)[0])
)
_ODD = "od AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY uses DESC, list_position(['colors', 'typography', 'spacing', 'borders'], category), rank) AS k FROM cr WHERE category IN ('colors', 'typography', 'spacing', 'borders') AND scope <> 'site-wide' AND pages = 1 AND uses >= 2)"
query("site_token_outliers", f"{CANONICAL_SQL}, {_ODD} SELECT site, k AS rank, category, key, uses, coverage FROM od WHERE k <= {synthesis.OUTLIERS}")(lambda s, d: synthesis.outliers(_canonical(s, d)[0]))
query("site_grade", f"""{CANONICAL_SQL}, {_ODD}, w AS (SELECT site, {", ".join(f"coalesce(sum(CASE WHEN scope = 'site-wide' THEN uses ELSE 0 END) FILTER (category = '{c}') / nullif(sum(uses) FILTER (category = '{c}'), 0), 1)::DOUBLE AS {c}" for c in synthesis.WEIGHTS)} FROM cr GROUP BY site),
  z AS (SELECT site, total AS pages, {", ".join(f"floor(round({c} * 100, 9) + 0.5)::INT AS {c}" for c in synthesis.WEIGHTS)}, CASE WHEN total >= 2 THEN floor(round(({" + ".join(f"{c} * {w}::DOUBLE" for c, w in synthesis.WEIGHTS.items())}) / {sum(synthesis.WEIGHTS.values())}::DOUBLE * 100, 9) + 0.5)::INT END AS grade,
    (SELECT count(*) FROM od WHERE od.site = w.site AND k <= {synthesis.OUTLIERS}) AS outliers FROM w JOIN tot USING (site))
  SELECT *, CASE WHEN grade >= 90 THEN 'A' WHEN grade >= 80 THEN 'B' WHEN grade >= 70 THEN 'C' WHEN grade >= 60 THEN 'D' WHEN grade IS NOT NULL THEN 'F' END AS letter FROM z""")(lambda s, d: synthesis.grades(*_canonical(s, d)))


# --- design vectors ----------------------------------------------------------------------------------------------------
def page_profiles(e: DataFrame) -> DataFrame:
    """Profiles (``features.PROFILE``) of pages out of element rows, in one pass over them: texts are counted first, and a page's distinct ones collected."""
    sources = ("color", "background", "font_size", "font_weight", "font_family", "padding", "margin", "radius", "shadow", "transition")
    said = F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in sources))).alias("s")
    texts = e.select("page_id", "ord", "area", usage.interactive().alias("acts"), said).groupBy("page_id", "s.source", "s.text")
    texts = texts.agg(F.count("*").alias("n"), F.min(F.when(F.col("acts"), F.col("ord"))).alias("first_act"), F.max("area").alias("area"))
    of = lambda source, value: F.when(F.col("source") == source, value)
    some = lambda source, value: F.array_sort(F.collect_set(of(source, value)))
    text = F.col("text")
    size = T.number(text)
    height = F.when(size % 4 == 0, F.concat((size * 1.5).cast("string"), F.lit("px"))).otherwise("1.4")
    family = F.trim(F.substring_index("text", ",", 1))
    blur = F.regexp_extract("text", r"^\S+ \S+ ([\d.]+)px", 1).try_cast("double")
    depth = F.when(blur == 0, "flat").when(blur <= 4, "low").when(blur <= 12, "mid").otherwise("high")
    shadow = F.struct(F.lit(0.0).alias("x"), (blur / 4).alias("y"), blur.alias("blur"), F.lit(None).cast("double").alias("weight"), depth.alias("label"), F.lit(False).alias("inset"))
    part = lambda k: F.regexp_extract("text", r"^\S+ (\S+) (.+)$", k)
    move = F.struct(T.easing_family(part(2)).alias("family"), F.col("n").alias("count"))
    rows = texts.groupBy("page_id").agg(
        F.array_union(some("color", text), some("background", text)).alias("colors"), F.min_by("text", of("background", F.col("first_act"))).alias("primary"), some("background", F.when(F.col("area") > synthesis.LARGE, text)).alias("backgrounds"),
        some("font_size", F.struct(size.alias("size"), height.alias("line_height"))).alias("scale"), some("font_weight", text).alias("weights"), some("font_family", F.when(family != "system-ui", family)).alias("families"),
        F.array_union(some("padding", size), some("margin", size)).alias("spacing"), some("radius", size).alias("radii"), some("shadow", F.when(text != "none", shadow)).alias("shadows"),
        some("transition", T.milliseconds(part(1))).alias("durations"), some("transition", F.when(move["family"] == "spring", part(2))).alias("springs"), F.collect_list(of("transition", move)).alias("moves"),
    )
    total = lambda f: F.aggregate(F.filter("moves", lambda x: x["family"].eqNullSafe(f)), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    rows = rows.withColumn("easings", F.array_sort(F.transform(F.array_distinct(F.transform("moves", lambda x: x["family"])), lambda f: F.struct(f.alias("family"), total(f).alias("count")))))
    p = F.col("page_id")
    none = F.lit(None)
    return rows.select(
        "page_id", "colors", "primary", none.cast("string").alias("secondary"), none.cast("string").alias("accent"), "backgrounds", F.filter("colors", lambda x: x.rlike(r"^rgb\((\d+), \1, \1\)$")).alias("neutrals"), "scale",
        none.cast("struct<size:double,line_height:string>").alias("body"), "weights", "families", "spacing", F.when(p % 3 == 1, 4.0).when(p % 3 == 2, 8.0).alias("base"), "radii",
        F.when(p % 2 == 1, F.array(F.lit(1.0), (p % 4).cast("double"))).alias("widths"), "shadows", "durations", "easings", "springs", F.when(p % 2 == 1, p % 4 == 1).alias("scroll_linked"),
    )


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(features.raw_features(stored(page_profiles(elements.from_lineitem(spark, sf_dir)))))


_DIST = lambda c: f"list(DISTINCT {c}) FILTER ({c} IS NOT NULL)"
_MEDIAN = lambda x: f"list_aggregate({x}, 'median')"
_SOFT = "CASE WHEN shadow_y * 4 > 0 THEN shadow_y * 4 / (sqrt(pow(shadow_y, 2)) + shadow_y * 4) ELSE 0.0 END"
_FAMILY = "CASE easing WHEN 'linear' THEN 'linear' WHEN 'cubic-bezier(0.3, 1.5, 0.6, 1)' THEN 'spring' WHEN 'cubic-bezier(0.4, 0, 0.2, 1)' THEN 'custom' ELSE 'ease-in-out' END"
VECTORS_SQL = f"""WITH {E_}, xc AS (SELECT page_id, r, g, b, false AS large FROM elements UNION ALL SELECT page_id, br, bg, bb, area > {synthesis.LARGE} FROM elements), dc AS (SELECT page_id, r, g, b, bool_or(large) AS large FROM xc GROUP BY ALL),
  m AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn FROM dc), hs AS (SELECT *, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0.0::DOUBLE WHEN (mx + mn) / 2 > 0.5 THEN (mx - mn) / (2 - mx - mn) ELSE (mx - mn) / (mx + mn) END AS s,
    60 * CASE WHEN mx = mn THEN 0.0::DOUBLE WHEN greatest(r, g, b) = r THEN (g - b) / 255.0::DOUBLE / (mx - mn) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN greatest(r, g, b) = g THEN (b - r) / 255.0::DOUBLE / (mx - mn) + 2 ELSE (r - g) / 255.0::DOUBLE / (mx - mn) + 4 END AS h FROM m),
  co AS (SELECT page_id, coalesce(avg(s) FILTER (s > {features.CHROMATIC}), 0) AS chroma_mean, max(s) AS chroma_max, count(DISTINCT floor(h / 30)::INT % 12) FILTER (s > {features.CHROMATIC}) AS hue_count,
    CASE count(*) FILTER (s > {features.CHROMATIC}) WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 - sqrt(pow(avg(cos(radians(h))) FILTER (s > {features.CHROMATIC}), 2) + pow(avg(sin(radians(h))) FILTER (s > {features.CHROMATIC}), 2)) END AS hue_spread,
    avg(s) FILTER (r = g AND g = b) AS neutral_temp, count(DISTINCT floor(l * 20 + 0.5)) FILTER (large) AS surface_levels, avg(l) FILTER (large) AS surface_lightness FROM hs GROUP BY page_id),
  pr AS (SELECT page_id, arg_min(greatest(br, bg, bb) + least(br, bg, bb), ord) / 510.0::DOUBLE AS pl FROM elements WHERE {_ACTS} GROUP BY page_id),
  li AS (SELECT page_id, list_sort({_DIST(PX.format("font_size"))}) AS sizes, max(font_weight::INT) - min(font_weight::INT) AS weight_range, count(DISTINCT trim(split_part(font_family, ',', 1))) FILTER (font_family <> 'system-ui') AS family_count,
    list_distinct(list_concat({_DIST(f"nullif({PX.format('padding')}, 0)")}, {_DIST(f"nullif({PX.format('margin')}, 0)")})) AS spacing, {_DIST(PX.format("radius"))} AS radii, list(DISTINCT {_SOFT}) AS softs, list(DISTINCT shadow_y) FILTER (shadow_y IS NOT NULL) AS shadows,
    {_DIST("duration::DOUBLE")} AS durations, count(*) FILTER ({_FAMILY} = 'linear') / count(*) AS linear_share, count(DISTINCT easing) FILTER ({_FAMILY} = 'spring') AS springs,
    CASE page_id % 3 WHEN 1 THEN 4.0::DOUBLE WHEN 2 THEN 8.0::DOUBLE END AS base FROM elements GROUP BY page_id),
  st AS (SELECT *, list_transform(range(2, len(sizes) + 1), lambda k: sizes[k] / sizes[k - 1]) AS steps, list_transform(sizes, lambda z: CASE WHEN z % 4 = 0 THEN z * 1.5 / z ELSE 1.4::DOUBLE END) AS heights, list_filter(radii, lambda v: v < {features.PILL}) AS corners FROM li),
  w AS (SELECT page_id, chroma_mean, chroma_max, hue_count, hue_spread, neutral_temp, nullif(surface_levels, 0) AS surface_levels, surface_lightness, abs(pl - surface_lightness) AS accent_delta, CASE WHEN len(sizes) >= 3 THEN {_MEDIAN("steps")} END AS scale_ratio,
    CASE WHEN len(sizes) >= 3 THEN 1 - least(1, list_avg(list_transform(steps, lambda z: abs(z - {_MEDIAN("steps")}) / {_MEDIAN("steps")}))) END AS scale_regularity, list_max(sizes) / {_MEDIAN("sizes")} AS display_contrast, {_MEDIAN("heights")} AS body_line_height, weight_range, nullif(family_count, 0) AS family_count,
    base AS base_unit, CASE WHEN len(spacing) > 0 THEN len(list_filter(spacing, lambda v: abs(v / base - floor(v / base + 0.5)) < 0.01)) / len(spacing) + 0 * base END AS ramp_regularity, nullif(len(spacing), 0) AS scale_depth, list_max(spacing) / base AS scale_spread,
    CASE WHEN len(corners) > 0 THEN {_MEDIAN("corners")} WHEN len(radii) > 0 THEN 0 END AS radius_median, CASE WHEN len(corners) > 0 THEN list_aggregate(corners, 'stddev_pop') WHEN len(radii) > 0 THEN 0 END AS radius_variance, len(list_filter(radii, lambda v: v >= {features.PILL})) / nullif(len(radii), 0) AS pill_rate,
    CASE WHEN page_id % 2 = 1 THEN (1 + page_id % 4) / 2 END AS border_weight, list_avg(list_transform(shadows, lambda y: CASE WHEN y > 0 THEN y * 4 / (y + y * 4) ELSE 0 END)) AS shadow_softness,
    len(list_distinct(list_transform(shadows, lambda y: CASE WHEN y = 0 THEN 'flat' WHEN y * 4 <= 4 THEN 'low' WHEN y * 4 <= 12 THEN 'mid' ELSE 'high' END))) AS elevation_levels, {_MEDIAN("durations")} AS duration_median, list_max(durations) - list_min(durations) AS duration_spread,
    least(1, springs / {features.SPRINGS}) AS springiness, 0 AS ease_out_share, linear_share, CASE page_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 0 END AS scroll_linked FROM st JOIN co USING (page_id) LEFT JOIN pr USING (page_id)),
  fv AS (SELECT page_id, unnest([{", ".join(f"{{'i': {k}, 'axis': '{axis}', 'feature': '{name}', 'raw': {name}::DOUBLE, 'value': least(greatest(({name}::DOUBLE - {low}) / ({high} - {low}::DOUBLE), 0), 1)}}" for k, (axis, name, low, high) in enumerate(features.SPEC))}]) AS f FROM w),
  ve AS (SELECT page_id, f.i AS i, f.axis AS axis, f.feature AS feature, f.raw AS raw, f.value AS value FROM fv WHERE f.raw IS NOT NULL)"""


@query("design_features", f"{VECTORS_SQL} SELECT page_id, axis, feature, round(raw, 6) AS raw, round(value, 6) AS value FROM ve")
def design_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    both = raw.join(features.design_vectors(raw), "page_id")
    one = F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(name).alias("feature"), F.round(name, 6).alias("raw"), F.round(F.get("vector", F.lit(k)), 6).alias("value")) for k, (axis, name, *_) in enumerate(features.SPEC))))
    return both.select("page_id", one.alias("f")).select("page_id", "f.*").where("raw is not null")


_GAP = lambda axis: f"round(avg(abs(x.value - y.value)){f' FILTER (x.axis = {axis!r})' if axis else ''}, 6)"


@query("design_distances", f"""{VECTORS_SQL}, pg AS (SELECT DISTINCT page_id FROM elements), pp AS (SELECT x.page_id AS page, y.page_id AS other FROM pg x JOIN pg y ON x.page_id // {_SITE} = y.page_id // {_SITE} AND x.page_id < y.page_id)
  SELECT page, other, {_GAP(None)} AS distance, count(*) AS compared, {", ".join(f"{_GAP(axis)} AS {axis}, count(*) FILTER (x.axis = '{axis}') AS {axis}_compared" for axis in features.AXES)}
  FROM pp JOIN ve x ON x.page_id = page JOIN ve y ON y.page_id = other AND x.i = y.i GROUP BY page, other""")
def design_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one site with each other; a site has SITE pages at most."""
    v = stored(features.design_vectors(_raw(spark, sf_dir))).select("page_id", "vector", F.floor(F.col("page_id") / elements.SITE).alias("site"))
    pairs = v.select("site", F.col("page_id").alias("page"), F.col("vector").alias("a")).join(v.select("site", F.col("page_id").alias("other"), F.col("vector").alias("b")), "site").where("page < other").drop("site")
    out = features.design_distances(pairs)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in out.dtypes))


@query("axis_percentiles", f"""{VECTORS_SQL}, rk AS (SELECT page_id, axis, round((rank() OVER (PARTITION BY i ORDER BY round(value, 9)) - 1 + count(*) OVER (PARTITION BY i, round(value, 9)) / 2) / count(*) OVER (PARTITION BY i), 6) AS percentile FROM ve)
  SELECT page_id AS id, axis, round(avg(percentile), 6) AS percentile, count(*) AS features FROM rk GROUP BY 1, 2""")
def axis_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features.design_vectors(_raw(spark, sf_dir)).select(F.col("page_id").alias("id"), F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))
    return features.axis_percentiles(vectors.percentiles(stored(v))).select("id", "axis", F.round("percentile", 6).alias("percentile"), "features")


# --- components --------------------------------------------------------------------------------------------------------
#: Candidates out of element rows, the same words for both engines.
_KIND = "CASE WHEN class_list = 'card' THEN 'card' WHEN tag = 'button' OR class_list LIKE 'btn%' THEN 'button' WHEN class_list = 'badge' THEN 'badge' WHEN tag = 'li' THEN 'input' WHEN tag = 'h1' THEN NULL ELSE 'text' END"
_HINTS = """CASE WHEN font_weight = '700' THEN 'primary' WHEN height % 48 = 0 THEN 'ghost' WHEN height = 32 THEN 'default' END AS variant_hint, CASE height WHEN 16 THEN 'sm' WHEN 96 THEN 'lg' END AS size_hint,
  CASE WHEN width % 3 = 0 THEN '' WHEN width % 7 = 0 THEN NULL ELSE concat(tag, width) END AS text"""


def candidates(e: DataFrame) -> DataFrame:
    px = lambda c: T.number(F.col(c))
    parts = lambda c: F.transform(F.split(F.regexp_extract(c, r"\d+, \d+, \d+", 0), ", "), lambda x: x.cast("double") / 255 * 20)
    style = F.concat(F.array(px("padding"), px("margin"), px("radius"), px("font_size"), F.col("font_weight").cast("double") / 100), parts("color"), parts("background"))
    slots = F.when(F.col("width") % 2 == 0, F.array(F.lit("icon"), F.lit("text"))).when(F.col("width") % 5 == 0, F.array(*map(F.lit, ("heading", "text", "icon", "badge")))).when(F.col("width") % 11 != 0, F.array(F.lit("text")))
    rows = e.withColumns({"kind": F.expr(_KIND), "structural_hash": F.concat_ws("/", "tag", "class_list"), "style_vector": style, "slots": slots, "disabled": F.when(F.col("z_index") != "auto", True), "css": F.col("color")})
    return rows.selectExpr("page_id", "ord", "kind", "structural_hash", "style_vector", *_expressions(_HINTS), "disabled", "css", "slots")


_CANDIDATES = f"""{E_}, cd AS (SELECT page_id, ord, {_KIND} AS kind, tag || '/' || class_list AS structural_hash, {_HINTS}, z_index IS NOT NULL AS disabled, color AS css,
  CASE WHEN width % 2 = 0 THEN ['icon', 'text'] WHEN width % 5 = 0 THEN ['heading', 'text', 'icon', 'badge'] WHEN width % 11 <> 0 THEN ['text'] ELSE [] END AS slots,
  [{", ".join(PX.format(c) for c in ("padding", "margin", "radius", "font_size"))}, font_weight::DOUBLE / 100, {", ".join(f"{c} / 255.0::DOUBLE * 20" for c in ("r", "g", "b", "br", "bg", "bb"))}] AS v FROM elements)"""
_COS = "round(list_dot_product(x.v, r.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(r.v, r.v))), 9)"
query("component_variants", f"""WITH RECURSIVE {_CANDIDATES}, r AS (SELECT page_id, kind, structural_hash AS sh, ord, v, row_number() OVER (PARTITION BY page_id, kind, structural_hash ORDER BY ord) AS i FROM cd),
  g AS (SELECT page_id, kind, sh, i, [{{'ord': ord, 'v': v, 'n': 1}}] AS xs FROM r WHERE i = 1
    UNION ALL SELECT page_id, kind, sh, i, CASE WHEN hit IS NULL THEN list_concat(xs, [{{'ord': ord, 'v': v, 'n': 1}}]) ELSE list_concat(list_concat(xs[:hit - 1], [{{'ord': xs[hit].ord, 'v': xs[hit].v, 'n': xs[hit].n + 1}}]), xs[hit + 1:]) END FROM (
      SELECT r.*, g.xs, list_position(list_transform(g.xs, lambda x: {_COS} >= {components.ALIKE}), true) AS hit FROM g JOIN r ON r.page_id = g.page_id AND r.kind IS NOT DISTINCT FROM g.kind AND r.sh = g.sh AND r.i = g.i + 1)),
  l AS (SELECT page_id, kind, sh, xs FROM g QUALIFY row_number() OVER (PARTITION BY page_id, kind, sh ORDER BY i DESC) = 1)
  SELECT page_id, coalesce(kind, '') AS kind, sh AS structural_hash, (generate_subscripts(xs, 1) - 1)::INT AS variant, unnest(xs).ord AS example_ord, unnest(xs).n::BIGINT AS members FROM l""")(
    lambda s, d: components.variants(candidates(elements.from_lineitem(s, d))).fillna("", ["kind"])
)
query("component_anatomy", f"""WITH {_CANDIDATES}, c AS (SELECT *, coalesce(kind, 'other') AS k, coalesce(variant_hint, 'default') AS va, coalesce(size_hint, 'default') AS sz, array_to_string(slots, '>') AS shape FROM cd),
  w AS (SELECT page_id, k, count(*) AS instances, bool_or(disabled) AS any_disabled, arg_min(slots, ord) AS own FROM c GROUP BY 1, 2 HAVING count(*) >= 2),
  sh AS (SELECT page_id, k, arg_max(shape, (n, -f)) AS slot_shape FROM (SELECT page_id, k, shape, count(*) AS n, min(ord) AS f FROM c GROUP BY ALL) GROUP BY 1, 2),
  zs AS (SELECT page_id, k, va, string_agg(sz || ':' || n || ':' || css, ',' ORDER BY f) AS sizes FROM (SELECT page_id, k, va, sz, count(*) AS n, min(ord) AS f, arg_min(css, ord) AS css FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
  vs AS (SELECT page_id, k, va, count(*) AS n, min(ord) AS f, count(*) FILTER (disabled) AS disabled, coalesce(arg_min(css, ord) FILTER (NOT disabled), '') AS default_css, coalesce(arg_min(css, ord) FILTER (disabled), '') AS disabled_css FROM c GROUP BY 1, 2, 3),
  tx AS (SELECT page_id, k, va, string_agg(text, ',' ORDER BY ord) FILTER (text <> '') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY page_id, k, va ORDER BY ord) AS i FROM c) WHERE i <= 5 GROUP BY 1, 2, 3),
  ph AS (SELECT page_id, k, string_agg(variant_hint, ',' ORDER BY f) AS hints FROM (SELECT page_id, k, variant_hint, min(ord) AS f FROM c WHERE variant_hint <> 'default' GROUP BY ALL) GROUP BY 1, 2)
  SELECT page_id, k AS kind, instances, slot_shape, va AS variant, row_number() OVER (PARTITION BY page_id, k ORDER BY n DESC, f)::INT AS rank, n AS count, n - disabled AS default_count, default_css, disabled AS disabled_count, disabled_css, sizes, coalesce(samples, '') AS samples, coalesce(hints, '') AS hints, any_disabled,
    CASE k WHEN 'button' THEN list_contains(own, 'icon') WHEN 'card' THEN list_contains(own, 'icon') WHEN 'input' THEN list_contains(own, 'icon') ELSE false END AS has_icon
  FROM vs JOIN w USING (page_id, k) JOIN sh USING (page_id, k) JOIN zs USING (page_id, k, va) JOIN tx USING (page_id, k, va) LEFT JOIN ph USING (page_id, k)""")(lambda s, d: _flat_anatomies(components.anatomies(candidates(elements.from_lineitem(s, d)))))


def _flat_anatomies(rows: DataFrame) -> DataFrame:
    """A row for each variant of ``components.anatomies``."""
    joined = lambda c: F.array_join(c, ",")
    icon = F.coalesce(F.try_element_at("slots", F.lit("icon")), F.try_element_at("slots", F.lit("media")), F.try_element_at("slots", F.lit("leading")), F.lit(False))
    rows = rows.select("page_id", "kind", "instances", "slot_shape", F.posexplode("variants").alias("at", "v"), joined("props.variant").alias("hints"), F.col("props.disabled").alias("any_disabled"), icon.alias("has_icon"))
    state = lambda name: (F.col(f"v.states.{name}.count").alias(f"{name}_count"), F.coalesce(f"v.states.{name}.css", F.lit("")).alias(f"{name}_css"))
    sizes = joined(F.transform("v.sizes", lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"), x["css"])))
    return rows.select("page_id", "kind", "instances", "slot_shape", F.col("v.name").alias("variant"), (F.col("at") + 1).alias("rank"), "v.count", *state("default"), *state("disabled"), sizes.alias("sizes"), joined("v.sample_text").alias("samples"), "hints", "any_disabled", "has_icon")


# --- token documents ---------------------------------------------------------------------------------------------------
_RAMP = RAMP_SQL[len(f"WITH {E_}, {_USES}, "):].replace("h AS (SELECT DISTINCT hex AS base FROM uses)", "h AS (SELECT DISTINCT key AS base FROM br)")
_RAMP_PARTS, _RAMP_SELECT = _RAMP.rsplit("SELECT base, anchor", 1)
_SEMANTIC = {"color.action.primary": ("color", "color.brand.primary"), "color.surface.default": ("color", "color.background.bg0"), "color.text.body": ("color", "color.text.text0"), "radius.control": ("dimension", "radius.r0")}
DOCUMENT_SQL = f"""{CANONICAL_SQL}, br AS (SELECT site, coalesce(max(key) FILTER (category = 'primary' AND rank = 1), max(key) FILTER (category = 'colors' AND rank = 1), '{tokendoc.NO_COLOR}') AS key FROM cr GROUP BY site),
  {_RAMP_PARTS.rstrip()}, rp AS (SELECT base, anchor{_RAMP_SELECT}),
  nu AS (SELECT site, category, key, value, row_number() OVER (PARTITION BY site, category ORDER BY key::DOUBLE) - 1 AS i, row_number() OVER (PARTITION BY site, category ORDER BY key::DOUBLE DESC) - 1 AS j FROM cr WHERE category IN ('spacing', 'borders', 'typeScale')),
  tk AS (SELECT site, 'primitive.color.brand.primary' AS path, 'color' AS type, key AS value FROM br
    UNION ALL SELECT br.site, 'primitive.color.ramp.primary.' || step, 'color', hex FROM br JOIN rp ON rp.base = br.key
    UNION ALL SELECT site, CASE category WHEN 'backgrounds' THEN 'primitive.color.background.bg' ELSE 'primitive.color.text.text' END || (rank - 1), 'color', key FROM cr WHERE (category = 'backgrounds' AND rank <= {synthesis.LISTED["backgrounds"]}) OR (category = 'text' AND rank <= {synthesis.LISTED["text"]})
    UNION ALL SELECT site, CASE category WHEN 'spacing' THEN 'primitive.spacing.s' ELSE 'primitive.radius.r' END || i, 'dimension', key || 'px' FROM nu WHERE category <> 'typeScale'
    UNION ALL SELECT site, 'primitive.shadow.sh' || (rank - 1), 'shadow', key FROM cr WHERE category = 'shadows' UNION ALL SELECT site, 'primitive.fontFamily.f' || (rank - 1), 'fontFamily', value FROM cr WHERE category = 'typography'
    UNION ALL SELECT site, path, type, value FROM br, (VALUES {", ".join(f"('semantic.{path}', '{kind}', '{{primitive.{to}}}')" for path, (kind, to) in _SEMANTIC.items())}) t(path, type, value)
    UNION ALL SELECT site, 'semantic.shadow.elevated', 'shadow', '{{primitive.shadow.sh' || count(*) FILTER (category = 'shadows') // 2 || '}}' FROM cr GROUP BY site
    UNION ALL SELECT br.site, 'semantic.typography.body', 'typography', '{{"fontFamily":"' || coalesce(f.value, '{tokendoc.NO_FAMILY}') || '","fontSize":"' || coalesce(z.key || 'px', '{tokendoc.NO_SIZE}') || '","fontWeight":"' || coalesce(z.value, '{tokendoc.NO_WEIGHT}') || '","lineHeight":"{tokendoc.LINE_HEIGHT}"}}'
      FROM br LEFT JOIN cr f ON f.site = br.site AND f.category = 'typography' AND f.rank = 1 LEFT JOIN nu z ON z.site = br.site AND z.category = 'typeScale' AND z.j = 0)"""


@query("token_document", f"""{DOCUMENT_SQL} SELECT t.site, t.path, t.type, t.value, CASE WHEN starts_with(t.value, '{{primitive') THEN e.value ELSE t.value END AS resolved FROM tk t LEFT JOIN tk e ON e.site = t.site AND t.value = '{{' || e.path || '}}'""")
def token_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all sites, read back from their text, with references followed."""
    rows = tokendoc.token_rows(synthesis.elected(_canonical(spark, sf_dir)[0]))
    files = tokendoc.token_documents(rows).select(F.col("site").alias("id"), F.lit("tokens.json").alias("name"), F.col("document").alias("text"))
    return tokendoc.resolved(stored(stylesheets.read_tokens(stored(files)).withColumnRenamed("id", "site")))
