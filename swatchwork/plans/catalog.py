"""The library's queries over the supplied tables, each with the SQL that another engine runs for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchwork.functions import csstext as T
from swatchwork.operators import classify, compare, history, scales, tokens, usage, vectors
from swatchwork.sources import elements, storage
from swatchwork.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
E_ = elements.SQL
#: The palette that colours are held against.
PALETTE = ["#000000", "#333333", "#ffffff", "#ff0033", "#0066cc", "#339966", "#ffcc00", "#9933cc"]
PALETTE_SQL = "palette AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:7], 16)})" for i, h in enumerate(PALETTE)) + ") t(rank, hex, r, g, b))"
HEX = "printf('#%02x%02x%02x', {}, {}, {})"
FG, BG = HEX.format("r", "g", "b"), HEX.format("br", "bg", "bb")
_LIN = "(CASE WHEN ({0}) / 255.0::DOUBLE <= 0.03928 THEN ({0}) / 255.0::DOUBLE / 12.92 ELSE pow((({0}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
_LUM = lambda r, g, b: f"(0.2126 * {_LIN.format(r)} + 0.7152 * {_LIN.format(g)} + 0.0722 * {_LIN.format(b)})"
_CONTRAST = lambda x, y: f"((greatest({x}, {y}) + 0.05) / (least({x}, {y}) + 0.05))"
PX = "replace({}, 'px', '')::DOUBLE"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_elements(name: str, sql: str | None = None):
    """A query over the bound element rows."""
    return lambda f: query(name, sql and f"WITH {E_} {sql}")(lambda spark, sf_dir: f(elements.from_lineitem(spark, sf_dir)))


def palette(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(PALETTE)) + " AS t(rank, hex)")


# --- usage -------------------------------------------------------------------------------------------------------------
_USES = f"""uses AS (SELECT page_id, ord, area, {FG} AS hex, 'text' AS context, tag, class_list FROM elements
  UNION ALL SELECT page_id, ord, area, {BG}, 'background', tag, class_list FROM elements)"""
_ACTS = "(tag IN ('a', 'button') OR regexp_matches(lower(class_list), 'btn|button|link|cta'))"
on_elements("color_usage", f""", {_USES} SELECT page_id, hex, count(*) AS uses, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts,
  sum(CASE WHEN context = 'background' THEN area ELSE 0 END)::BIGINT AS background_area,
  count(*) FILTER (context = 'background' AND {_ACTS}) AS interactive, min(ord) AS first_ord, min(ord * 2 + (context = 'background')::INT) AS first_place FROM uses GROUP BY ALL""")(usage.color_usage)
on_elements("dominant_colors", f""", {_USES}, a AS (SELECT page_id, hex, sum(area) FILTER (context = 'background') AS background_area, min(ord) AS first_ord FROM uses GROUP BY ALL),
  b AS (SELECT *, round(background_area / sum(background_area) OVER (PARTITION BY page_id), 3) AS share,
    row_number() OVER (PARTITION BY page_id ORDER BY background_area DESC, first_ord, hex) AS rank FROM a WHERE background_area > 0)
  SELECT page_id, hex, background_area::BIGINT AS background_area, share, rank FROM b WHERE rank <= 8""")(usage.dominant_colors)
on_elements("large_surfaces", f"SELECT page_id, {BG} AS hex, min(ord) AS first_ord FROM elements WHERE area > 50000 GROUP BY ALL")(usage.large_surfaces)
on_elements("text_colors", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_ord) AS rank
  FROM (SELECT page_id, {FG} AS hex, min(ord) AS first_ord FROM elements GROUP BY ALL)) WHERE rank <= 10""")(usage.text_colors)
on_elements("family_histogram", """SELECT page_id, trim(split_part(font_family, ',', 1)) AS family, count(*) AS uses, bool_or(regexp_matches(tag, '^h[1-6]$')) AS headings,
  bool_or(tag IN ('p', 'span', 'li')) AS body, min(ord) AS first_ord FROM elements WHERE split_part(font_family, ',', 1) <> 'system-ui' GROUP BY 1, 2""")(usage.family_histogram)
on_elements("type_scale", f"""SELECT page_id, {PX.format("font_size")} AS size, count(*) AS uses, arg_min(font_weight, ord) AS weight, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
  FROM elements GROUP BY 1, 2""")(usage.type_scale)
on_elements("body_size", f"""SELECT page_id, size, uses FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, f) AS n FROM (
  SELECT page_id, {PX.format("font_size")} AS size, count(*) AS uses, min(ord) AS f FROM elements WHERE tag IN ('p', 'span', 'li') GROUP BY 1, 2)) WHERE n = 1""")(usage.body_size)
on_elements("most_common_style", """, u AS (SELECT page_id, tag, ord, 'color' AS property, color AS value FROM elements UNION ALL SELECT page_id, tag, ord, 'font_size', font_size FROM elements
  UNION ALL SELECT page_id, tag, ord, 'padding', padding FROM elements UNION ALL SELECT page_id, tag, ord, 'radius', radius FROM elements
  UNION ALL SELECT page_id, tag, ord, 'shadow', '0px ' || shadow_y || 'px ' || shadow_y * 4 || 'px rgba(0, 0, 0, 0.2)' FROM elements WHERE shadow_y IS NOT NULL),
  c AS (SELECT page_id, tag, property, value, count(*) AS uses, min(ord) AS f FROM u GROUP BY ALL)
  SELECT page_id, tag, property, value, uses FROM (SELECT *, row_number() OVER (PARTITION BY page_id, tag, property ORDER BY uses DESC, f) AS n FROM c) WHERE n = 1""")(usage.common_style)
on_elements("button_variants", f""", c AS (SELECT page_id, {BG} AS hex, count(*) AS uses, min(ord) AS f FROM elements WHERE tag = 'button' OR contains(class_list, 'btn') GROUP BY ALL),
  d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, f) AS rank FROM c)
  SELECT page_id, hex, uses, rank, CASE WHEN hex = '#ffffff' THEN 'ghost' WHEN rank = 1 THEN 'primary' WHEN rank = 2 THEN 'secondary' ELSE 'variant-' || rank END AS variant FROM d""")(usage.button_variants)
_PAIRS = f"""pairs AS (SELECT *, CASE WHEN ratio >= CASE WHEN large THEN 4.5 ELSE 7 END THEN 'AAA' WHEN ratio >= CASE WHEN large THEN 3 ELSE 4.5 END THEN 'AA' ELSE 'FAIL' END AS level FROM (
  SELECT page_id, {FG} AS fg, {BG} AS back, any_value(br) AS br, any_value(bg) AS bg, any_value(bb) AS bb, count(*) AS uses, max({PX.format("font_size")}) AS max_size, min(ord) AS first_ord,
  max({PX.format("font_size")}) >= 18 OR (max({PX.format("font_size")}) >= 14 AND bool_or(tag = 'b')) AS large,
  any_value({_CONTRAST(_LUM("r", "g", "b"), _LUM("br", "bg", "bb"))}) AS ratio FROM elements WHERE {FG} <> {BG} AND tag <> 'div' GROUP BY page_id, {FG}, {BG}))"""
_CONTRAST_SCORE = """score AS (SELECT page_id, count(level) AS pairs, coalesce(sum(uses) FILTER (level <> 'FAIL'), 0)::BIGINT AS passing, coalesce(sum(uses) FILTER (level = 'FAIL'), 0)::BIGINT AS failing,
  coalesce(floor(100.0::DOUBLE * coalesce(sum(uses) FILTER (level <> 'FAIL'), 0) / sum(uses) + 0.5), 100)::INT AS score FROM (SELECT DISTINCT page_id FROM elements) LEFT JOIN pairs USING (page_id) GROUP BY page_id)"""
on_elements("contrast_pairs", f""", {_PAIRS} SELECT page_id, fg, back AS bg, uses, max_size, large, round(ratio, 4) AS ratio, level, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY level = 'FAIL' DESC, uses DESC, first_ord, fg, back) AS rank FROM pairs) WHERE rank <= 50""")(usage.contrast_pairs)
on_elements("contrast_score", f", {_PAIRS}, {_CONTRAST_SCORE} SELECT * FROM score")(usage.contrast_score)
on_elements("drift_verdict", f""", {PALETTE_SQL}, {_USES}, h AS (SELECT DISTINCT page_id, hex FROM uses), d AS (SELECT page_id, hex, min(round(sqrt(pow(('0x' || hex[2:3])::INT - r, 2) + pow(('0x' || hex[4:5])::INT - g, 2) + pow(('0x' || hex[6:7])::INT - b, 2)), 4)) AS d
  FROM h, (SELECT r, g, b FROM palette) GROUP BY ALL), v AS (SELECT page_id, count(*) AS colors, count(*) FILTER (d > 8) AS unknown FROM d GROUP BY ALL)
  SELECT *, round(unknown / colors, 4) AS drift_ratio, CASE WHEN unknown = 0 THEN 'in-sync' WHEN unknown / colors < 0.15 THEN 'minor-drift' WHEN unknown / colors < 0.4 THEN 'notable-drift' ELSE 'major-drift' END AS verdict FROM v""")(
    lambda e: usage.drift_verdict(usage.nearest_palette(e, palette(e.sparkSession)))
)
on_elements("nearest_palette_color", f""", {PALETTE_SQL}, {_USES}, h AS (SELECT DISTINCT page_id, hex AS hex FROM uses), d AS (SELECT page_id, h.hex, p.hex AS token, rank,
  round(sqrt(pow(('0x' || h.hex[2:3])::INT - r, 2) + pow(('0x' || h.hex[4:5])::INT - g, 2) + pow(('0x' || h.hex[6:7])::INT - b, 2)), 4) AS distance FROM h, palette p)
  SELECT page_id, hex, token, distance, distance <= 8 AS known FROM (SELECT *, row_number() OVER (PARTITION BY page_id, hex ORDER BY distance, rank) AS n FROM d) WHERE n = 1""")(
    lambda e: usage.nearest_palette(e, palette(e.sparkSession))
)
on_elements("contrast_remediation", f""", {PALETTE_SQL}, {_PAIRS}, f AS (SELECT * FROM pairs WHERE level = 'FAIL'), c AS (SELECT f.page_id, f.fg, f.back, f.large, p.hex, p.rank,
  round({_CONTRAST(_LUM("p.r", "p.g", "p.b"), _LUM("f.br", "f.bg", "f.bb"))}, 6) AS ratio FROM f, palette p), g AS (SELECT *, row_number() OVER (PARTITION BY page_id, fg, back ORDER BY ratio DESC, rank) AS n FROM c
  WHERE ratio >= CASE WHEN large THEN 3 ELSE 4.5 END)
  SELECT f.page_id, f.fg, f.back AS bg, f.large, g.hex AS suggestion, round(g.ratio, 4) AS new_ratio FROM f LEFT JOIN g ON f.page_id = g.page_id AND f.fg = g.fg AND f.back = g.back AND g.n = 1""")(
    lambda e: usage.contrast_remediation(e, palette(e.sparkSession))
)
on_elements("zindex_layers", """SELECT page_id, CASE WHEN z_index >= 1000 THEN 'modal' WHEN z_index >= 100 THEN 'dropdown' WHEN z_index >= 10 THEN 'sticky' ELSE 'base' END AS layer, count(*) AS uses,
  min(z_index)::INT AS lowest, max(z_index)::INT AS highest, count(DISTINCT z_index) AS values FROM elements WHERE z_index IS NOT NULL GROUP BY 1, 2""")(usage.z_layers)
on_elements("shadow_usage", """SELECT page_id, '0px ' || shadow_y || 'px ' || shadow_y * 4 || 'px rgba(0, 0, 0, 0.2)' AS shadow, count(*) AS uses, (shadow_y * 4)::DOUBLE AS blur,
  CASE WHEN shadow_y = 0 THEN 'flat' WHEN shadow_y * 4 <= 4 THEN 'low' WHEN shadow_y * 4 <= 12 THEN 'mid' ELSE 'high' END AS depth FROM elements WHERE shadow_y IS NOT NULL GROUP BY page_id, shadow_y""")(usage.shadow_usage)
on_elements("motion_profile", """SELECT page_id, CASE WHEN duration <= 80 THEN 'instant' WHEN duration <= 150 THEN 'xs' WHEN duration <= 250 THEN 'sm' WHEN duration <= 400 THEN 'md' WHEN duration <= 700 THEN 'lg' WHEN duration <= 1200 THEN 'xl' ELSE 'xxl' END AS band,
  CASE easing WHEN 'linear' THEN 'linear' WHEN 'cubic-bezier(0.3, 1.5, 0.6, 1)' THEN 'spring' WHEN 'cubic-bezier(0.4, 0, 0.2, 1)' THEN 'custom' ELSE 'ease-in-out' END AS easing, count(*) AS uses, round(avg(duration), 4) AS mean_ms FROM elements GROUP BY 1, 2, 3""")(usage.motion_profile)
on_elements("radius_histogram", f"SELECT page_id, {PX.format('radius')} AS radius, count(*) AS uses, max(area) AS max_area FROM elements WHERE radius <> '0px' GROUP BY 1, 2")(usage.radius_histogram)

# --- scales ------------------------------------------------------------------------------------------------------------
_SPACING = f"""v AS (SELECT DISTINCT page_id, value::BIGINT AS value FROM (SELECT page_id, {PX.format("padding")} AS value FROM elements UNION ALL SELECT page_id, {PX.format("margin")} FROM elements) WHERE value > 0 AND value < 500)"""
on_elements("spacing_natural_breaks", f""", {_SPACING}, g AS (SELECT *, value - lag(value) OVER w AS gap FROM v WINDOW w AS (PARTITION BY page_id ORDER BY value)),
  m AS (SELECT page_id, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS median FROM g GROUP BY page_id),
  k AS (SELECT g.*, sum(CASE WHEN gap > median THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY value) AS grp FROM g JOIN m USING (page_id))
  SELECT page_id, min(value) AS value, count(*) AS members FROM k GROUP BY page_id, grp""")(lambda e: scales.natural_breaks(scales.spacing_values(e)))
_UNITS = "u AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate(scales.UNITS)) + ") t(rank, unit))"
on_elements("spacing_base_unit", f""", {_SPACING}, {_UNITS}, s AS (SELECT page_id, rank, unit, count(*) AS n, round(avg(CASE WHEN value % unit = 0 THEN 1.0 ELSE 0.0 END) + CASE WHEN unit IN (4, 8) THEN 0.04::DOUBLE ELSE 0 END, 6) AS score FROM v, u GROUP BY page_id, rank, unit),
  b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rank) AS k FROM s)
  SELECT page_id, n AS n_values, CASE WHEN n >= 3 AND score >= 0.6 THEN unit END AS base_unit, CASE WHEN n >= 3 AND score >= 0.6 THEN score END AS score FROM b WHERE k = 1""")(lambda e: scales.base_unit(scales.spacing_values(e)))
on_elements("radius_clusters", f""", x AS (SELECT page_id, list_sort(list(DISTINCT {PX.format("radius")})) AS xs FROM elements WHERE radius <> '0px' GROUP BY page_id),
  a AS (SELECT page_id, xs, list_reduce(list_transform(xs, lambda y: [y]), lambda acc, y: CASE WHEN y[1] - acc[-1] <= 2 THEN acc ELSE list_concat(acc, y) END) AS anchors FROM x),
  r AS (SELECT page_id, unnest(xs) AS value, anchors FROM a)
  SELECT page_id, list_max(list_filter(anchors, lambda y: y <= value)) AS anchor, count(*) AS members FROM r GROUP BY 1, 2""")(
    lambda e: scales.anchored_clusters(usage.radius_histogram(e).select("page_id", F.col("radius").alias("value")), 2.0)
)
on_elements("width_clusters", """, v AS (SELECT page_id, width AS value, count(*) AS uses FROM elements GROUP BY ALL), g AS (SELECT *, lag(value) OVER (PARTITION BY page_id ORDER BY value) AS last FROM v),
  k AS (SELECT *, sum(CASE WHEN value - last > greatest(1.0, last * 0.01::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY value) AS grp FROM g)
  SELECT page_id, arg_max(value, (uses, -value)) AS value, sum(uses)::BIGINT AS uses, count(*) AS members FROM k GROUP BY page_id, grp""")(
    lambda e: scales.chained_clusters(e.groupBy("page_id", F.col("width").alias("value")).agg(F.count("*").alias("uses")), 0.01)
)
_SIZES_SQL = f"v AS (SELECT DISTINCT page_id, {PX.format('font_size')} AS value FROM elements), t AS (SELECT page_id, value / lag(value) OVER (PARTITION BY page_id ORDER BY value) AS step FROM v)"
on_elements("type_scale_ratios", f", {_SIZES_SQL} SELECT page_id, count(*) AS steps, round(avg(step), 6) AS mean_ratio, round(var_pop(step), 6) AS variance FROM t WHERE step > 1.01 AND step < 3 GROUP BY page_id")(
    lambda e: scales.scale_ratios(usage.type_scale(e).select("page_id", F.col("size").alias("value")))
)
_RATIOS = "n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {r}::DOUBLE)" for i, (k, r) in enumerate(scales.RATIOS.items())) + ") t(rank, name, ratio))"
on_elements("type_ratio", f""", {_SIZES_SQL}, {_RATIOS}, p AS (SELECT page_id, rank, name, ratio, step, greatest(1, floor(ln(step) / ln(ratio) + 0.5)) AS power FROM t, n WHERE step > 1.01 AND step < 3),
  f AS (SELECT page_id, rank, name, ratio, count(*) AS n, round(avg(abs(step - pow(ratio, power)) / pow(ratio, power) + CASE WHEN power > 3 THEN 0.5 ELSE 0 END) + 0.03 * (avg(power) - 1), 9) AS error FROM p GROUP BY ALL),
  b AS (SELECT page_id, name, ratio, greatest(0, least(1, 1 - error / 0.15::DOUBLE)) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY error, rank) AS k FROM f WHERE n > 1) WHERE k = 1),
  z AS (SELECT page_id, count(*) AS steps FROM v GROUP BY page_id),
  r AS (SELECT z.page_id, steps, CASE WHEN steps < 3 OR name IS NULL THEN 'none' WHEN fit >= 0.5 THEN name ELSE 'irregular' END AS ratio_name, CASE WHEN steps >= 3 AND fit >= 0.5 THEN ratio END AS ratio, CASE WHEN steps >= 3 THEN coalesce(fit, 0) ELSE 0 END AS fit FROM z LEFT JOIN b USING (page_id)),
  h AS (SELECT x.page_id, x.value AS anchor, count(*) FILTER (abs(y.value - x.value * pow(ratio, floor(ln(y.value / x.value) / ln(ratio) + 0.5))) / (x.value * pow(ratio, floor(ln(y.value / x.value) / ln(ratio) + 0.5))) <= 0.05) AS hits
    FROM r JOIN v x USING (page_id) JOIN v y USING (page_id) WHERE ratio IS NOT NULL GROUP BY 1, 2),
  a AS (SELECT page_id, arg_max(anchor, (hits, -anchor)) AS anchor, max(hits) AS hits FROM h GROUP BY page_id)
  SELECT page_id, steps, ratio_name, ratio, floor(fit * 100 + 0.5) / 100 AS fit, coalesce(floor(hits / steps * 100 + 0.5) / 100, 0) AS coverage, anchor FROM r LEFT JOIN a USING (page_id)""")(
    lambda e: scales.type_ratio(usage.type_scale(e).select("page_id", F.col("size").alias("value")))
)
on_elements("lint_near_duplicates", f""", {_USES}, h AS (SELECT DISTINCT page_id, hex, ('0x' || hex[2:3])::INT AS r, ('0x' || hex[4:5])::INT AS g, ('0x' || hex[6:7])::INT AS b FROM uses)
  SELECT x.page_id, x.hex AS first, y.hex AS second, round(sqrt(pow(x.r - y.r, 2) + pow(x.g - y.g, 2) + pow(x.b - y.b, 2)), 4) AS distance FROM h x JOIN h y ON x.page_id = y.page_id AND x.hex < y.hex
  WHERE sqrt(pow(x.r - y.r, 2) + pow(x.g - y.g, 2) + pow(x.b - y.b, 2)) < 8""")(lambda e: scales.near_duplicate_colors(usage.color_usage(e).select("page_id", "hex")))
on_elements("color_clusters_rgb", f""", {_USES}, h AS (SELECT page_id, hex, count(*) AS uses, min(ord * 2 + (context = 'background')::INT) AS place, ('0x' || hex[2:3])::INT AS r, ('0x' || hex[4:5])::INT AS g, ('0x' || hex[6:7])::INT AS b FROM uses GROUP BY page_id, hex),
  l AS (SELECT page_id, list({{'r': r, 'g': g, 'b': b}} ORDER BY place) AS xs FROM h GROUP BY page_id),
  s AS (SELECT page_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: pow(y.r - x[1].r, 2) + pow(y.g - x[1].g, 2) + pow(y.b - x[1].b, 2) < 225)) > 0 THEN acc ELSE list_concat(acc, x) END) AS seeds FROM l),
  m AS (SELECT h.*, list_filter(seeds, lambda y: pow(y.r - h.r, 2) + pow(y.g - h.g, 2) + pow(y.b - h.b, 2) < 225)[1] AS seed FROM h JOIN s USING (page_id)),
  c AS (SELECT page_id, seed, arg_max(hex, (uses, -place)) AS hex, sum(uses)::BIGINT AS uses, count(*) AS members, min(place) AS first FROM m GROUP BY page_id, seed)
  SELECT page_id, hex, uses, members, row_number() OVER (PARTITION BY page_id ORDER BY uses DESC, first) AS rank FROM c""")(lambda e: scales.color_clusters(usage.color_usage(e)))

# --- labels ------------------------------------------------------------------------------------------------------------
_OWNER = "CASE WHEN tag = 'button' OR class_list LIKE 'btn%' THEN 'button' WHEN class_list = 'badge' THEN 'badge' WHEN class_list = 'nav-item' THEN 'navigation' WHEN class_list = 'card' THEN 'card' WHEN tag = 'div' THEN 'unknown' ELSE 'text' END"
_RAD = PX.format("radius")
_CORNER = f"CASE WHEN {_RAD} <= 2 THEN 'square' WHEN {_RAD} * 2 >= least(width, height) AND abs(width - height) <= 0.1 * greatest(width, height) THEN 'circle' WHEN {_RAD} * 2 >= least(width, height) THEN 'pill' ELSE 'rounded' END"
on_elements("geometry_votes", f""", w AS (SELECT page_id, {_OWNER} AS owner, {_CORNER} AS corner, round(sum(greatest(16, least(320, sqrt(area)))), 4) AS w FROM elements GROUP BY 1, 2, 3),
  s AS (SELECT page_id, owner, corner, round(w / sum(w) OVER (PARTITION BY page_id, owner), 4) AS share FROM w),
  b AS (SELECT *, coalesce(lead(share) OVER o, 0) AS next, row_number() OVER o AS n FROM s WINDOW o AS (PARTITION BY page_id, owner ORDER BY share DESC, corner))
  SELECT page_id, owner, CASE WHEN round(share - next, 4) < 0.15 THEN 'mixed' ELSE corner END AS corner, share, round(share - next, 4) AS margin FROM b WHERE n = 1""")(classify.geometry_votes)
_VISIBLE = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
query("tag_histogram", f"SELECT page_id, lower(t) AS tag, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all({_VISIBLE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY ALL")(
    lambda s, d: classify.tag_histogram(_table(s, d, "pages"))
)
_LINKS = f"""l AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (SELECT page_id, url, regexp_extract_all({_VISIBLE}, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages)),
  k AS (SELECT page_id, url, href, row_number() OVER (PARTITION BY page_id ORDER BY min(ord)) AS rank FROM l GROUP BY page_id, url, href)"""
query("page_links", f"WITH {_LINKS} SELECT page_id, url, rank, href FROM k WHERE rank <= 60")(lambda s, d: classify.page_links(_table(s, d, "pages")))
query("internal_links", f"""WITH {_LINKS}, t AS (SELECT page_id, rank, url, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS target FROM k WHERE rank <= 60)
  SELECT page_id, rank, target FROM t WHERE lower(regexp_extract(target, '://([^/?#]*)', 1)) = lower(regexp_extract(url, '://([^/?#]*)', 1)) AND NOT contains(href, '#') AND target <> url
  AND NOT regexp_matches(lower(href), '\\.(png|jpe?g|gif|svg|pdf|zip)$')""")(lambda s, d: classify.internal_links(classify.page_links(_table(s, d, "pages"))))
_PATH = "lower(CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END)"
query("page_intent", "SELECT page_id, host, path, CASE WHEN path = '/' THEN 'landing' " + " ".join(f"WHEN regexp_matches(path, '(^|/)({w})(/|\\.|$)') THEN '{n}'" for n, w in classify.INTENT)
      + f" ELSE 'unknown' END AS intent FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, {_PATH} AS path FROM pages)")(lambda s, d: classify.page_intent(_table(s, d, "pages")))
_REGION = " UNION ALL ".join(f"SELECT page_id, '{r}' AS region, unnest(regexp_extract_all({_VISIBLE}, '(?s)<{t}(?:\\s[^>]*)?>(.*?)</{t}>', 1)) AS block FROM pages" for t, r in (("nav", "nav"), ("article", "content"), ("footer", "footer"), ("header", "header"), ("aside", "sidebar")))
query("section_regions", f"WITH b AS ({_REGION}) SELECT page_id, region, count(*) AS sections, sum(length(trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))))::BIGINT AS chars FROM b GROUP BY ALL")(
    lambda s, d: classify.section_regions(_table(s, d, "pages"))
)
_MANY = lambda words: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words.split("|")) + ")))"
query("voice_tone", "SELECT doc_id AS id, " + ", ".join(f"{_MANY(w)} > 0 AS {n}" for n, w in classify.TONES.items()) + f""", CASE WHEN {_MANY("you|your|yours")} > {_MANY("we|our|us")} THEN 'you' WHEN {_MANY("we|our|us")} > {_MANY("you|your|yours")} THEN 'we' ELSE 'neutral' END AS posture,
  round(len(w) / greatest(len(regexp_extract_all(t, '[.!?]')), 1), 4) AS words_per_sentence FROM (SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents)""")(
    lambda s, d: classify.voice(_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))
)

# --- sites -------------------------------------------------------------------------------------------------------------
_SITE = f"site AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, page_id AS page, href AS value, 1 AS uses FROM (WITH {_LINKS} SELECT * FROM k))"
_COVER = f"""{_SITE}, n AS (SELECT site, count(DISTINCT page) AS total FROM site GROUP BY site), c AS (SELECT site, value, count(DISTINCT page) AS pages, any_value(total) AS total, sum(uses)::BIGINT AS uses FROM site JOIN n USING (site) GROUP BY site, value),
  cover AS (SELECT *, round(pages / total, 2) AS coverage, CASE WHEN pages / total >= 0.8 THEN 'site-wide' WHEN pages / total >= 0.4 THEN 'recurring' ELSE 'local' END AS scope FROM c)"""


def _site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = classify.all_links(_table(spark, sf_dir, "pages"))
    return links.select(T.host(F.col("url")).alias("site"), F.col("page_id").alias("page"), F.col("href").alias("value"), F.lit(1).alias("uses"))


query("site_coverage", f"WITH {_COVER} SELECT * FROM cover")(lambda s, d: compare.coverage(_site_links(s, d)))
query("site_consistency", f"WITH {_COVER} SELECT site, max(total) AS pages, CASE WHEN max(total) > 1 THEN round(sum(CASE WHEN scope = 'site-wide' THEN uses ELSE 0 END) / sum(uses), 4) END AS consistency FROM cover GROUP BY site")(
    lambda s, d: compare.consistency(compare.coverage(_site_links(s, d)))
)


def _page_colors(e: DataFrame) -> DataFrame:
    site = F.floor(F.col("page_id") / elements.SITE)
    return usage.color_usage(e).select(site.alias("site"), F.col("page_id").alias("page"), F.col("hex").alias("value"), "uses")


_PAGE_COLORS = f"{_USES}, pc AS (SELECT page_id // {elements.SITE} AS site, page_id AS page, hex AS value, count(*) AS uses FROM uses GROUP BY ALL)"
on_elements("site_outliers", f""", {_PAGE_COLORS}, n AS (SELECT site, count(DISTINCT page) AS total FROM pc GROUP BY 1), c AS (SELECT site, value, count(DISTINCT page) AS pages, sum(uses)::BIGINT AS uses FROM pc GROUP BY 1, 2)
  SELECT site, value, uses, rank FROM (SELECT site, value, uses, row_number() OVER (PARTITION BY site ORDER BY uses DESC, value) AS rank FROM c JOIN n USING (site) WHERE pages = 1 AND uses >= 2 AND pages / total < 0.8) WHERE rank <= 25""")(
    lambda e: compare.off_system(compare.coverage(_page_colors(e)))
)
on_elements("page_pair_jaccard", f""", {_PAGE_COLORS}, z AS (SELECT page, count(*) AS n FROM pc GROUP BY page)
  SELECT x.page AS a, y.page AS b, count(*) AS overlap, any_value(p.n) + any_value(q.n) - count(*) AS union_size, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS ratio
  FROM pc x JOIN pc y ON x.value = y.value AND x.site = y.site AND x.page < y.page JOIN z p ON p.page = x.page JOIN z q ON q.page = y.page GROUP BY 1, 2""")(lambda e: compare.pair_overlap(_page_colors(e)))
on_elements("shared_tokens", f", {_PAGE_COLORS} SELECT value, count(DISTINCT page) AS pages FROM pc GROUP BY value HAVING count(DISTINCT page) = (SELECT count(DISTINCT page) FROM pc)")(lambda e: compare.shared_values(_page_colors(e)))
on_elements("unique_tokens", f""", {_PAGE_COLORS}, o AS (SELECT value, min(page) AS page FROM pc GROUP BY value HAVING count(DISTINCT page) = 1)
  SELECT page, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY value) AS rank FROM o) WHERE rank <= 20""")(lambda e: compare.unique_values(_page_colors(e)))
on_elements("multiset_jaccard", f""", {_PAGE_COLORS}, s AS (SELECT site AS key, value, coalesce(sum(uses) FILTER (page % 2 = 0), 0) AS x, coalesce(sum(uses) FILTER (page % 2 = 1), 0) AS y FROM pc GROUP BY 1, 2)
  SELECT key, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS jaccard FROM s GROUP BY key""")(lambda e: compare.multiset_overlap(_page_colors(e).withColumnRenamed("site", "key"), F.col("page") % 2 == 0, F.col("page") % 2 == 1))


def _route_tokens(e: DataFrame, value: str = "radius") -> DataFrame:
    counts = e.groupBy(F.col("page_id").alias("route"), F.concat(F.col("tag"), F.lit("-"), F.col("font_weight")).alias("token"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return usage.first_per_key(counts, ["route", "token"], F.desc("n"), F.asc("value")).drop("n")


_ROUTE_SQL = """rt AS (SELECT route, token, value FROM (SELECT page_id AS route, tag || '-' || font_weight AS token, radius AS value, row_number() OVER (PARTITION BY page_id, tag || '-' || font_weight ORDER BY count(*) DESC, radius) AS k FROM elements GROUP BY 1, 2, 3) WHERE k = 1)"""
on_elements("route_reconcile", f""", {_ROUTE_SQL}, r4 AS (SELECT * FROM rt)
  SELECT token, count(DISTINCT route) AS routes, count(DISTINCT value) AS values, CASE WHEN count(DISTINCT value) = 1 AND count(DISTINCT route) = (SELECT count(DISTINCT route) FROM r4) THEN 'shared' WHEN count(DISTINCT route) = 1 THEN 'added' ELSE 'changed' END AS status
  FROM r4 GROUP BY token""")(lambda e: compare.reconcile_routes(_route_tokens(e)))
on_elements("profile_diff", f""", {_ROUTE_SQL}, a AS (SELECT (route // 2) || '/' || token AS key, value FROM rt WHERE route % 2 = 0), b AS (SELECT (route // 2) || '/' || token AS key, value FROM rt WHERE route % 2 = 1)
  SELECT coalesce(a.key, b.key) AS key, a.value AS a_value, b.value AS b_value, CASE WHEN b.key IS NULL THEN 'only-a' WHEN a.key IS NULL THEN 'only-b' WHEN a.value = b.value THEN 'shared' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.key = b.key""")(
    lambda e: compare.difference(
        *(_route_tokens(e).where(F.col("route") % 2 == side).select(F.concat_ws("/", F.floor(F.col("route") / 2).cast("string"), "token").alias("key"), "value") for side in (0, 1)),
    )
)
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
query("brand_matrix", "SELECT n_name AS property, " + ", ".join(f"round(sum(CASE WHEN c_mktsegment = '{x}' THEN c_acctbal END), 2) AS \"{x}\"" for x in _SEGMENTS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")(
    lambda s, d: compare.brand_matrix(_table(s, d, "customer").join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("property"), F.col("c_mktsegment").alias("brand"), F.col("c_acctbal").alias("value")), _SEGMENTS)
)


@query("system_score", f"""WITH {E_}, {_USES}, {_SPACING}, {_UNITS}, {_PAIRS}, {_CONTRAST_SCORE}, c AS (SELECT page_id, count(DISTINCT hex) AS colors, bool_or(context = 'background' AND {_ACTS}) AS main FROM uses GROUP BY 1),
  z AS (SELECT page_id, count(DISTINCT font_size) AS sizes, count(DISTINCT font_weight) AS weights, count(DISTINCT trim(split_part(font_family, ',', 1))) FILTER (font_family <> 'system-ui') AS families,
    count(DISTINCT CASE WHEN radius <> '0px' THEN radius END) AS radii, count(DISTINCT shadow_y) AS shadows FROM elements GROUP BY 1),
  x AS (SELECT page_id, unit, rank, count(*) AS n, count(*) FILTER (value % unit = 0) AS hit, round(avg(CASE WHEN value % unit = 0 THEN 1.0 ELSE 0.0 END) + CASE WHEN unit IN (4, 8) THEN 0.04::DOUBLE ELSE 0 END, 6) AS fit FROM v, u GROUP BY page_id, unit, rank),
  s AS (SELECT page_id, n AS spacings, n >= 3 AND fit >= 0.6 AS has_base, hit / n AS share FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY fit DESC, rank) AS k FROM x) WHERE k = 1),
  p AS (SELECT page_id, CASE WHEN colors <= 12 THEN 100 WHEN colors <= 25 THEN 92 WHEN colors <= 40 THEN 80 WHEN colors <= 60 THEN 65 WHEN colors <= 100 THEN 50 ELSE 35 END - CASE WHEN main THEN 0 ELSE 15 END AS color,
    least(CASE WHEN families <= 2 THEN 100 WHEN families <= 3 THEN 80 ELSE 50 END, CASE WHEN weights <= 3 THEN 100 WHEN weights <= 5 THEN 90 ELSE 80 END, CASE WHEN sizes <= 8 THEN 100 ELSE 92 END) AS typography,
    CASE WHEN NOT has_base THEN 55 WHEN share >= 0.8 THEN 100 WHEN share >= 0.6 THEN 85 ELSE 75 END - CASE WHEN spacings > 50 THEN 15 WHEN spacings > 35 THEN 5 ELSE 0 END AS spacing,
    CASE WHEN shadows = 0 THEN 85 WHEN shadows <= 5 THEN 100 WHEN shadows <= 10 THEN 90 ELSE 78 END AS shadow, CASE WHEN radii <= 4 THEN 100 WHEN radii <= 7 THEN 90 ELSE 80 END AS radius, score.score AS accessibility, 20 AS tokens
    FROM c JOIN z USING (page_id) JOIN s USING (page_id) JOIN score USING (page_id)),
  q AS (SELECT *, NULL::INT AS css, floor((color * 18 + typography * 18 + spacing * 18 + shadow * 9 + radius * 9 + accessibility * 15 + tokens * 5) / 92 + 0.5)::INT AS score FROM p)
  SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM q""")
def system_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows have no stylesheet and no variables; an interactive element's background stands for a primary colour."""
    e = elements.from_lineitem(spark, sf_dir)
    family = F.when(F.col("font_family") != "system-ui", F.trim(F.substring_index("font_family", ",", 1)))
    kinds = {"families": family, "weights": F.col("font_weight"), "sizes": F.col("font_size"), "radii": F.when(F.col("radius") != "0px", F.col("radius")), "shadows": F.when(F.col("shadow") != "none", F.col("shadow"))}
    # one pass: an element's texts of each kind, most of which its page has already
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), kind.alias("text")) for name, kind in kinds.items()))).alias("of")
    texts = e.select("page_id", each).select("page_id", "of.*").distinct()
    rows = texts.groupBy("page_id").agg(*(F.count(F.when(F.col("kind") == name, F.col("text"))).alias(name) for name in kinds))
    colors = usage.color_usage(e).groupBy("page_id").agg(F.count("*").alias("colors"), F.bool_or(F.col("interactive") > 0).alias("has_primary"))
    fit = scales.unit_fit(scales.spacing_values(e))
    spacings = fit.select("page_id", F.col("n_values").alias("spacings"), "on_base", F.col("base_unit").isNotNull().alias("has_base"))
    rows = rows.join(colors, "page_id").join(spacings, "page_id").join(usage.contrast_score(e).select("page_id", F.col("score").alias("contrast")), "page_id")
    return compare.system_score(rows.withColumn("variables", F.lit(0)).withColumns({name: F.lit(None).cast("int") for name in ("unused", "important", "duplicates")}))


# --- vectors -----------------------------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform(F.col("embedding").cast("array<double>"), lambda x: vectors.normalise(x, -1.0, 1.0))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", unit.alias("vector"))


_VEC = "vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: least(greatest((x::DOUBLE + 1) / 2, 0.0), 1.0)) AS vector FROM embeddings)"
query("vector_knn", f"""WITH {_VEC}, p AS (SELECT a.id AS query_id, b.id, round(list_reduce(list_transform(generate_series(1, len(a.vector)), lambda i: abs(a.vector[i] - b.vector[i])), lambda x, y: x + y) / len(a.vector), 6) AS distance FROM vec a, vec b WHERE a.id <> b.id)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 5""")(
    lambda s, d: vectors.neighbours(_vectors(s, d).select("id", "vector"))
)
_RANKS = f"""{_VEC}, f AS (SELECT id, unnest(vector) AS value, generate_subscripts(vector, 1) - 1 AS feature FROM vec), r AS (SELECT id, feature::INT AS feature,
  round((rank() OVER (PARTITION BY feature ORDER BY value) - 1 + count(*) OVER (PARTITION BY feature, value) / 2) / count(*) OVER (PARTITION BY feature), 6) AS percentile FROM f)"""
query("vector_percentiles", f"WITH {_RANKS} SELECT * FROM r")(lambda s, d: vectors.percentiles(_vectors(s, d).select("id", "vector")))
query("vector_outliers", f"""WITH {_RANKS}, o AS (SELECT *, round(abs(percentile - 0.5), 6) AS off, CASE WHEN percentile >= 0.9 THEN 'very high' WHEN percentile >= 0.7 THEN 'high' WHEN percentile >= 0.3 THEN 'typical' WHEN percentile >= 0.1 THEN 'low' ELSE 'very low' END AS band FROM r)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off DESC, feature) AS rank FROM o) WHERE rank <= 5""")(lambda s, d: vectors.outliers(vectors.percentiles(_vectors(s, d).select("id", "vector"))))

# --- history and streams -----------------------------------------------------------------------------------------------
_MS = lambda: F.unix_millis(F.col("ts").cast("timestamp"))
query("choreography", """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS delay FROM events), s AS (SELECT key, delay - lag(delay) OVER (PARTITION BY key ORDER BY delay) AS step FROM e), t AS (SELECT * FROM s WHERE step > 0),
  m AS (SELECT key, floor(quantile_cont(step::DOUBLE, 0.5) + 0.5)::BIGINT AS median FROM t GROUP BY key)
  SELECT key, median, count(*) AS steps, count(*) FILTER (abs(step - median) <= greatest(20, median * 0.5)) AS regular FROM t JOIN m USING (key) GROUP BY key, median""")(
    lambda s, d: compare.stagger(_table(s, d, "events").select(F.col("user_id").alias("key"), _MS().alias("delay")))
)


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


query("snapshot_changes", """SELECT key, seq, before, value FROM (SELECT user_id AS key, event_id AS seq, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> value""")(
    lambda s, d: history.changes(_snapshots(s, d))
)
query("history_retention", """SELECT user_id AS key, ts, event_id AS seq, event_type AS value, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 5""")(
    lambda s, d: history.retained(_snapshots(s, d), 5)
)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream takes folders and patterns but no single file
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def _folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and state."""
    return f"{storage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_watch", "SELECT key, seq, before, value FROM (SELECT user_id AS key, event_id AS seq, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before <> value")
def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return watch.drained(watch.watch(rows), "watch", _folder(spark))


@query("stream_rate_limit")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), _MS().alias("ms"))
    return watch.drained(watch.rate_limit(rows, 3, 3_600_000), "limit", _folder(spark))


@query("token_resolve", """WITH RECURSIVE t AS (SELECT 't' || event_id AS path, CASE WHEN event_id % 4 = 0 THEN 'v' || event_id ELSE '{t' || (event_id // 2) || '}' END AS value FROM events),
  c AS (SELECT path, value, 0 AS hops FROM t UNION ALL SELECT c.path, t.value, hops + 1 FROM c JOIN t ON c.value = '{' || t.path || '}'),
  e AS (SELECT path, value AS resolved, hops FROM c WHERE value NOT LIKE '{%') SELECT t.path, e.resolved, e.hops FROM t LEFT JOIN e ON t.path = e.path""")
def token_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    value = F.when(n % 4 == 0, F.concat(F.lit("v"), n.cast("string"))).otherwise(F.concat(F.lit("{t"), F.floor(n / 2).cast("string"), F.lit("}")))
    return history.resolve_references(_table(spark, sf_dir, "events").select(F.concat(F.lit("t"), n.cast("string")).alias("path"), value.alias("value")))


# --- what Spark brings along -------------------------------------------------------------------------------------------
query("n_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(
    lambda s, d: _table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
)
query("n_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda s, d: _table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
query("n_tumbling_window", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: _table(s, d, "events").groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
)
query("n_running_frame", """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
  ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders""")(
    lambda s, d: _table(s, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("quarter"))
)
query("n_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")(
    lambda s, d: (lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit(True).alias("buys")).union(c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", F.lit(False).alias("buys"))))(_table(s, d, "customer"), _table(s, d, "orders"))
)


# --- stylesheets and tokens --------------------------------------------------------------------------------------------
def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").withColumn("p", F.col("p_partkey"))


_WIDTHS = f"[{', '.join(f"{{'w': {w}, 'n': '{n}'}}" for w, n in tokens.STANDARD.items())}]"
query("breakpoints", f"""WITH q AS (SELECT p_partkey % 10 AS page_id, p_partkey AS ord, p_partkey % 3 = 0 AS upper, p_partkey % 4 = 1 AS both_, CASE WHEN p_partkey % 2 = 0 THEN p_size * 32.5::DOUBLE ELSE p_size * 16.0::DOUBLE END AS px FROM part),
  k AS (SELECT page_id, ord, CASE WHEN upper THEN 1 ELSE 0 END AS turn, px FROM q UNION ALL SELECT page_id, ord, 1, px + 100.0 FROM q WHERE both_ AND NOT upper),
  l AS (SELECT page_id, floor(px + 0.5)::BIGINT AS px, CASE arg_max(turn, (ord, turn)) WHEN 1 THEN 'max-width' ELSE 'min-width' END AS kind FROM k GROUP BY 1, 2),
  n AS (SELECT *, list_sort(list_transform(list_filter({_WIDTHS}, lambda x: abs(px - x.w) <= 64), lambda x: {{'off': abs(px - x.w), 'w': x.w, 'n': x.n}}))[1].n AS near FROM l)
  SELECT page_id, px, kind, coalesce(near, px || 'px') AS label FROM n""")(
    lambda s, d: tokens.breakpoints(_parts(s, d).selectExpr("p % 10 AS page_id", "p AS ord", """concat('screen and (', if(p % 3 = 0, 'max', 'min'), '-width: ', if(p % 2 = 0, concat(p_size * 32.5, 'px'), concat(p_size, 'em')), ')',
        if(p % 4 = 1 AND p % 3 != 0, concat(' and (max-width: ', p_size * 16 + 100, 'px)'), '')) AS query"""))
)
_SHEET = "'.a' || p_size || ' p{color:red!important;margin:0} #x' || p_size || '{-webkit-box-shadow:none;margin:0' || CASE WHEN p_size % 2 = 0 THEN ';margin:0' ELSE '' END || '} div > p{top:' || p_size || 'px}'"
query("css_health", "SELECT p_partkey AS id, 3 AS rules, 1 AS important, 1 AS vendor, 100 AS max_specificity, round((11 + 100 + 2) / 3, 4) AS mean_specificity, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS repeated FROM part")(
    lambda s, d: tokens.css_health(_parts(s, d).select(F.col("p").alias("id"), F.expr(_SHEET).alias("text")))
)
_NAMES = ["--Color-Primary", "--space-2", "--font-body", "--radius-lg", "--shadow-1", "--duration-fast", "--z-top", "--bg-Success", "--text-danger", "--line-height-info", "--border-radius"]
_FITS = lambda words: "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{w}') THEN '{n}'" for n, w in words.items())
query("variable_categories", f"""WITH v AS (SELECT p_partkey AS page_id, {_NAMES}[p_partkey % {len(_NAMES)} + 1] || '-' || lower(split_part(p_name, ' ', 1)) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'calc(var(--b) + var(--a) + var(--b))' ELSE '1px' END AS value FROM part)
  SELECT page_id, name, {_FITS(tokens.CATEGORIES)} ELSE 'other' END AS category, {_FITS(tokens.STATES)} END AS state, array_to_string(regexp_extract_all(value, 'var\\((--[a-zA-Z0-9_-]+)', 1), ',') AS refers_to FROM v""")(
    lambda s, d: tokens.variable_categories(
        _parts(s, d).select(F.col("p").alias("page_id"), F.concat_ws("-", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p") % len(_NAMES) + 1).cast("int")), F.lower(F.substring_index("p_name", " ", 1))).alias("name"), F.when(F.col("p") % 2 == 0, "calc(var(--b) + var(--a) + var(--b))").otherwise("1px").alias("value"))
    )
)
query("slug_suffixes", """WITH s AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS k FROM s)
  SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n""")(lambda s, d: tokens.slugs(_parts(s, d).select(F.col("p").alias("id"), F.col("p_type").alias("name"))))
on_elements("elevation_levels", """, w AS (SELECT page_id, (shadow_y * 5)::DOUBLE AS weight, count(*) AS uses FROM elements WHERE shadow_y IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT page_id, list_sort(list(weight)) AS xs FROM w GROUP BY page_id), f AS (SELECT page_id, list_reduce(list_transform(xs, lambda y: [y]), lambda acc, y: CASE WHEN y[1] <= acc[-1] * 1.25 + 1 THEN acc ELSE list_concat(acc, y) END) AS firsts FROM x),
  l AS (SELECT w.*, len(list_filter(firsts, lambda y: y <= weight))::INT AS level FROM w JOIN f USING (page_id))
  SELECT page_id, level, arg_max(weight, (uses, -weight)) AS weight, sum(uses)::BIGINT AS uses FROM l GROUP BY page_id, level""")(
    lambda e: tokens.elevation(usage.shadow_usage(e).select("page_id", (F.col("blur") * 1.25).alias("weight"), "uses"))
)
def _scores(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Pairs of neighbouring nations with a score for each value of ``by``."""
    x = _table(spark, sf_dir, "customer").groupBy(*by, F.col("c_nationkey").alias("a")).agg((F.round(F.avg("c_acctbal") / 100, 4)).alias("a_score"))
    y = x.select(*by, (F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("a_score").alias("b_score"))
    return x.join(y, [*by, "a"]).select(*(F.col(c).alias("dimension") for c in by), "a", "b", "a_score", "b_score")


query("head_to_head", """WITH s AS (SELECT c_mktsegment AS dimension, c_nationkey AS site, round(avg(c_acctbal) / 100, 4) AS score FROM customer GROUP BY 1, 2), o AS (SELECT c_nationkey AS site, round(avg(c_acctbal) / 100, 4) AS score FROM customer GROUP BY 1),
  d AS (SELECT x.site AS a, y.site AS b, floor(x.score - y.score + 0.5) AS d FROM s x JOIN s y ON x.dimension = y.dimension AND y.site = x.site + 1),
  w AS (SELECT a, b, count(*) FILTER (d >= 3) AS a_wins, count(*) FILTER (d <= -3) AS b_wins, count(*) AS n FROM d GROUP BY a, b)
  SELECT a, b, a_wins, b_wins, n - a_wins - b_wins AS ties, CASE WHEN x.score - y.score >= 3 THEN 'a' WHEN x.score - y.score <= -3 THEN 'b' ELSE 'tie' END AS verdict FROM w JOIN o x ON x.site = a JOIN o y ON y.site = b""")(
    lambda s, d: tokens.head_to_head(_scores(s, d, "c_mktsegment"), _scores(s, d))
)
query("token_flatten", "SELECT event_id AS id, k AS path, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")(
    lambda s, d: tokens.flat_tokens(_table(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json")))
)
