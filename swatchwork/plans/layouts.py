"""Queries over the bands of pages, bound to orders, and what appears in them, bound to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.operators import blueprint as B
from swatchwork.operators import fidelity
from swatchwork.plans.catalog import E_, _table, query
from swatchwork.plans.readers import _expressions
from swatchwork.plans.systems import _FAMILY, oklab_sql, page_profiles
from swatchwork.sources import elements
from swatchwork.sources.storage import stored

#: Twelve orders are a page; their numbers give the geometry, their priority some of the words. Divisions are of whole numbers.
_BANDS = """{page} AS page_id, CAST(o_orderkey % 12 AS INT) AS ord, CASE o_custkey % 8 WHEN 1 THEN 'header' WHEN 2 THEN 'nav' WHEN 3 THEN 'footer' WHEN 4 THEN 'div' ELSE 'section' END AS tag,
  CASE WHEN o_custkey % 29 = 0 THEN 'navigation' ELSE '' END AS role, CASE o_custkey % 13 WHEN 0 THEN 'fixed' WHEN 1 THEN 'absolute' WHEN 2 THEN 'sticky' ELSE 'static' END AS position,
  CASE o_orderkey % 11 WHEN 0 THEN 'Hero-main' WHEN 1 THEN 'feature-grid' WHEN 2 THEN 'logo-wall' WHEN 3 THEN 'stats' WHEN 4 THEN 'bento' WHEN 5 THEN 'quote' WHEN 6 THEN 'slider' ELSE '' END AS class_name, CASE WHEN o_orderkey % 17 = 0 THEN 'FAQ' ELSE '' END AS id,
  CAST(o_custkey % 3 * 10 AS DOUBLE) AS x, CAST(o_orderkey % 12 * 400 + o_custkey % 7 * 30 - o_custkey % 5 * 300 AS DOUBLE) AS y, CAST(1280 - o_custkey % 5 * 200 AS DOUBLE) AS w,
  CAST(CASE WHEN o_orderkey % 61 = 0 THEN 5200 WHEN o_orderkey % 37 = 0 THEN 1500 ELSE CAST(floor(o_totalprice) AS BIGINT) % 9 * 150 + 60 END AS DOUBLE) AS h,
  CASE o_orderkey % 13 WHEN 0 THEN 'Get started now' WHEN 1 THEN 'up 50% in ' || o_orderpriority WHEN 2 THEN 'frequently asked by all' WHEN 3 THEN 'Step 1 is this' WHEN 4 THEN 'free vs paid' WHEN 5 THEN 'from $9 per month' WHEN 6 THEN 'says the CEO' WHEN 7 THEN 'Trusted by many' WHEN 8 THEN 'Why this' ELSE o_orderpriority END AS text,
  CASE WHEN o_orderkey % 4 = 0 THEN 'A heading' END AS heading, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 6 * 12 AS DOUBLE) END AS heading_size, CASE WHEN o_custkey % 3 = 0 THEN 'image' ELSE 'none' END AS media_kind, CAST(o_custkey % 11 AS DOUBLE) / 20 AS media_share,
  CAST(o_orderkey % 3 AS INT) AS button_count, CAST(o_custkey % 7 AS INT) AS card_count, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 7 AS INT) END AS repeats, CAST(o_orderkey % 4 AS INT) AS repeats_with_button, CASE WHEN {page} % 5 = 0 THEN 'blog' ELSE 'docs' END AS page_type"""
_SEEN = """event_id % {pages} AS page_id, event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN 'load' ELSE 'scroll' END AS trigger, CASE WHEN event_id % 19 <> 0 THEN CAST(CAST(floor(value * 100) AS BIGINT) % 5600 AS DOUBLE) END AS top,
  CASE WHEN event_id % 5 = 0 THEN 'unpinned' ELSE 'fade' END AS name, CAST(event_id % 9 * 100 AS DOUBLE) AS duration, CASE WHEN event_id % 3 = 0 THEN 'ease' END AS easing"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bands = _table(spark, sf_dir, "orders").selectExpr(*_expressions(_BANDS.format(page="floor(o_orderkey / 12)")))
    properties = F.when(F.col("ord") % 4 == 0, F.array(F.lit("transform"))).when(F.col("ord") % 4 == 1, F.array(F.lit("opacity"), F.lit("transform"))).when(F.col("ord") % 4 == 2, F.array(F.lit("color")))
    return bands, _table(spark, sf_dir, "events").selectExpr(*_expressions(_SEEN.format(pages=1000))).withColumn("properties", properties)


_CASES = lambda c, then: f"regexp_matches({c}, '{then}')"
_Q = lambda p: p.replace("'", "''")
_TEXT = lambda p: f"regexp_matches(text, '(?i){_Q(p)}')"
_BLOB = lambda k: f"regexp_matches(blob, '{B.BLOBS[k]}')"
_ROLE_RULES = [
    ("tag = 'footer'", "footer", 0.95),
    ("nav", "nav", 0.9),
    ("hero", "hero", 0.9),
    (f"{_BLOB('logo')} OR (card_count >= 5 AND length(text) < 300 AND {_TEXT(B.LOGOS)})", "logo-wall", 0.85),
    ("contains(blob, 'bento')", "bento", 0.75),
    (_BLOB("gallery"), "gallery", 0.7),
    (f"{_BLOB('stats')} AND {_TEXT(B.STATS)}", "stats", 0.85),
    (f"{_TEXT(B.FAQ)} OR {_BLOB('faq')}", "faq", 0.85),
    (f"{_TEXT(B.STEPS)} AND card_count >= 3", "steps", 0.75),
    (f"{_TEXT(B.COMPARE)} AND card_count >= 2", "comparison", 0.7),
    (f"{_TEXT(B.PRICING)} AND card_count >= 2", "pricing-table", 0.9),
    ("repeats >= 4 AND repeats_with_button >= repeats * 0.5", "feature-grid", 0.85),
    (f"{_TEXT(B.TESTIMONIAL)} OR {_BLOB('testimonial')}", "testimonial", 0.8),
    ("contains(blob, 'hero') OR (heading IS NOT NULL AND button_count >= 1 AND h > 300 AND y < 400)", "hero", 0.85),
    (f"card_count >= 3 AND ({_TEXT(B.FEATURES)} OR {_BLOB('features')})", "feature-grid", 0.8),
    (f"{_TEXT(B.CTA)} AND button_count >= 1 AND length(text) < 600", "cta", 0.75),
    ("page_type = 'blog' AND card_count >= 3", "blog-grid", 0.75),
]
_CASE = lambda which: "CASE " + " ".join(f"WHEN {rule} THEN {role!r}" if which == "role" else f"WHEN {rule} THEN {sure}::DOUBLE" for rule, role, sure in _ROLE_RULES) + (" ELSE 'content' END" if which == "role" else " ELSE 0.3::DOUBLE END")
_BLUEPRINT = f"""WITH b0 AS (SELECT {_BANDS.format(page="(o_orderkey // 12)")} FROM orders), b1 AS (SELECT *, max(y + h) OVER (PARTITION BY page_id) AS ph, lower(class_name || ' ' || id) AS blob,
    (tag IN ('nav', 'header') OR role IN ('navigation', 'banner')) AND (y <= {B.NAV_TOP} OR position IN ('fixed', 'sticky')) AS nav FROM b0),
  wr AS (SELECT page_id, ord FROM b1 o WHERE ph > 0 AND h > ph * {B.OVERSIZED} AND (h > {800 * B.WRAPPER} OR EXISTS (SELECT 1 FROM b1 i WHERE i.page_id = o.page_id AND i.ord <> o.ord AND i.position = 'static' AND NOT i.nav AND i.y >= o.y AND i.y + i.h <= o.y + o.h))),
  kp AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, ord) - 1 AS idx, coalesce((SELECT count(*) FROM wr WHERE wr.page_id = b1.page_id), 0) AS dropped FROM b1 WHERE (page_id, ord) NOT IN (SELECT (page_id, ord) FROM wr)),
  he AS (SELECT *, coalesce(idx = min(idx) FILTER (y <= {800 * B.HERO_WITHIN} AND NOT nav AND NOT (position = 'fixed' AND y = 0 AND media_kind = 'none' AND heading IS NULL) AND (media_share >= {B.HERO_MEDIA} OR coalesce(heading_size, 0) >= {B.HERO_HEADING})) OVER (PARTITION BY page_id), false) AS hero FROM kp),
  ov AS (SELECT page_id, ord FROM he i WHERE NOT hero AND (position IN ('fixed', 'absolute') OR EXISTS (SELECT 1 FROM he o WHERE o.page_id = i.page_id AND o.idx < i.idx AND i.x >= o.x - {B.OVERLAY} AND i.y >= o.y - {B.OVERLAY} AND i.x + i.w <= o.x + o.w + {B.OVERLAY} AND i.y + i.h <= o.y + o.h + {B.OVERLAY}))),
  sn AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 'parallax' WHEN contains(name, 'pin') THEN 'pin' WHEN ord % 4 = 1 THEN 'reveal' END AS reveal FROM (SELECT {_SEEN.format(pages=1000)} FROM events) WHERE trigger = 'scroll' AND top IS NOT NULL),
  rv AS (SELECT he.page_id, he.ord, arg_min({{'reveal': reveal, 'duration': duration, 'easing': coalesce(easing, 'linear')}}, sn.ord) AS r FROM he JOIN sn ON sn.page_id = he.page_id AND reveal IS NOT NULL AND top >= y AND top < y + h GROUP BY ALL),
  bp AS (SELECT he.page_id, idx::INT AS index, he.ord, {_CASE("role")} AS role, {_CASE("confidence")} AS confidence, hero, ov.ord IS NOT NULL AS overlay, r.reveal AS reveal, r.duration AS duration, r.easing AS easing, dropped::BIGINT AS dropped
    FROM he LEFT JOIN ov ON ov.page_id = he.page_id AND ov.ord = he.ord LEFT JOIN rv ON rv.page_id = he.page_id AND rv.ord = he.ord)"""
_SHOWN = "page_id index ord role confidence hero overlay reveal duration easing dropped".split()
query("blueprint", f"{_BLUEPRINT} SELECT {', '.join(_SHOWN)} FROM bp")(lambda s, d: B.blueprint(*_frames(s, d)).select(_SHOWN))
query("blueprint_outline", f"{_BLUEPRINT} SELECT page_id, count(*) AS bands, max(dropped) AS dropped, coalesce(min(index) FILTER (role = 'hero'), -1) AS hero_index, string_agg(role, ' > ' ORDER BY index) AS reading_order FROM bp GROUP BY page_id")(lambda s, d: B.outline(B.blueprint(*_frames(s, d))))


# --- fidelity: each page of an even number is an original, the next one is held against it ------------------------------
_MOVES = """CASE page_id % 3 WHEN 0 THEN {a}'fade', 'slide'{b} WHEN 1 THEN {a}'fade'{b} ELSE {a}'spin', 'fade', 'fade'{b} END AS kinds, CASE WHEN page_id % 4 <> 0 THEN {a}CAST(page_id % 5 * 20 AS DOUBLE){b} END AS staggers,
  CASE page_id % 5 WHEN 0 THEN 'springy' WHEN 1 THEN 'responsive' WHEN 2 THEN 'smooth' WHEN 3 THEN 'mechanical' END AS feel, CASE WHEN page_id % 2 = 1 THEN page_id % 4 = 1 END AS scroll_linked"""


def _motion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_profiles(elements.from_lineitem(spark, sf_dir)).withColumn("durations", F.filter("durations", lambda x: x / 100 > F.col("page_id") % 3))
    told = e.selectExpr("page_id", "durations", "easings", "CAST(size(springs) AS BIGINT) AS springs", *_expressions(_MOVES.format(a="array(", b=")")))
    told = stored(told.select("page_id", F.struct("feel", "durations", "easings", "springs", "kinds", "scroll_linked", "staggers").alias("m")))
    return told.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), F.col("m").alias("original")).join(told.where("page_id % 2 = 1").select((F.col("page_id") - 1).alias("id"), F.col("m").alias("rebuilt")), "id")


_NEAR = "[" + ", ".join(f"'{a}>{b}'" for a, others in fidelity.NEIGHBOURS.items() for b in others) + "]"
_PARITY = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} THEN 0 ELSE {fidelity.INVENTED}::DOUBLE END"
_BAG = lambda f: f"list_sum(list_transform(list_distinct(list_concat(o.kinds, r.kinds)), lambda n: {f}(len(list_filter(o.kinds, lambda x: x = n)), len(list_filter(r.kinds, lambda x: x = n)))))"
_SHARE = lambda s: f"coalesce(list_sum(list_transform(list_filter({s}.easings, lambda x: x.family = n), lambda x: x.n)), 0) / {s}.total"
_MOTION_SQL = f"""WITH {E_}, f0 AS (SELECT page_id, {_FAMILY} AS family, count(*)::DOUBLE AS n FROM elements GROUP BY 1, 2), f1 AS (SELECT page_id, list({{'family': family, 'n': n}}) AS easings, sum(n) AS total, bool_or(family = 'spring') AS springs FROM f0 GROUP BY page_id),
  d1 AS (SELECT page_id, coalesce(list(DISTINCT duration::DOUBLE) FILTER (duration / 100 > page_id % 3), []) AS durations FROM elements GROUP BY page_id),
  mo AS (SELECT *, {_MOVES.format(a="[", b="]")} FROM f1 JOIN d1 USING (page_id)),
  sc AS (SELECT o.page_id AS id, [CASE WHEN coalesce(o.feel, 'mixed') = coalesce(r.feel, 'mixed') THEN 1.0::DOUBLE WHEN list_contains({_NEAR}, coalesce(o.feel, 'mixed') || '>' || coalesce(r.feel, 'mixed')) THEN 0.5 ELSE 0 END,
    CASE WHEN len(o.durations) = 0 AND len(r.durations) = 0 THEN 1.0::DOUBLE WHEN len(o.durations) = 0 THEN {fidelity.INVENTED_TIMING}::DOUBLE WHEN len(r.durations) = 0 THEN 0 ELSE list_avg(list_transform(o.durations, lambda m: greatest(0, 1 - list_min(list_transform(r.durations, lambda x: abs(x - m))) / (greatest(40, m * 0.25::DOUBLE) * 4)))) END,
    1 - list_sum(list_transform(['linear', 'spring', 'custom', 'ease-in-out'], lambda n: abs({_SHARE("o")} - {_SHARE("r")}))) / 2, {_PARITY("o.springs", "r.springs")}, {_BAG("least")} / {_BAG("greatest")},
    {_PARITY("coalesce(o.scroll_linked, false)", "coalesce(r.scroll_linked, false)")},
    CASE WHEN o.staggers IS NOT NULL AND r.staggers IS NOT NULL THEN greatest(0, 1 - abs(o.staggers[1] - r.staggers[1]) / (greatest(20, o.staggers[1] * 0.4::DOUBLE) * 4)) ELSE {_PARITY("(o.staggers IS NOT NULL)", "(r.staggers IS NOT NULL)")} END] AS s
    FROM mo o JOIN mo r ON r.page_id = o.page_id + 1 WHERE o.page_id % 2 = 0)"""
_W = "[" + ", ".join(f"{w}::DOUBLE" for w in fidelity.WEIGHTS.values()) + "]"
query("motion_fidelity", f"""{_MOTION_SQL} SELECT id, floor(round(100 * list_sum(list_transform(range(1, 8), lambda k: s[k] * {_W}[k])) / {sum(fidelity.WEIGHTS.values())}::DOUBLE, 9) + 0.5)::INT AS score, {", ".join(f"round(s[{k + 1}], 6) AS {name}" for k, name in enumerate(fidelity.WEIGHTS))} FROM sc""")(
    lambda s, d: fidelity.motion_fidelity(_motion_pairs(s, d)).select("id", "score", *(F.round(F.get("aspects", F.lit(k))["score"], 6).alias(name) for k, name in enumerate(fidelity.WEIGHTS)))
)
query("correction_plan", f"""{_MOTION_SQL}, g AS (SELECT id, k, {list(fidelity.WEIGHTS)}[k] AS aspect, round(round({_W}[k] * (1 - s[k]), 9), 2) AS gain FROM sc, (SELECT unnest(range(1, 8)) AS k) WHERE s[k] < {fidelity.MEND})
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY gain DESC, k)::INT AS rank, aspect, gain, CASE WHEN gain >= {fidelity.HIGH} THEN 'high' WHEN gain >= {fidelity.MEDIUM} THEN 'medium' ELSE 'low' END AS priority FROM g""")(lambda s, d: fidelity.correction_plan(fidelity.motion_fidelity(_motion_pairs(s, d))))
#: Grey backgrounds, pictures, columns: what the bands of orders say beside their geometry.
_LOOK = "ord % 7 = 3 AS video, CASE WHEN ord % 5 = 2 THEN 'p.png' ELSE '' END AS image, CASE WHEN (page_id + ord) % 6 <> 0 THEN CASE (page_id * 7 + ord * 31) % 4 WHEN 0 THEN '#404040' WHEN 1 THEN '#4c4c4c' WHEN 2 THEN '#585858' ELSE '#f0f0f0' END END AS color, CAST((page_id + ord * 3) % 3 AS INT) AS columns"


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands, seen = _frames(spark, sf_dir)
    rows = B.blueprint(bands, seen).join(bands.select("page_id", "ord", "media_kind", "h"), ["page_id", "ord"])
    return stored(rows.selectExpr("page_id", "index AS place", "overlay", "role", *_expressions(_LOOK), "media_kind AS media", "h"))


@query("blueprint_fidelity", f"""{_BLUEPRINT}, lk AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY index) AS i, bp.role AS role, media_kind, h, {_LOOK} FROM bp JOIN b0 USING (page_id, ord) WHERE NOT overlay),
  cl AS (SELECT color, ol FROM {oklab_sql("(SELECT * FROM (VALUES ('#404040'), ('#4c4c4c'), ('#585858'), ('#f0f0f0')) t(color))", "color")}),
  sd AS (SELECT lk.*, ol FROM lk LEFT JOIN cl USING (color)),
  pr AS (SELECT coalesce(o.page_id, r.page_id - 1) AS id, o.page_id IS NOT NULL AND r.page_id IS NOT NULL AS met, (o.role = r.role)::INT + CASE WHEN o.video OR r.video THEN o.video AND r.video WHEN o.image <> '' OR r.image <> '' THEN o.image <> '' AND r.image <> '' WHEN o.color IS NULL OR r.color IS NULL THEN o.color IS NULL AND r.color IS NULL ELSE abs(o.ol - r.ol) <= {fidelity.COLOR_NEAR} END::INT
    + (greatest(o.columns, 1) = greatest(r.columns, 1))::INT + (o.media_kind = r.media_kind)::INT + (abs(o.h - r.h) / greatest(o.h, r.h) <= {fidelity.HEIGHT_NEAR})::INT AS hits
    FROM (SELECT * FROM sd WHERE page_id % 2 = 0) o FULL JOIN (SELECT * FROM sd WHERE page_id % 2 = 1) r ON r.page_id = o.page_id + 1 AND r.i = o.i)
SELECT id, floor(100 * coalesce(sum(hits) FILTER (met), 0) / (count(*) * {fidelity.CHECKS}) + 0.5)::INT AS score, coalesce(sum(hits) FILTER (met), 0)::BIGINT AS matched, count(*) * {fidelity.CHECKS} AS total, count(*) FILTER (met) AS aligned, count(*) FILTER (NOT met) AS unmatched, count(*) FILTER (NOT met) > 0 AS drift FROM pr GROUP BY id""")
def blueprint_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bands(spark, sf_dir)
    own = ["place", "overlay", "role", "color", "image", "video", "columns", "media", "h"]
    sides = [rows.where(F.col("page_id") % 2 == k).select((F.col("page_id") - k).alias("id"), *own) for k in (0, 1)]
    return fidelity.blueprint_fidelity(*sides)
