"""Queries over palettes around another primary, light and dark sides, and motion seen while pages run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.operators import themes, usage
from swatchwork.plans.catalog import _USES, BG, E_, FG, HEX, _table, query
from swatchwork.plans.readers import _expressions
from swatchwork.plans.systems import _ENC, oklab_sql
from swatchwork.sources import elements
from swatchwork.sources.storage import stored

TARGET = "#ff4800"
_HUE = "CASE WHEN degrees(atan2(ob, oa)) < 0 THEN degrees(atan2(ob, oa)) + 360 ELSE degrees(atan2(ob, oa)) END"
_TURN = f"""h AS (SELECT page_id, hex, count(*) AS uses, min(ord * 2 + (context = 'background')::INT) AS place FROM uses GROUP BY ALL),
  k AS (SELECT hex, ol, sqrt(oa * oa + ob * ob) AS c, {_HUE} AS hue FROM {oklab_sql("(SELECT DISTINCT hex FROM h)", "hex")}),
  tg AS (SELECT {_HUE} AS hue FROM {oklab_sql(f"(SELECT '{TARGET}' AS hex)", "hex")}),
  so AS (SELECT page_id, hex AS source, d AS shift FROM (SELECT page_id, hex, CASE WHEN tg.hue - k.hue > 180 THEN tg.hue - k.hue - 360 WHEN tg.hue - k.hue < -180 THEN tg.hue - k.hue + 360 ELSE tg.hue - k.hue END AS d,
    row_number() OVER (PARTITION BY page_id ORDER BY c < {themes.NEUTRAL}, CASE WHEN c < {themes.NEUTRAL} THEN 0 ELSE -uses END, place, hex) AS i FROM h JOIN k USING (hex), tg) WHERE i = 1),
  t AS (SELECT page_id, hex, source, shift, ol AS l, c, CASE WHEN hue + shift < 0 THEN hue + shift + 360 WHEN hue + shift >= 360 THEN hue + shift - 360 ELSE hue + shift END AS hue FROM h JOIN so USING (page_id) JOIN k USING (hex)),
  x AS (SELECT *, c * cos(radians(hue)) AS a, c * sin(radians(hue)) AS b FROM t),
  y AS (SELECT *, pow(l + 0.3963377774::DOUBLE * a + 0.2158037573::DOUBLE * b, 3) AS cl, pow(l - 0.1055613458::DOUBLE * a - 0.0638541728::DOUBLE * b, 3) AS cm, pow(l - 0.0894841775::DOUBLE * a - 1.2914855480::DOUBLE * b, 3) AS cs FROM x),
  z AS (SELECT *, 4.0767416621::DOUBLE * cl - 3.3077115913::DOUBLE * cm + 0.2309699292::DOUBLE * cs AS r, -1.2684380046::DOUBLE * cl + 2.6097574011::DOUBLE * cm - 0.3413193965::DOUBLE * cs AS g, -0.0041960863::DOUBLE * cl - 0.7034186147::DOUBLE * cm + 1.7076147010::DOUBLE * cs AS bb FROM y)"""


@query("recoloured_palette", f"WITH {E_}, {_USES}, {_TURN} SELECT page_id, hex, CASE WHEN hex = source THEN '{TARGET}' WHEN c < {themes.NEUTRAL} THEN hex ELSE '#' || {_ENC('r')} || {_ENC('g')} || {_ENC('bb')} END AS new_hex, hex = source AS pinned, source, round(shift, 2) AS hue_shift FROM z")
def recoloured_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = usage.color_usage(elements.from_lineitem(spark, sf_dir)).select("page_id", "hex", "uses", F.col("first_place").alias("place"))
    return themes.recoloured(stored(used), TARGET)


# --- light and dark: every page but one of four has a dark side; there elements of even width have their colours inverted
_DARK = "page_id % 4 <> 0"
_NAME = "concat('--', tag, '-', CAST(height AS STRING))"
_SIDES = f"""{E_}, li AS (SELECT page_id, ord, area, tag, height, {FG} AS fg, {BG} AS back FROM elements),
  da AS (SELECT page_id, ord, area, tag, height, CASE WHEN width % 2 = 0 THEN {HEX.format("255 - r", "255 - g", "255 - b")} ELSE {FG} END AS fg, CASE WHEN width % 2 = 0 THEN {HEX.format("255 - br", "255 - bg", "255 - bb")} ELSE {BG} END AS back FROM elements WHERE {_DARK})"""
_ROLES = lambda t: f"""SELECT page_id, 'background' AS role, arg_min(back, (ord, back)) AS hex FROM {t} WHERE area > 50000 GROUP BY page_id
  UNION ALL SELECT page_id, 'text', arg_min(fg, (ord, fg)) FROM {t} GROUP BY page_id UNION ALL SELECT page_id, 'primary', arg_min(back, (ord, back)) FROM {t} WHERE tag = 'button' GROUP BY page_id"""  # noqa: E731
_VARS = lambda t, where: f"SELECT page_id, '--' || tag || '-' || height AS name, arg_max(back, (ord, back)) AS value FROM {t} WHERE {where} GROUP BY ALL"
_THEME_VARS = f"lv AS ({_VARS('li', 'height <> 64')}), dv AS ({_VARS('da', 'height <> 32')}), tv AS (SELECT coalesce(l.page_id, d.page_id) AS page_id, coalesce(l.name, d.name) AS name, l.value AS light, d.value AS dark FROM lv l FULL JOIN dv d ON l.page_id = d.page_id AND l.name = d.name WHERE l.value IS DISTINCT FROM d.value AND coalesce(l.page_id, d.page_id) IN (SELECT page_id FROM da))"


def _placed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The elements with a text colour and a background: page_id, ord, whether their width is even, and ``columns``. They move once, by page."""
    e = elements.from_lineitem(spark, sf_dir).where("color is not null and background is not null")
    # aggregates that keep a text sort their rows: by page a task has no more of them than a shuffle deals to it, however large the files are
    return e.select("page_id", "ord", (F.col("width") % 2 == 0).alias("even"), *columns).repartition("page_id")


def _read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (page_id, even, text, ...), few for each page, with the colour of their text as ``hex``: on the light side and on the dark one."""
    rows = stored(rows)
    inverse = F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(255 - F.col(c))), 2, "0") for c in "rgb"))
    read = usage.parsed(rows, "text").select("text", "hex", inverse.alias("inverse"))
    both = stored(rows.join(read, "text"))
    dark = both.where(_DARK).withColumn("hex", F.when(F.col("even"), F.col("inverse")).otherwise(F.col("hex")))
    return both, dark


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, role, hex) of both sides: a page's first large background, first text and first button."""
    e = _placed(spark, sf_dir, "area", "tag", "color", "background")
    first = lambda c, where: F.min(F.when(where, F.struct("ord", F.col(c).alias("text"), "even")))
    some = e.groupBy("page_id").agg(first("background", F.col("area") > 50_000).alias("background"), first("color", F.lit(True)).alias("text"), first("background", F.col("tag") == "button").alias("primary"))
    return _read(some.unpivot("page_id", ["background", "text", "primary"], "role", "x").select("page_id", "role", "x.text", "x.even"))


def _variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _placed(spark, sf_dir, "tag", "height", "background")
    last = e.groupBy("page_id", "tag", "height").agg(F.max(F.struct("ord", F.col("background").alias("text"), "even")).alias("x"))
    light, dark = _read(last.select("page_id", "tag", "height", "x.*"))
    side = lambda df, where: df.where(where).select("page_id", F.expr(_NAME).alias("name"), F.col("hex").alias("value"), F.col("ord").alias("place"))
    return themes.theme_variables(side(light, "height <> 64"), side(dark, "height <> 32"))


def _colours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, hex, place) of both sides."""
    e = _placed(spark, sf_dir, "color", "background")
    used = e.select("page_id", "even", F.explode(F.array(F.struct(F.col("color").alias("text"), (F.col("ord") * 2).alias("place")), F.struct(F.col("background").alias("text"), (F.col("ord") * 2 + 1).alias("place")))).alias("x")).select("page_id", "even", "x.*")
    return _read(used.groupBy("page_id", "even", "text").agg(F.min("place").alias("place")))


query("theme_roles", f"""WITH {_SIDES}, lr AS ({_ROLES("li")}), dr AS ({_ROLES("da")})
  SELECT coalesce(l.page_id, d.page_id) AS page_id, coalesce(l.role, d.role) AS role, l.hex AS light, d.hex AS dark FROM lr l FULL JOIN dr d ON l.page_id = d.page_id AND l.role = d.role WHERE coalesce(l.page_id, d.page_id) IN (SELECT page_id FROM da)""")(lambda s, d: themes.theme_roles(*_roles(s, d)))
query("theme_variables", f"WITH {_SIDES}, {_THEME_VARS} SELECT * FROM tv")(_variables)


@query("theme_audit", f"""WITH {_SIDES}, {_THEME_VARS}, lc AS (SELECT page_id, hex, min(place) AS place FROM (SELECT page_id, fg AS hex, ord * 2 AS place FROM li UNION ALL SELECT page_id, back, ord * 2 + 1 FROM li) GROUP BY ALL),
  dc AS (SELECT page_id, hex, min(place) AS place FROM (SELECT page_id, fg AS hex, ord * 2 AS place FROM da UNION ALL SELECT page_id, back, ord * 2 + 1 FROM da) GROUP BY ALL),
  md AS (SELECT page_id, string_agg(hex, ',' ORDER BY i) AS hexes FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place, hex) AS i FROM lc ANTI JOIN dc USING (page_id, hex)) WHERE i <= {themes.LISTED} GROUP BY page_id),
  ml AS (SELECT page_id, string_agg(hex, ',' ORDER BY i) AS hexes FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place, hex) AS i FROM dc ANTI JOIN lc USING (page_id, hex)) WHERE i <= {themes.LISTED} GROUP BY page_id),
  n AS (SELECT page_id, count(*) AS variables FROM tv GROUP BY page_id)
  SELECT page_id, coalesce(md.hexes, '') AS missing_in_dark, coalesce(ml.hexes, '') AS missing_in_light, coalesce(variables, 0) AS variables, CASE WHEN variables > 0 THEN 'paired' ELSE 'light-only-vars' END AS coverage
  FROM (SELECT DISTINCT page_id FROM da) LEFT JOIN md USING (page_id) LEFT JOIN ml USING (page_id) LEFT JOIN n USING (page_id)""")
def theme_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.theme_audit(*_colours(spark, sf_dir), _variables(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing_in_dark", "missing_in_light")})


# --- motion seen, bound to events: a user is a page --------------------------------------------------------------------
_SEEN = """user_id AS page_id, event_id AS ord, CASE event_id % 6 WHEN 0 THEN 'hover' WHEN 1 THEN 'focus' WHEN 2 THEN 'scroll' WHEN 3 THEN 'scroll' WHEN 4 THEN 'other' END AS trigger,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('.', event_type, '-', CAST(event_id % 5 AS {text})) END AS selector, CASE event_id % 9 WHEN 0 THEN 'pin-top' WHEN 1 THEN 'fade' ELSE '' END AS name,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -5.0 ELSE CAST(event_id % 8 * 190.5 AS DOUBLE) END AS duration, CASE event_id % 4 WHEN 0 THEN 'ease' WHEN 1 THEN 'linear' END AS easing,
  CASE event_id % 5 WHEN 0 THEN {a}' transform', 'opacity', 'transform'{b} WHEN 1 THEN {a}'transform', ''{b} WHEN 2 THEN {a}'position'{b} WHEN 3 THEN {a}'opacity', 'color'{b} END AS properties"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.observed_motion(_table(spark, sf_dir, "events").selectExpr(*_expressions(_SEEN.format(text="STRING", a="array(", b=")"))))


_OBSERVED = f"""ob AS (SELECT {_SEEN.format(text="VARCHAR", a="[", b="]")} FROM events), nm AS (SELECT page_id, ord, CASE WHEN list_contains({themes.TRIGGERS}, trigger) THEN trigger ELSE 'load' END AS trigger, left(coalesce(selector, ''), {themes.SELECTOR}) AS selector, left(name, {themes.NAME}) AS name,
    floor(greatest(coalesce(duration, 0), 0) + 0.5)::BIGINT AS duration, left(coalesce(easing, 'linear'), {themes.EASING}) AS easing, coalesce(list_sort(list_distinct(list_filter(list_transform(properties, lambda p: trim(p)), lambda p: p <> ''))), []) AS properties FROM ob),
  mo AS (SELECT page_id, trigger, selector, name, duration, properties, min(ord) AS ord, arg_min(easing, (ord, easing)) AS easing FROM nm WHERE selector <> '' OR name <> '' OR len(properties) > 0 GROUP BY ALL)"""
_BAND = "CASE WHEN d <= 80 THEN 'instant' WHEN d <= 150 THEN 'xs' WHEN d <= 250 THEN 'sm' WHEN d <= 400 THEN 'md' WHEN d <= 700 THEN 'lg' WHEN d <= 1200 THEN 'xl' ELSE 'xxl' END"


@query("runtime_motion", f"""WITH {_OBSERVED}, du AS (SELECT page_id, trigger, string_agg({_BAND} || ':' || CASE WHEN d >= 1000 THEN regexp_replace((d / 1000)::VARCHAR, '\\.0$', '') || 's' ELSE d || 'ms' END, ',' ORDER BY d) AS durations FROM (SELECT DISTINCT page_id, trigger, duration AS d FROM mo WHERE duration > 0) GROUP BY ALL)
  SELECT page_id, trigger, list_position({themes.TRIGGERS}, trigger) - 1 AS turn, count(*) AS observed, count(DISTINCT nullif(selector, '')) AS targets, coalesce(any_value(durations), '') AS durations FROM mo LEFT JOIN du USING (page_id, trigger) GROUP BY page_id, trigger""")
def runtime_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.motion_by_trigger(_observed(spark, sf_dir))
    return out.withColumn("durations", F.array_join(F.transform("durations", lambda x: F.concat_ws(":", x["name"], x["css"])), ","))


query("scroll_recipes", f"""WITH {_OBSERVED}, k AS (SELECT *, CASE WHEN list_contains(properties, 'transform') AND NOT list_contains(properties, 'opacity') THEN 'parallax' WHEN list_contains(properties, 'position') OR contains(name, 'pin') THEN 'pin' ELSE 'reveal' END AS kind FROM mo WHERE trigger = 'scroll'),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, selector, kind ORDER BY ord) AS i FROM k)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, selector, kind)::INT AS rank, selector, kind, array_to_string(properties, ',') AS properties, duration, easing FROM f WHERE i = 1""")(
    lambda s, d: themes.scroll_recipes(_observed(s, d)).withColumn("properties", F.array_join("properties", ","))
)
