"""Element rows of pages: what each element of a page looks like, as CSS text, in document order.

``from_lineitem`` binds the schema to a table of order lines by plain arithmetic on each row, which SQL can repeat: there are
more pages with more orders, and a page has the lines of ORDERS orders, however many there are in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders whose lines make up a page, and pages of one site.
ORDERS, SITE = 150, 10
TAGS = ["p", "a", "button", "h1", "h2", "span", "li", "div"]
SIZES = [12, 14, 16, 18, 24, 32, 48]
SPACES = [0, 4, 8, 12, 16, 20, 24, 32, 48, 64]
RADII = [0, 2, 4, 8, 9, 16, 999]
FAMILIES = ["Inter, sans-serif", "Georgia, serif", "system-ui", "Roboto Mono, monospace"]
EASINGS = ["ease", "ease-in-out", "linear", "cubic-bezier(0.4, 0, 0.2, 1)", "cubic-bezier(0.3, 1.5, 0.6, 1)"]
DURATIONS = ["100ms", "0.2s", "300ms", "0.5s", "1.5s"]
#: One line of 37 has a text colour of its own, and one of 41 one of its page.
RARE, PAGES_OWN = 37, 41


def _pick(values: list, at) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element rows. ``ord`` packs order, line, part, supplier and quantity into one number; only lines that share all five stand at one place."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p, s, n, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    page = F.floor(F.col("l_orderkey") / ORDERS)
    place = (((F.col("l_orderkey") % ORDERS * 8 + n) * (1 << 24) + p % (1 << 24)) * (1 << 20) + s % (1 << 20)) * 64 + q % 64
    rgb = lambda r, g, b: F.concat(F.lit("rgb("), r.cast("string"), F.lit(", "), g.cast("string"), F.lit(", "), b.cast("string"), F.lit(")"))
    px = lambda x: F.concat(x.cast("string"), F.lit("px"))
    return t.select(
        page.alias("page_id"),
        place.alias("ord"),
        _pick(TAGS, p).alias("tag"),
        (p % 1000 * 100 + q).alias("area"),
        F.when(p % RARE == 0, rgb(p % 256, s % 256, q % 256)).when(p % PAGES_OWN == 0, rgb(page % 256, 255 - page % 256, p % 3 * 40)).otherwise(rgb(p % 6 * 51, s % 6 * 51, (n + q) % 6 * 51)).alias("color"),
        rgb(q % 4 * 85, p % 3 * 100 + 55, n % 2 * 255).alias("background"),
        px(_pick(SIZES, q)).alias("font_size"),
        F.when(q % 5 == 0, "700").otherwise("400").alias("font_weight"),
        _pick(FAMILIES, p).alias("font_family"),
        px(_pick(SPACES, q)).alias("padding"),
        px(_pick(SPACES, p + n)).alias("margin"),
        px(_pick(RADII, s + n)).alias("radius"),
        F.when(q % 10 == 0, (p % 12 * 100).cast("string")).otherwise("auto").alias("z_index"),
        F.when(q % 3 == 0, F.concat(F.lit("0px "), px(p % 5), F.lit(" "), px(p % 5 * 4), F.lit(" rgba(0, 0, 0, 0.2)"))).otherwise("none").alias("shadow"),
        F.concat(F.lit("opacity "), _pick(DURATIONS, p), F.lit(" "), _pick(EASINGS, q)).alias("transition"),
        F.when(q % 7 == 0, "btn primaryCta").when(q % 7 == 1, "nav-item").when(q % 7 == 2, "card").when(q % 7 == 3, "badge").otherwise("").alias("class_list"),
        (n * 80 + q).alias("width"),
        (q % 6 * 16 + 16).alias("height"),
    )


def _sql_pick(values: list, at: str) -> str:
    return "[" + ", ".join(repr(v) for v in values) + f"][({at}) % {len(values)} + 1]"


#: The same rows for another engine: a table expression to stand in a WITH clause.
SQL = f"""elements AS (SELECT l_orderkey // {ORDERS} AS page_id,
  (((l_orderkey % {ORDERS} * 8 + n) * {1 << 24} + p % {1 << 24}) * {1 << 20} + s % {1 << 20}) * 64 + q % 64 AS ord, {_sql_pick(TAGS, "p")} AS tag,
  p % 1000 * 100 + q AS area,
  'rgb(' || r || ', ' || g || ', ' || b || ')' AS color, r, g, b,
  'rgb(' || (q % 4 * 85) || ', ' || (p % 3 * 100 + 55) || ', ' || (n % 2 * 255) || ')' AS background, q % 4 * 85 AS br, p % 3 * 100 + 55 AS bg, n % 2 * 255 AS bb,
  {_sql_pick(SIZES, "q")} || 'px' AS font_size, CASE WHEN q % 5 = 0 THEN '700' ELSE '400' END AS font_weight, {_sql_pick(FAMILIES, "p")} AS font_family,
  {_sql_pick(SPACES, "q")} || 'px' AS padding, {_sql_pick(SPACES, "p + n")} || 'px' AS margin, {_sql_pick(RADII, "s + n")} || 'px' AS radius,
  CASE WHEN q % 10 = 0 THEN p % 12 * 100 END AS z_index, CASE WHEN q % 3 = 0 THEN p % 5 END AS shadow_y,
  {_sql_pick([100, 200, 300, 500, 1500], "p")} AS duration, {_sql_pick(EASINGS, "q")} AS easing,
  CASE q % 7 WHEN 0 THEN 'btn primaryCta' WHEN 1 THEN 'nav-item' WHEN 2 THEN 'card' WHEN 3 THEN 'badge' ELSE '' END AS class_list,
  n * 80 + q AS width, q % 6 * 16 + 16 AS height
  FROM (SELECT *, {", ".join(f"CASE WHEN p % {RARE} = 0 THEN {rare} WHEN p % {PAGES_OWN} = 0 THEN {own} ELSE {plain} END AS {c}" for c, rare, own, plain in (("r", "p % 256", f"l_orderkey // {ORDERS} % 256", "p % 6 * 51"), ("g", "s % 256", f"255 - l_orderkey // {ORDERS} % 256", "s % 6 * 51"), ("b", "q % 256", "p % 3 * 40", "(n + q) % 6 * 51")))}
    FROM (SELECT *, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q FROM lineitem)))"""
