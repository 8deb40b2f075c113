"""A palette around another primary colour, and the light and the dark side of a page held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T
from swatchwork.operators import usage

#: Chroma under which a colour is neutral and keeps its hue; listed colours of an audit.
NEUTRAL, LISTED = 0.04, 20
#: Roles of a palette, in their order.
ROLES = ["primary", "secondary", "accent", "background", "text"]
_HEX = r"#[0-9a-fA-F]{3,6}\b"


def whole_hex(text: Column) -> Column:
    """#rrggbb in lower case of three or six digits, with or without the #; null for anything else."""
    digits = F.regexp_extract(F.lower(F.trim(text)), r"^#?([0-9a-f]{6}|[0-9a-f]{3})$", 1)
    return F.when(F.length(digits) == 3, F.concat(F.lit("#"), F.regexp_replace(digits, "(.)", "$1$1"))).when(F.length(digits) == 6, F.concat(F.lit("#"), digits))


def hue_between(a: Column, b: Column) -> Column:
    """The shortest way in degrees, -180 to 180, from one hue in 0 to 360 to another."""
    d = b - a
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def _lch(hex_: Column) -> Column:
    return T.bound(C.parse_color(hex_), C.to_oklch)


def _turned(hex_: Column, lch: Column, shift: Column) -> Column:
    h = lch["h"] + shift
    h = F.when(h < 0, h + 360).when(h >= 360, h - 360).otherwise(h)
    new = T.bound(F.struct(lch["l"].alias("l"), lch["c"].alias("c"), h.alias("h")), lambda x: T.bound(C.from_oklch(x), C.to_hex))
    return F.when(lch["c"] < NEUTRAL, hex_).when(lch["c"] >= NEUTRAL, new)


def turned(hex_: Column, shift: Column) -> Column:
    """A colour (#rrggbb) with its hue turned by ``shift`` degrees, lightness and chroma kept; a neutral one as it is."""
    return F.when(hex_.isNotNull(), T.bound(_lch(hex_), lambda x: _turned(hex_, x, shift)))


def turned_text(text: Column, shift: Column) -> Column:
    """A text such as a gradient or a variable's value with each colour in hex digits turned; other digits stay as they are."""
    found = F.regexp_extract_all(text, F.lit(f"({_HEX})"), F.lit(1))
    between = F.split(text, _HEX)
    new = F.transform(found, lambda x: F.coalesce(turned(whole_hex(x), shift), x))
    return F.array_join(F.transform(between, lambda x, k: F.concat(x, F.coalesce(F.get(new, k), F.lit("")))), "")


def recoloured(palette: DataFrame, target: str, named: DataFrame | None = None) -> DataFrame:
    """(page_id, hex, new_hex, pinned, source, hue_shift) of each colour of ``palette`` (page_id, hex, uses, place) around the new primary ``target``.

    The old primary is the page's in ``named`` (page_id, hex); without one there, it is the most used colour that is not
    neutral, or, where all are, the first of the palette; of equal use the earlier one. It becomes the target, and all
    others turn by the angle between the two. Texts that are no colour (#rgb, #rrggbb) stay as they are and are never the
    primary; a page without a colour has no source and no shift. Rows of a null page_id are one page. An empty palette
    gives an empty table.
    """
    to = palette.sparkSession.range(1).select(whole_hex(F.lit(target)).alias("hex")).select("hex", _lch(F.col("hex"))["h"].alias("h")).first()
    if to["hex"] is None:
        raise ValueError(f"no colour in hex digits: {target!r}")
    rows = palette.select("page_id", "hex", "uses", "place", whole_hex(F.col("hex")).alias("own"))
    lch = rows.select("own").where("own is not null").distinct().select("own", _lch(F.col("own")).alias("lch"))
    rows = rows.join(lch, "own", "left")
    coloured = F.col("lch.c") >= NEUTRAL
    best = F.min(F.when(F.col("own").isNotNull(), F.struct((~coloured).alias("n"), F.when(coloured, -F.coalesce("uses", F.lit(0))).otherwise(0).alias("u"), "place", "own", F.col("lch.h").alias("h"))))
    source = rows.groupBy("page_id").agg(best.alias("b")).select(F.col("page_id").alias("page"), F.col("b.own").alias("source"), F.col("b.h").alias("h"))
    if named is not None:
        names = named.groupBy(F.col("page_id").alias("page")).agg(F.min(whole_hex(F.col("hex"))).alias("named")).where("named is not null")
        names = names.select("page", "named", _lch(F.col("named"))["h"].alias("named_h"))
        source = source.join(names, "page", "left").select("page", F.coalesce("named", "source").alias("source"), F.coalesce("named_h", "h").alias("h"))
    source = source.select("page", "source", hue_between(F.col("h"), F.lit(to["h"])).alias("shift"))
    both = rows.select("page_id", "hex", "own", "lch").join(source, F.col("page_id").eqNullSafe(F.col("page"))).drop("page")
    pinned = F.col("own").eqNullSafe(F.col("source")) & F.col("own").isNotNull()
    new = F.when(pinned, to["hex"]).otherwise(F.coalesce(_turned(F.col("own"), F.col("lch"), F.col("shift")), "own", "hex"))
    return both.select("page_id", "hex", new.alias("new_hex"), pinned.alias("pinned"), "source", F.round("shift", 2).alias("hue_shift"))


def theme_roles(light: DataFrame, dark: DataFrame) -> DataFrame:
    """(page_id, role, light, dark) of two tables (page_id, role, hex), in lower case: a row for each role that either side has.

    A page that ``dark`` does not hold at all, or without an id, has no dark theme and no rows. Empty texts are missing. Of
    repeated rows the least counts. Roles that are not in ROLES are not looked at.
    """
    side = lambda df, name: df.where(F.col("role").isin(ROLES) & (F.col("hex") != "")).groupBy("page_id", "role").agg(F.min(F.lower("hex")).alias(name))
    both = side(light, "light").join(side(dark, "dark"), ["page_id", "role"], "full_outer")
    return both.join(dark.select("page_id").distinct(), "page_id", "left_semi")


def theme_variables(light: DataFrame, dark: DataFrame) -> DataFrame:
    """(page_id, name, light, dark) of the variables (page_id, name, value, place) whose values differ or that one side lacks.

    Of a variable that is set more than once the last place counts (of one place, the greatest value). Null values are
    missing. Pages that ``dark`` does not hold are left out.
    """
    side = lambda df, name: df.where("value is not null").groupBy("page_id", "name").agg(F.max(F.struct("place", "value"))["value"].alias(name))
    both = side(light, "light").join(side(dark, "dark"), ["page_id", "name"], "full_outer").where(~F.col("light").eqNullSafe(F.col("dark")))
    return both.join(dark.select("page_id").distinct(), "page_id", "left_semi")


def theme_audit(light: DataFrame, dark: DataFrame, variables: DataFrame) -> DataFrame:
    """(page_id, missing_in_dark, missing_in_light, variables, coverage): colours (page_id, hex, place) that only one side has, and how the theme is made.

    The first LISTED colours of each side by place are listed. ``coverage`` is paired where ``variables`` of
    ``theme_variables`` are there, light-only-vars otherwise. Pages without a dark colour are left out.
    """
    side = lambda df: df.where(F.col("hex") != "").groupBy("page_id", F.lower("hex").alias("hex")).agg(F.min("place").alias("place"))
    a, b = side(light), side(dark)

    def only(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        left = usage.top(x.join(y, ["page_id", "hex"], "left_anti"), ["page_id"], LISTED, F.asc("place"), F.asc("hex"))
        return left.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hex"))), lambda z: z["hex"]).alias(name))

    out = b.select("page_id").distinct()
    for part in (only(a, b, "missing_in_dark"), only(b, a, "missing_in_light"), variables.groupBy("page_id").agg(F.count("*").alias("variables"))):
        out = out.join(part, "page_id", "left")
    none = F.array().cast("array<string>")
    out = out.select("page_id", *(F.coalesce(c, none).alias(c) for c in ("missing_in_dark", "missing_in_light")), F.coalesce("variables", F.lit(0)).alias("variables"))
    return out.withColumn("coverage", F.when(F.col("variables") > 0, "paired").otherwise("light-only-vars"))


# --- motion as seen while a page runs ----------------------------------------------------------------------------------
#: What starts a motion, in the order of reports; the first stands for unknown ones.
TRIGGERS = ["load", "hover", "focus", "active", "scroll"]
#: Lengths to which texts of an observation are cut by rule.
SELECTOR, NAME, EASING = 200, 128, 80


def observed_motion(seen: DataFrame) -> DataFrame:
    """Observations (page_id, ord, trigger, selector, name, duration, easing, properties) in one form, each once.

    Unknown and null triggers are load; durations are whole milliseconds, 0 at least and 0 for null; properties are
    trimmed, distinct and sorted; no easing is linear. An observation without selector, name and properties is none. Of
    those that agree in trigger, selector, name, duration and properties the first stays; of one place, the least easing.
    """
    text = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    trimmed = F.array_remove(F.array_distinct(F.transform(F.filter("properties", lambda x: x.isNotNull()), lambda x: F.trim(x))), "")
    duration = F.when(F.isnan("duration") | F.col("duration").isNull(), 0.0).otherwise(F.greatest(F.col("duration"), F.lit(0.0)))
    rows = seen.select(
        "page_id", "ord", F.when(F.col("trigger").isin(TRIGGERS), F.col("trigger")).otherwise(TRIGGERS[0]).alias("trigger"), text("selector", SELECTOR), text("name", NAME),
        F.floor(duration + 0.5).cast("long").alias("duration"), F.substring(F.coalesce("easing", F.lit("linear")), 1, EASING).alias("easing"), F.coalesce(F.array_sort(trimmed), F.array().cast("array<string>")).alias("properties"),
    )
    rows = rows.where("selector != '' or name != '' or size(properties) > 0")
    first = rows.groupBy("page_id", "trigger", "selector", "name", "duration", "properties").agg(F.min(F.struct("ord", "easing")).alias("f"))
    return first.select("page_id", "f.ord", "trigger", "selector", "name", "duration", "f.easing", "properties")


def motion_by_trigger(observed: DataFrame) -> DataFrame:
    """(page_id, trigger, turn, observed, targets, durations) of ``observed_motion``: durations above 0 are listed once, upwards, with their bands."""
    ms = F.array_sort(F.collect_set(F.when(F.col("duration") > 0, F.col("duration"))))
    css = lambda x: F.when(x >= 1000, F.concat(F.regexp_replace((x / 1000).cast("string"), r"\.0$", ""), F.lit("s"))).otherwise(F.concat(x.cast("string"), F.lit("ms")))
    rows = observed.groupBy("page_id", "trigger").agg(F.count("*").alias("observed"), F.count_distinct(F.nullif("selector", F.lit(""))).alias("targets"), ms.alias("ms"))
    named = F.transform("ms", lambda x: F.struct(T.duration_band(x).alias("name"), x.alias("ms"), css(x).alias("css")))
    return rows.select("page_id", "trigger", (F.array_position(F.array(*map(F.lit, TRIGGERS)), F.col("trigger")) - 1).alias("turn"), "observed", "targets", named.alias("durations"))


def scroll_recipes(observed: DataFrame) -> DataFrame:
    """(page_id, rank, selector, kind, properties, duration, easing): what scrolling sets off, each selector and kind once, in the order of its first observation."""
    has = lambda p: F.array_contains("properties", p)
    kind = F.when(has("transform") & ~has("opacity"), "parallax").when(has("position") | F.col("name").contains("pin"), "pin").otherwise("reveal")
    rows = observed.where("trigger = 'scroll'").withColumn("kind", kind)
    first = rows.groupBy("page_id", "selector", "kind").agg(F.min(F.struct("ord", "properties", "duration", "easing")).alias("f")).select("page_id", "selector", "kind", "f.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "selector", "kind"))
    return first.select("page_id", rank.alias("rank"), "selector", "kind", "properties", "duration", "easing")
