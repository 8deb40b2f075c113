"""Breakpoints, stylesheet health, variables, slugs, elevation, head-to-head scores and token trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from swatchwork.functions import csstext as T

#: Labels of standard widths in pixels; words of categories and of states of variables, the first that fits counts.
STANDARD = {320: "xs", 480: "sm", 640: "sm", 768: "md", 1024: "lg", 1280: "xl", 1536: "2xl"}
CATEGORIES = {
    "colors": "color|bg|foreground|primary|secondary|accent|muted|border|ring|destructive|card|popover|chart",
    "spacing": "spacing|gap|padding|margin|space|size",
    "typography": "font|text|line-height|letter|tracking|leading",
    "shadows": "shadow",
    "radii": "radius|rounded",
}
STATES = {
    "success": "success|green|valid|positive",
    "warning": "warning|warn|yellow|caution|amber",
    "error": "error|danger|destructive|red|invalid|negative",
    "info": "info|informati|blue|notice",
}


def breakpoints(queries: DataFrame) -> DataFrame:
    """Widths of media queries (page_id, ord, query), whole pixels, em and rem as 16: the last bound of a width counts, a query's upper one after its lower one.

    A width is labelled as the nearest standard one within 64 pixels, the smaller of two, or else by its own pixels.
    """
    bounds = [F.struct(F.lit(k).alias("turn"), F.lit(f"{side}-width").alias("kind"), F.regexp_extract("query", rf"{side}-width:\s*([\d.]+(?:px|em|rem))", 1).alias("width")) for k, side in enumerate(("min", "max"))]
    rows = queries.select("page_id", "ord", F.explode(F.array(*bounds)).alias("b")).select("page_id", "ord", "b.*")
    px = T.half_up(T.number(F.col("width")) * F.when(F.col("width").endswith("px"), 1.0).otherwise(16.0))
    rows = rows.withColumn("px", px).where("px is not null").groupBy("page_id", "px").agg(F.max_by("kind", F.struct("ord", "turn")).alias("kind"))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col("px") - w).alias("off"), F.lit(w).alias("width"), F.lit(n).alias("label")) for w, n in STANDARD.items())))
    return rows.select("page_id", "px", "kind", F.when(near["off"] <= 64, near["label"]).otherwise(F.concat(F.col("px").cast("string"), F.lit("px"))).alias("label"))


def css_health(sheets: DataFrame) -> DataFrame:
    """Per sheet (id, text): rules, !important, vendor prefixes, repeated declarations, and the largest and mean specificity of ids, classes and types."""
    blocks = sheets.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"([^{}]+\{[^{}]*\})"), 1)).alias("rule"))
    rule = blocks.select("id", F.trim(F.regexp_extract("rule", r"^([^{]*)\{", 1)).alias("selector"), F.regexp_extract("rule", r"\{([^}]*)\}", 1).alias("body"))
    ids, classes, types = (F.regexp_count("selector", F.lit(p)) for p in (r"#[\w-]+", r"\.[\w-]+|\[[^\]]*\]|:[a-z-]+", r"(?:^|[\s>+~])[a-z][a-z0-9]*"))
    weight = ids * 100 + classes * 10 + types
    own = rule.groupBy("id").agg(F.count("*").alias("rules"), F.sum(F.regexp_count("body", F.lit("!important"))).alias("important"), F.sum(F.regexp_count("body", F.lit("-(?:webkit|moz|ms|o)-"))).alias("vendor"), F.max(weight).alias("max_specificity"), F.round(F.avg(weight), 4).alias("mean_specificity"))
    lines = rule.select("id", F.explode(F.split("body", ";")).alias("line")).select("id", F.trim("line").alias("line")).where("line != ''")
    again = lines.groupBy("id", "line").agg(F.count("*").alias("n")).groupBy("id").agg(F.sum(F.col("n") - 1).alias("repeated"))
    return own.join(again, "id", "left").select("id", "rules", "important", "vendor", "max_specificity", "mean_specificity", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def _first_that_fits(name, words: dict[str, str], otherwise: str | None):
    return F.coalesce(*(F.when(name.rlike(pattern), label) for label, pattern in words.items()), F.lit(otherwise))


def variable_categories(variables: DataFrame) -> DataFrame:
    """Custom properties (page_id, name, value) by the words in their names: category, state if they have one, and the variables they refer to, in order."""
    name = F.lower("name")
    refs = F.array_join(F.regexp_extract_all("value", F.lit(r"var\((--[\w-]+)"), 1), ",")
    return variables.select("page_id", "name", _first_that_fits(name, CATEGORIES, "other").alias("category"), _first_that_fits(name, STATES, None).alias("state"), refs.alias("refers_to"))


def slugs(names: DataFrame) -> DataFrame:
    """Slugs of (id, name); the second of a slug ends in -2, and so on."""
    rows = names.withColumn("slug", T.slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return rows.select("id", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("slug"))


def elevation(shadows: DataFrame) -> DataFrame:
    """Levels of shadows (page_id, weight, uses): in order of weight, one joins while it is at most 1.25 times the first of its level and 1; the most used stands for it."""
    xs = shadows.groupBy("page_id").agg(F.array_sort(F.collect_set(F.col("weight").cast("double"))).alias("xs"))
    step = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x <= F.element_at(a, -1) * 1.25 + 1, a).otherwise(F.concat(a, F.array(x)))
    first = xs.withColumn("firsts", F.aggregate("xs", F.array().cast("array<double>"), step)).select("page_id", "firsts")
    rows = shadows.join(first, "page_id").withColumn("level", F.size(F.filter("firsts", lambda a: a <= F.col("weight"))))
    best = F.max(F.struct("uses", (-F.col("weight")).alias("minus")))
    return rows.groupBy("page_id", "level").agg((-best["minus"]).alias("weight"), F.sum("uses").alias("uses"))


def head_to_head(scores: DataFrame, overall: DataFrame, margin: int = 3) -> DataFrame:
    """Pairs (a, b) of (dimension, a, b, a_score, b_score): dimensions won by the margin or more, ties, and the verdict by ``overall`` (a, b, a_score, b_score), a tie without it."""
    d = T.half_up(F.col("a_score") - F.col("b_score"))
    rows = scores.where(d.isNotNull()).groupBy("a", "b").agg(F.count(F.when(d >= margin, 1)).alias("a_wins"), F.count(F.when(d <= -margin, 1)).alias("b_wins"), F.count("*").alias("dimensions"))
    whole = F.col("a_score") - F.col("b_score")
    verdict = overall.select("a", "b", F.when(whole >= margin, "a").when(whole <= -margin, "b").otherwise("tie").alias("v"))
    return rows.join(verdict, ["a", "b"], "left").select("a", "b", "a_wins", "b_wins", (F.col("dimensions") - F.col("a_wins") - F.col("b_wins")).alias("ties"), F.coalesce("v", F.lit("tie")).alias("verdict"))


class _Number(str):
    """A number as it stands in the JSON text."""


def _text(value: object) -> str | None:
    """A string as it is, null as None, anything else as JSON."""
    return None if value is None else str(value) if type(value) is str else _json(value)


def _json(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def leaves(text: str | None) -> list[tuple[str, str | None]]:
    """Paths and texts of the values of a token tree (objects with $value, in lists too) or, where it has none, of its plain leaves."""
    try:
        tree = json.loads(text or "", parse_float=_Number, parse_int=_Number, parse_constant=_Number)
    except json.JSONDecodeError:
        return []
    valued: list[tuple[str, str | None]] = []
    plain: list[tuple[str, str | None]] = []
    left = [("", tree, True)] if isinstance(tree, dict) else []
    while left:
        path, node, bare = left.pop()  # bare: no list is above
        for key, value in (node.items() if isinstance(node, dict) else [(str(k), v) for k, v in enumerate(node)]):
            if key.startswith("$"):
                continue
            here = f"{path}.{key}" if path else key
            if isinstance(value, dict) and "$value" in value:
                valued.append((here, _text(value["$value"])))
                continue
            if isinstance(value, dict | list):
                left.append((here, value, bare and isinstance(value, dict)))
            if bare and not isinstance(value, dict):
                plain.append((here, _text(value)))
    return valued or plain


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [leaves(x) for x in batch.column("json").to_pylist()]
        ids = batch.column("id").take(pa.array([k for k, x in enumerate(found) for _ in x], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([pair[n] and pair[n].encode("utf-8", "replace").decode() for x in found for pair in x], pa.string()) for n in (0, 1))], names=["id", "path", "value"])


def flat_tokens(documents: DataFrame) -> DataFrame:
    """Paths and texts of the tokens of JSON documents (id, json), however deep: an object with $value gives that value, other keys with $ in front are left out.

    A document without any $value gives its plain leaves. Null and broken documents give no row.
    """
    rows = documents.select("id", F.col("json").cast("string").alias("json"))
    return rows.mapInArrow(_flatten, S.StructType([rows.schema["id"], S.StructField("path", S.StringType()), S.StructField("value", S.StringType())]))
