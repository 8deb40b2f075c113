"""Which declarations of a page's stylesheets and style attributes hold for its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPOUND = r"^(?:([A-Za-z][\w-]*)|\*)?((?:[.#][\w-]+)*)$"


def _compound(selector: Column) -> tuple[Column, Column, Column]:
    """Tag (null for any), ids and classes of a compound selector."""
    tag = F.nullif(F.lower(F.regexp_extract(selector, _COMPOUND, 1)), F.lit(""))
    rest = F.regexp_extract(selector, _COMPOUND, 2)
    return tag, F.regexp_extract_all(rest, F.lit(r"#([\w-]+)"), 1), F.regexp_extract_all(rest, F.lit(r"\.([\w-]+)"), 1)


def declared_styles(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, ord, property, value, origin): the declaration that wins for each property of an element.

    ``elements`` has page_id, ord, tag, id, class_list and style; ``rules`` has page_id, sheet (its place in the page) and
    the columns of ``stylesheets.declarations``. Selectors of one tag, id or class, or of these together, are matched, by a
    join on the page and the rarest of them; selectors of several elements or with states match nothing here, nor do rules
    inside @media. Important ones win, then style attributes, then by ids, classes and tags, then the later one.
    """
    tag, ids, classes = _compound(F.trim("selector"))
    known = rules.where(F.trim("selector").rlike(_COMPOUND) & (F.trim("selector") != "") & (F.coalesce("media", F.lit("")) == "")).select("page_id", "sheet", F.col("ord").alias("rule"), "place", "property", "value", "important", tag.alias("r_tag"), ids.alias("r_ids"), classes.alias("r_classes"))
    key = F.coalesce(F.concat(F.lit("#"), F.get("r_ids", F.lit(0))), F.concat(F.lit("."), F.get("r_classes", F.lit(0))), F.col("r_tag"), F.lit("*"))
    own = F.array_remove(F.split(F.coalesce("class_list", F.lit("")), r"\s+"), "")
    rows = elements.select("page_id", F.col("ord"), "tag", "id", own.alias("classes"), "style")
    keys = F.array_compact(F.concat(F.array(F.concat(F.lit("#"), F.col("id")), F.col("tag"), F.lit("*")), F.transform("classes", lambda c: F.concat(F.lit("."), c))))
    met = rows.drop("style").withColumn("key", F.explode(F.array_distinct(keys))).join(known.withColumn("key", key), ["page_id", "key"])
    met = met.where((F.col("r_tag").isNull() | (F.col("r_tag") == F.col("tag"))) & F.forall("r_ids", lambda x: x.eqNullSafe(F.col("id"))) & (F.size(F.array_except("r_classes", "classes")) == 0))
    weight = F.struct("important", F.lit(False).alias("inline"), F.size("r_ids").alias("ids"), F.size("r_classes").alias("of_class"), F.col("r_tag").isNotNull().cast("int").alias("tags"), F.col("sheet").cast("long").alias("sheet"), F.col("rule").cast("long").alias("rule"), F.col("place").cast("long").alias("place"))
    sheets = met.select("page_id", "ord", "property", "value", F.lit("sheet").alias("origin"), weight.alias("weight"))
    said = rows.where("style is not null").select("page_id", "ord", F.posexplode(F.split("style", r";(?![^(]*\))")).alias("place", "d")).where(F.col("d").contains(":"))
    value = F.trim(F.regexp_replace("d", r"^[^:]*:", ""))
    important = value.rlike(r"(?i)!\s*important$")
    name = F.trim(F.substring_index("d", ":", 1))
    zero = lambda n: F.lit(0).cast("long").alias(n)
    inline = F.struct(important.alias("important"), F.lit(True).alias("inline"), F.lit(0).alias("ids"), F.lit(0).alias("of_class"), F.lit(0).alias("tags"), zero("sheet"), zero("rule"), F.col("place").cast("long").alias("place"))
    attributes = said.select("page_id", "ord", F.when(name.startswith("--"), name).otherwise(F.lower(name)).alias("property"), F.trim(F.regexp_replace(value, r"(?i)\s*!\s*important$", "")).alias("value"), F.lit("attribute").alias("origin"), inline.alias("weight"))
    best = F.max(F.struct("weight", "value", "origin"))
    return sheets.union(attributes).groupBy("page_id", "ord", "property").agg(best.alias("b")).select("page_id", "ord", "property", "b.value", "b.origin")


def style_counts(declared: DataFrame) -> DataFrame:
    """How many elements of a page each declared value holds for: (page_id, property, value, elements)."""
    return declared.groupBy("page_id", "property", "value").agg(F.count("*").alias("elements"))
