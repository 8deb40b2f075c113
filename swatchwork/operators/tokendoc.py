"""Token documents of sites: primitive tokens out of what is canonical, semantic ones that refer to them, and the tree of both."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators import palettes
from swatchwork.sources.storage import stored

#: What stands where a site has no colour, no family and no size.
NO_COLOR, NO_FAMILY, NO_SIZE, NO_WEIGHT, LINE_HEIGHT = "#000000", "system-ui", "16px", "400", "1.5"


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy(*order)) - 1)


def token_rows(found: DataFrame) -> DataFrame:
    """(site, path, type, value) of the canonical tokens (site, category, rank, key, value) of each site, in two tiers.

    Primitive: brand colour (the primary one, else the most covered, else NO_COLOR) with its ramp, backgrounds, texts,
    spacings and radii in order of size, shadows and families in order of rank. Semantic: action, surface and text colours,
    control radius and the middle shadow, each a reference in braces to a primitive path, whether or not a site has it;
    and the body's typography as one JSON object, of the first family and the largest size.
    """
    found = stored(found.select("site", "category", "rank", "key", "value"))
    of = lambda *names: found.where(F.col("category").isin(*names))
    sites = found.select("site").distinct()
    main = of("primary", "colors").where("rank = 1").groupBy("site").agg(F.coalesce(F.max(F.when(F.col("category") == "primary", F.col("key"))), F.max("key")).alias("key"))
    brand = sites.join(main, "site", "left").select("site", F.coalesce("key", F.lit(NO_COLOR)).alias("key"))
    ramp = brand.join(palettes.tonal_ramps(brand.select(F.col("key").alias("hex"))).select(F.col("base").alias("key"), "step", "hex"), "key")
    number = F.regexp_extract("key", r"^-?[\d.]+", 0).try_cast("double")
    row = lambda rows, path, kind, value: rows.select("site", path.alias("path"), F.lit(kind).alias("type"), value.alias("value"))
    at = lambda prefix: F.concat(F.lit(prefix), F.col("i").cast("string"))
    rank, px = F.asc("rank"), F.concat("key", F.lit("px"))
    shadows, families, sizes = _ranked(of("shadows"), rank), _ranked(of("typography"), rank), _ranked(of("typeScale"), F.desc(number))
    middle = shadows.groupBy("site").agg(F.floor(F.count("*") / 2).cast("string").alias("i"))
    radii = _ranked(of("borders"), number)
    body = sites.join(families.where("i = 0").select("site", F.col("value").alias("family")), "site", "left").join(sizes.where("i = 0").select("site", F.col("key").alias("size"), F.col("value").alias("weight")), "site", "left")
    text = F.to_json(F.struct(F.coalesce("family", F.lit(NO_FAMILY)).alias("fontFamily"), F.coalesce(F.concat("size", F.lit("px")), F.lit(NO_SIZE)).alias("fontSize"), F.coalesce("weight", F.lit(NO_WEIGHT)).alias("fontWeight"), F.lit(LINE_HEIGHT).alias("lineHeight")))
    refer = lambda path, to, kind: sites.select("site", F.lit(path).alias("path"), F.lit(kind).alias("type"), F.lit(f"{{{to}}}").alias("value"))
    parts = [
        row(brand, F.lit("primitive.color.brand.primary"), "color", F.col("key")),
        row(ramp, F.concat(F.lit("primitive.color.ramp.primary."), F.col("step")), "color", F.col("hex")),
        row(_ranked(of("backgrounds"), rank), at("primitive.color.background.bg"), "color", F.col("key")),
        row(_ranked(of("text"), rank), at("primitive.color.text.text"), "color", F.col("key")),
        row(_ranked(of("spacing"), number), at("primitive.spacing.s"), "dimension", px),
        row(radii, at("primitive.radius.r"), "dimension", px),
        row(shadows, at("primitive.shadow.sh"), "shadow", F.col("key")),
        row(families, at("primitive.fontFamily.f"), "fontFamily", F.col("value")),
        refer("semantic.color.action.primary", "primitive.color.brand.primary", "color"),
        refer("semantic.color.surface.default", "primitive.color.background.bg0", "color"),
        refer("semantic.color.text.body", "primitive.color.text.text0", "color"),
        refer("semantic.radius.control", "primitive.radius.r0", "dimension"),
        row(sites.join(middle, "site", "left"), F.lit("semantic.shadow.elevated"), "shadow", F.concat(F.lit("{primitive.shadow.sh"), F.coalesce("i", F.lit("0")), F.lit("}"))),
        row(body, F.lit("semantic.typography.body"), "typography", text),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for line in batch.column("line").to_pylist():
            tree: dict = {}
            for x in line:
                *above, last = x["path"].split(".")
                node = tree
                for name in above:
                    node = node.setdefault(name, {})
                value = json.loads(x["value"]) if x["type"] == "typography" else x["value"]
                node.setdefault(last, {}).update({"$value": value, "$type": x["type"]})
            texts.append(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column("site"), pa.array(texts, pa.string())], names=["site", "document"])


def token_documents(rows: DataFrame) -> DataFrame:
    """(site, document): the JSON tree of each site's tokens (site, path, type, value), paths cut at dots, in the order of paths.

    What is read back from a document by path, value and type are the rows it was made of. A document is a site's canonical
    tokens, some hundred at most, so that one row holds it.
    """
    lines = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("path", "type", "value"))).alias("line"))
    return lines.mapInArrow(_assemble, "site long, document string")


def resolved(rows: DataFrame) -> DataFrame:
    """The rows with what each value leads to: its own, or that of the path that it names; null if the site has no such path."""
    to = F.regexp_extract("value", r"^\{([\w.-]+)\}$", 1)
    ends = rows.select("site", F.col("path").alias("to"), F.col("value").alias("end"))
    named = rows.withColumn("to", F.when(to != "", to))
    return named.join(ends, ["site", "to"], "left").select("site", "path", "type", "value", F.when(F.col("to").isNull(), F.col("value")).otherwise(F.col("end")).alias("resolved"))
