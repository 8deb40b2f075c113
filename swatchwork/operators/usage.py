"""Counts of what the elements of each page use: colours, families, sizes, radii, layers, shadows, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def interactive() -> Column:
    """Elements that a user acts upon, by tag or class."""
    return F.col("tag").isin("a", "button") | F.lower("class_list").rlike("btn|button|link|cta")


def parsed(rows: DataFrame, *columns: str) -> DataFrame:
    """(text, hex, r, g, b, a, luminance) of the distinct colour texts in these columns: each is read once, however many elements have it."""
    texts = rows.select(F.explode(F.array(*columns)).alias("text")).distinct()
    # out of an outer explode, as a filter on the text alone is pushed below the distinct, where every element would be read
    colors = texts.select("text", F.explode_outer(F.array(C.parse_color(F.col("text")))).alias("c")).where("c is not null")
    read = colors.select("text", "c.*").distinct()  # the second distinct keeps the reading out of what follows
    return read.select("text", C.to_hex(F.struct("r", "g", "b")).alias("hex"), "r", "g", "b", "a", C.luminance(F.struct("r", "g", "b")).alias("luminance"))


def color_usage(elements: DataFrame) -> DataFrame:
    """Per page and colour: places, contexts, background area and interactive backgrounds, first element and first place (an element's text comes before its background)."""
    use = F.explode(F.array(*(F.struct(F.lit(c).alias("context"), F.col(col).alias("text")) for c, col in (("text", "color"), ("background", "background"))))).alias("use")
    rows = elements.select("page_id", "ord", "area", interactive().alias("acts"), use)
    # a page has few distinct texts of colours: they are counted first and read then
    texts = rows.groupBy("page_id", "use.context", "use.text").agg(F.count("*").alias("uses"), F.sum("area").alias("area"), F.count(F.when(F.col("acts"), 1)).alias("acts"), F.min("ord").alias("first_ord"))
    texts = texts.join(parsed(elements, "color", "background").where("a > 0").select("text", "hex"), "text")
    back = F.col("context") == "background"
    return texts.groupBy("page_id", "hex").agg(
        F.sum("uses").alias("uses"),
        F.array_join(F.array_sort(F.collect_set("context")), ",").alias("contexts"),
        F.sum(F.when(back, F.col("area")).otherwise(0)).alias("background_area"),
        F.sum(F.when(back, F.col("acts")).otherwise(0)).alias("interactive"),
        F.min("first_ord").alias("first_ord"),
        F.min(F.col("first_ord") * 2 + back.cast("int")).alias("first_place"),
    )


def distinct_colors(elements: DataFrame) -> DataFrame:
    """(hex): the colours that elements use, other than transparent ones, each once; no page and no count is kept for them."""
    return parsed(elements, "color", "background").where("a > 0").select("hex").distinct()


def dominant_colors(elements: DataFrame, n: int = 8) -> DataFrame:
    """Colours by their share of all background area of the page, three decimals."""
    use = color_usage(elements).where("background_area > 0")
    share = F.round(F.col("background_area") / F.sum("background_area").over(Window.partitionBy("page_id")), 3)
    return top(use.select("page_id", "hex", "background_area", share.alias("share"), "first_ord"), ["page_id"], n, F.desc("background_area"), F.asc("first_ord"), F.asc("hex")).drop("first_ord")


def large_surfaces(elements: DataFrame, least: int = 50_000) -> DataFrame:
    rows = elements.where(F.col("area") > least).groupBy("page_id", "background").agg(F.min("ord").alias("first_ord"))
    rows = rows.groupBy("page_id", C.to_hex(C.parse_color(F.col("background"))).alias("hex")).agg(F.min("first_ord").alias("first_ord"))
    return rows.where("hex is not null")


def text_colors(elements: DataFrame, n: int = 10) -> DataFrame:
    """Distinct text colours in the order in which they first stand."""
    rows = elements.groupBy("page_id", C.to_hex(C.parse_color(F.col("color"))).alias("hex")).agg(F.min("ord").alias("first_ord")).where("hex is not null")
    return top(rows, ["page_id"], n, F.asc("first_ord"))


def family_histogram(elements: DataFrame) -> DataFrame:
    """First family of each list that is not generic: places, and whether headings or body text use it."""
    family = F.trim(F.substring_index("font_family", ",", 1))
    rows = elements.withColumn("family", family).where(~F.lower("family").isin("serif", "sans-serif", "monospace", "system-ui", "inherit"))
    head = F.col("tag").rlike("^h[1-6]$")
    return rows.groupBy("page_id", "family").agg(F.count("*").alias("uses"), F.bool_or(head).alias("headings"), F.bool_or(F.col("tag").isin("p", "span", "li")).alias("body"), F.min("ord").alias("first_ord"))


def type_scale(elements: DataFrame) -> DataFrame:
    """Per page and font size: places, tags, and the weight of the first element of that size."""
    size = T.number(F.col("font_size"))
    return elements.groupBy("page_id", size.alias("size")).agg(F.count("*").alias("uses"), F.min_by("font_weight", "ord").alias("weight"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def body_size(elements: DataFrame) -> DataFrame:
    """The most frequent size of text elements, the first seen of several."""
    rows = elements.where(F.col("tag").isin("p", "span", "li")).groupBy("page_id", T.number(F.col("font_size")).alias("size")).agg(F.count("*").alias("uses"), F.min("ord").alias("first_ord"))
    return first_per_key(rows, ["page_id"], F.desc("uses"), F.asc("first_ord")).select("page_id", "size", "uses")


def common_style(elements: DataFrame, props: tuple[str, ...] = ("color", "font_size", "padding", "radius", "shadow")) -> DataFrame:
    """Per page, tag and property: the most frequent value other than none, auto, normal and transparent."""
    # few elements of a page share tag and value, so that counts before the shuffle would only fill memory: elements move once
    elements = elements.select("page_id", "tag", "ord", *props).repartition("page_id")
    rows = elements.select("page_id", "tag", "ord", F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in props))).alias("s")).select("page_id", "tag", "ord", "s.*")
    rows = rows.where(F.col("value").isNotNull() & ~F.col("value").isin("none", "auto", "normal", "transparent", ""))
    counts = rows.groupBy("page_id", "tag", "property", "value").agg(F.count("*").alias("uses"), F.min("ord").alias("first_ord"))
    return first_per_key(counts, ["page_id", "tag", "property"], F.desc("uses"), F.asc("first_ord")).select("page_id", "tag", "property", "value", "uses")


def button_variants(elements: DataFrame) -> DataFrame:
    """Buttons by background: the most frequent is primary, the next secondary, others variant-n; white ones are ghost."""
    rows = elements.where((F.col("tag") == "button") | F.lower("class_list").rlike("btn")).groupBy("page_id", C.to_hex(C.parse_color(F.col("background"))).alias("hex")).agg(F.count("*").alias("uses"), F.min("ord").alias("first_ord"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("uses"), F.asc("first_ord")))
    rows = rows.withColumn("rank", rank)
    name = F.when(F.col("hex") == "#ffffff", "ghost").when(F.col("rank") == 1, "primary").when(F.col("rank") == 2, "secondary").otherwise(F.concat(F.lit("variant-"), F.col("rank").cast("string")))
    return rows.select("page_id", "hex", "uses", "rank", name.alias("variant"))


#: Tags that hold text of their own, for which contrast counts.
TEXT_TAGS = """p a button label li h1 h2 h3 h4 h5 h6 td th code pre em strong small b i u time summary figcaption blockquote q mark cite abbr
dt dd kbd samp var sub sup del ins caption legend span""".split()


def all_contrast_pairs(elements: DataFrame) -> DataFrame:
    """Text on background, by pair of opaque, unequal colours of elements that hold text: places, largest size, ratio and its level, first element.

    A pair is large from 18 pixels on, or from 14 if one of its elements is a ``b``; its largest element counts.
    """
    # pairs of texts are counted first and read then
    texts = elements.where(F.lower("tag").isin(TEXT_TAGS)).select("page_id", "ord", "tag", "color", "background", "font_size")
    # hardly two elements of a page share all three, so that counts before the shuffle would only fill memory: elements move once
    rows = texts.repartition("page_id").groupBy("page_id", "color", "background", "font_size").agg(F.count("*").alias("n"), F.bool_or(F.lower("tag") == "b").alias("bold"), F.min("ord").alias("ord"))
    read = parsed(elements, "color", "background").where("a >= 0.9").select("text", "hex", "luminance")
    rows = rows.join(read.toDF("color", "fg", "fg_light"), "color").join(read.toDF("background", "bg", "bg_light"), "background").where("fg != bg")
    rows = rows.withColumn("size", T.number(F.col("font_size")))
    pairs = rows.groupBy("page_id", "fg", "bg", "fg_light", "bg_light").agg(F.sum("n").alias("uses"), F.max("size").alias("max_size"), F.bool_or("bold").alias("bold"), F.min("ord").alias("first_ord"))
    ratio = (F.greatest("fg_light", "bg_light") + 0.05) / (F.least("fg_light", "bg_light") + 0.05)
    large = F.coalesce((F.col("max_size") >= 18) | ((F.col("max_size") >= 14) & F.col("bold")), F.lit(False))
    return pairs.withColumn("large", large).select("page_id", "fg", "bg", "uses", "max_size", "large", ratio.alias("ratio"), C.contrast_level(ratio, F.col("large")).alias("level"), "first_ord")


def contrast_pairs(elements: DataFrame, n: int = 50) -> DataFrame:
    """The first n pairs of each page, with their rank: failing ones first, then by places, then as they first stand."""
    pairs = all_contrast_pairs(elements).withColumn("ratio", F.round("ratio", 4))
    return top(pairs, ["page_id"], n, F.desc(F.col("level") == "FAIL"), F.desc("uses"), F.asc("first_ord"), F.asc("fg"), F.asc("bg")).drop("first_ord")


def contrast_score(elements: DataFrame) -> DataFrame:
    """Share of places whose pair passes, in percent with halves up; 100 for a page without pairs."""
    counts = all_contrast_pairs(elements).groupBy("page_id").agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("level") != "FAIL", F.col("uses")).otherwise(0)).alias("passing"), F.sum("uses").alias("uses"))
    rows = elements.select("page_id").distinct().join(counts, "page_id", "left").fillna(0, ["pairs", "passing", "uses"])
    score = F.when(F.col("uses") == 0, 100).otherwise(T.half_up(100.0 * F.col("passing") / F.nullif("uses", F.lit(0)))).cast("int")
    return rows.select("page_id", "pairs", "passing", (F.col("uses") - F.col("passing")).alias("failing"), score.alias("score"))


def contrast_remediation(elements: DataFrame, palette: DataFrame) -> DataFrame:
    """For each failing pair the palette's colour (hex, rank) of best contrast that passes on the background; first of equals.

    The palette is a row for each of a few colours, checked here.
    """
    if palette.limit(1001).count() > 1000:
        raise ValueError("a palette has at most 1000 colours")
    failing = all_contrast_pairs(elements).where("level = 'FAIL'").select("page_id", "fg", "bg", "large")
    backs = failing.select("bg", "large").distinct()
    choice = parsed(palette, "hex").select(F.col("text").alias("hex"), F.col("luminance").alias("light")).join(palette, "hex")
    light = parsed(backs, "bg").select(F.col("text").alias("bg"), F.col("luminance").alias("bg_light"))
    ratio = (F.greatest("light", "bg_light") + 0.05) / (F.least("light", "bg_light") + 0.05)
    choices = backs.join(light, "bg").join(F.broadcast(choice)).withColumn("r", F.round(ratio, 6)).where(F.col("r") >= F.when(F.col("large"), 3.0).otherwise(4.5))
    best = choices.groupBy("bg", "large").agg(F.max(F.struct("r", (-F.col("rank")).alias("minus"), "hex")).alias("best"))
    return failing.join(best, ["bg", "large"], "left").select("page_id", "fg", "bg", "large", F.col("best.hex").alias("suggestion"), F.round("best.r", 4).alias("new_ratio"))


def nearest_palette(elements: DataFrame, palette: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Each page's colours with the palette's nearest (first of equals) and whether they are within the tolerance."""
    if palette.limit(1001).count() > 1000:
        raise ValueError("a palette has at most 1000 colours")
    used = color_usage(elements).select("page_id", "hex")
    own = parsed(used, "hex").select(F.col("text").alias("hex"), F.struct("r", "g", "b").alias("c"))
    tokens = parsed(palette, "hex").select(F.col("text").alias("token"), F.struct("r", "g", "b").alias("t")).join(palette.withColumnRenamed("hex", "token"), "token")
    pairs = own.join(F.broadcast(tokens)).select("hex", "token", "rank", F.round(C.rgb_distance(F.col("c"), F.col("t")), 4).alias("d"))
    near = pairs.groupBy("hex").agg(F.min(F.struct("d", "rank", "token")).alias("near"))
    return used.join(near, "hex").select("page_id", "hex", F.col("near.token").alias("token"), F.col("near.d").alias("distance"), (F.col("near.d") <= tolerance).alias("known"))


def drift_verdict(nearest: DataFrame) -> DataFrame:
    """in-sync at ratio 0, minor-drift below 0.15, notable-drift below 0.4, major-drift above."""
    ratio = F.count(F.when(~F.col("known"), 1)) / F.count("*")
    rows = nearest.groupBy("page_id").agg(F.count("*").alias("colors"), F.count(F.when(~F.col("known"), 1)).alias("unknown"), F.round(ratio, 4).alias("drift_ratio"))
    r = F.col("unknown") / F.col("colors")
    return rows.withColumn("verdict", F.when(r == 0, "in-sync").when(r < 0.15, "minor-drift").when(r < 0.4, "notable-drift").otherwise("major-drift"))


def z_layers(elements: DataFrame) -> DataFrame:
    """Integer z-index values by layer."""
    z = F.col("z_index").try_cast("int")
    layer = F.when(z >= 1000, "modal").when(z >= 100, "dropdown").when(z >= 10, "sticky").otherwise("base")
    return elements.where(z.isNotNull()).groupBy("page_id", layer.alias("layer")).agg(F.count("*").alias("uses"), F.min(z).alias("lowest"), F.max(z).alias("highest"), F.countDistinct(z).alias("values"))


def shadow_usage(elements: DataFrame) -> DataFrame:
    """Per page and shadow text: places and the blur, with its depth class."""
    blur = F.regexp_extract("shadow", r"^\S+ \S+ ([\d.]+)px", 1).try_cast("double")
    depth = F.when(blur == 0, "flat").when(blur <= 4, "low").when(blur <= 12, "mid").otherwise("high")
    return elements.where("shadow is not null and shadow != 'none'").groupBy("page_id", "shadow").agg(F.count("*").alias("uses"), F.first(blur).alias("blur"), F.first(depth).alias("depth"))


def motion_profile(elements: DataFrame) -> DataFrame:
    """Per page, duration band and easing family: transitions and their mean duration. Each layer of a transition counts."""
    texts = elements.groupBy("page_id", "transition").agg(F.count("*").alias("n"))
    read = texts.select("transition").distinct().select("transition", F.explode(T.layers(F.col("transition"))).alias("layer")).distinct()
    m = lambda k: F.regexp_extract("layer", r"^\S+ (\S+) (.+)$", k)
    ms = T.milliseconds(m(1))
    many = read.groupBy("transition", T.duration_band(ms).alias("band"), T.easing_family(m(2)).alias("easing")).agg(F.count("*").alias("layers"), F.sum(ms).alias("ms"))
    rows = texts.join(many, "transition").groupBy("page_id", "band", "easing").agg(F.sum(F.col("n") * F.col("layers")).alias("uses"), F.sum(F.col("n") * F.col("ms")).alias("ms"))
    return rows.select("page_id", "band", "easing", "uses", F.round(F.col("ms") / F.col("uses"), 4).alias("mean_ms"))


def radius_histogram(elements: DataFrame) -> DataFrame:
    return elements.groupBy("page_id", T.number(F.col("radius")).alias("radius")).agg(F.count("*").alias("uses"), F.max("area").alias("max_area")).where("radius > 0")
