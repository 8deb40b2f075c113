"""A page as the ordered list of its bands: which lie over others, which one is the hero, what each is for, and how it appears.

Bands meet other bands and observations by the stretches of the page that they cover: a band has a row for each stretch,
what lies in it one for the stretch of its own top, and both are joined on page and stretch. So neither a page of many
bands nor one of many observations is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.sources.storage import by_shuffle, stored

#: Pixels of a stretch.
STRETCH = 1024
#: Share of the page and viewports from which a band is a wrapper; what makes a hero and how near to the top; nav landmarks; tolerance of an overlay.
OVERSIZED, WRAPPER, HERO_MEDIA, HERO_HEADING, HERO_WITHIN, NAV_TOP, OVERLAY = 0.8, 2, 0.4, 40, 1.5, 200, 8
#: Patterns of texts and class names, matched in any case.
CTA = r"\b(get started|sign ?up|try (free|it|now)|start (free|trial|now)|book a demo|request demo|contact sales|talk to sales|learn more|watch demo)\b"
STATS = r"\b(\d[\d,.]*[+%]|\d+x\b|\$\d+[MBK]\b)"
FAQ = r"\b(frequently asked|faq|common questions|questions & answers)\b"
STEPS = r"\b(step\s?\d|how it works|\d\s*\.\s+[A-Z])"
COMPARE = r"\b(vs\.?|compared to|free vs|basic vs|enterprise vs)\b"
TESTIMONIAL = r'(".{20,}"|—\s?[A-Z][a-z]+\s+[A-Z][a-z]+|ceo|founder|head of)'
PRICING = r"(\$\s?\d|€\s?\d|£\s?\d|per\s?(month|user|seat)|/mo\b|/month|billed)"
LOGOS = r"(trusted by|used by|customers|as seen in|logos?|partners|clients)"
FEATURES = r"(feature|benefit|what you get|why )"
BLOBS = {"logo": r"logo-?(wall|cloud|grid|strip)|trusted-?by", "gallery": "gallery|carousel|slider", "stats": r"stat(s|istic)|metric|number", "faq": r"\bfaq\b", "testimonial": "testimonial|review|quote", "features": "feature|grid"}
TEXT_CHARS = 2000

BAND = """page_id long, ord int, tag string, role string, position string, class_name string, id string, x double, y double, w double, h double,
    text string, heading string, heading_size double, media_kind string, media_share double, button_count int, card_count int, repeats int, repeats_with_button int"""


def _nav() -> Column:
    named = F.lower(F.coalesce("tag", F.lit(""))).isin("nav", "header") | F.lower(F.coalesce("role", F.lit(""))).isin("navigation", "banner")
    return named & ((F.col("y") <= NAV_TOP) | F.coalesce(F.col("position").isin("fixed", "sticky"), F.lit(False)))


def _stretches(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH)))


def section_role(page_type: Column) -> Column:
    """A struct of role and confidence of a section, by ordered rules: landmarks, the hero, classes, then what the text says."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    text = F.substring(whole, 1, TEXT_CHARS)
    blob = F.lower(F.concat(F.coalesce("class_name", F.lit("")), F.lit(" "), F.coalesce("id", F.lit(""))))
    says = lambda pattern: text.rlike(f"(?i){pattern}")
    named = lambda kind: blob.rlike(BLOBS[kind])
    cards, buttons = F.coalesce("card_count", F.lit(0)), F.coalesce("button_count", F.lit(0))
    logos = (cards >= 5) & (F.length(whole) < 300) & F.when(whole == "", F.concat(F.lit(" "), blob)).otherwise(whole).rlike(f"(?i){LOGOS}")
    one = F.coalesce(F.col("heading"), F.lit("")) != ""
    out = F.when(F.col("tag") == "footer", F.struct(F.lit("footer").alias("role"), F.lit(0.95).alias("confidence")))
    rules = [
        ((F.coalesce(F.col("tag"), F.lit("")).isin("nav", "header") | F.coalesce(F.col("role"), F.lit("")).isin("navigation", "banner")) & ((F.coalesce(F.col("y"), F.lit(0.0)) <= NAV_TOP) | F.coalesce(F.col("position").isin("fixed", "sticky"), F.lit(False))), "nav", 0.9),
        (F.col("hero"), "hero", 0.9),
        (named("logo") | logos, "logo-wall", 0.85),
        (blob.contains("bento"), "bento", 0.75),
        (named("gallery"), "gallery", 0.7),
        (named("stats") & says(STATS), "stats", 0.85),
        (says(FAQ) | named("faq"), "faq", 0.85),
        (says(STEPS) & (cards >= 3), "steps", 0.75),
        (says(COMPARE) & (cards >= 2), "comparison", 0.7),
        (says(PRICING) & (cards >= 2), "pricing-table", 0.9),
        ((F.col("repeats") >= 4) & (F.coalesce("repeats_with_button", F.lit(0)) >= F.col("repeats") * 0.5), "feature-grid", 0.85),
        (says(TESTIMONIAL) | named("testimonial"), "testimonial", 0.8),
        (blob.contains("hero") | (one & (buttons >= 1) & (F.col("h") > 300) & (F.col("y") < 400)), "hero", 0.85),
        ((cards >= 3) & (says(FEATURES) | named("features")), "feature-grid", 0.8),
        (says(CTA) & (buttons >= 1) & (F.length(text) < 600), "cta", 0.75),
        ((page_type == "blog") & (cards >= 3), "blog-grid", 0.75),
    ]
    for rule, role, sure in rules:
        out = out.when(rule, F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence")))
    return out.otherwise(F.struct(F.lit("content").alias("role"), F.lit(0.3).alias("confidence")))


def kept_bands(bands: DataFrame, viewport: float = 800) -> DataFrame:
    """The bands (BAND, and page_type) without wrappers, with their index by top, whether each is the hero, and how many wrappers their page lost.

    A band taller than OVERSIZED of the page is a wrapper if it is taller than WRAPPER viewports or another band that lies
    in the flow is inside its vertical range. Bands without top or height are left out.
    """
    valid = bands.where("y is not null and h is not null")
    pages = valid.groupBy("page_id").agg(F.greatest(F.lit(0.0), F.max(F.col("y") + F.col("h"))).alias("page_height"))
    valid = stored(valid.join(by_shuffle(pages), "page_id").withColumn("nav", _nav()))
    large = valid.where((F.col("page_height") > 0) & (F.col("h") > F.col("page_height") * OVERSIZED))
    tall = F.col("h") > viewport * WRAPPER
    flow = valid.where(~F.coalesce(F.col("position").isin("fixed", "absolute", "sticky"), F.lit(False)) & ~F.col("nav")).select("page_id", F.col("ord").alias("in_ord"), F.col("y").alias("in_y"), (F.col("y") + F.col("h")).alias("in_end"), F.floor(F.col("y") / STRETCH).alias("stretch"))
    outer = large.where(~tall).select("page_id", "ord", "y", (F.col("y") + F.col("h")).alias("end"), _stretches(F.col("y"), F.col("y") + F.col("h")).alias("stretch"))
    holds = outer.join(by_shuffle(flow), ["page_id", "stretch"]).where("in_ord != ord and in_y >= y and in_end <= end").select("page_id", "ord")
    wrappers = stored(large.where(tall).select("page_id", "ord").union(holds).distinct())
    dropped = wrappers.groupBy("page_id").agg(F.count("*").alias("dropped"))
    kept = valid.join(by_shuffle(wrappers), ["page_id", "ord"], "left_anti").join(by_shuffle(dropped), "page_id", "left").fillna(0, ["dropped"])
    index = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "ord")) - 1
    kept = kept.withColumn("index", index)
    empty = (F.col("position") == "fixed") & (F.col("y") == 0) & (F.coalesce("media_kind", F.lit("none")) == "none") & F.col("heading").isNull() & F.col("heading_size").isNull()
    able = (F.col("y") <= viewport * HERO_WITHIN) & ~F.col("nav") & ~F.coalesce(empty, F.lit(False)) & ((F.coalesce("media_share", F.lit(0.0)) >= HERO_MEDIA) | (F.coalesce("heading_size", F.lit(0.0)) >= HERO_HEADING))
    hero = F.min(F.when(able, F.col("index"))).over(Window.partitionBy("page_id"))
    return kept.withColumn("hero", F.coalesce(F.col("index") == hero, F.lit(False))).drop("nav", "page_height")


def overlays(kept: DataFrame) -> DataFrame:
    """(page_id, ord) of the bands that lie on top of others: pinned or absolute ones, and those inside the box of an earlier one. The hero is none."""
    edge = lambda c: F.coalesce(c, F.lit(0.0))
    box = lambda p: (edge(F.col("x")).alias(f"{p}x"), F.col("y").alias(f"{p}y"), (edge(F.col("x")) + edge(F.col("w"))).alias(f"{p}right"), (F.col("y") + F.col("h")).alias(f"{p}end"))
    free = kept.where(~F.col("hero"))
    pinned = free.where(F.col("position").isin("fixed", "absolute")).select("page_id", "ord")
    inner = free.where(~F.coalesce(F.col("position").isin("fixed", "absolute"), F.lit(False))).select("page_id", "ord", "index", *box(""), F.floor(F.col("y") / STRETCH).alias("stretch"))
    outer = kept.select("page_id", F.col("index").alias("o_index"), *box("o_"), _stretches(F.col("y") - OVERLAY, F.col("y") + F.col("h") + OVERLAY).alias("stretch"))
    inside = (F.col("x") >= F.col("o_x") - OVERLAY) & (F.col("y") >= F.col("o_y") - OVERLAY) & (F.col("right") <= F.col("o_right") + OVERLAY) & (F.col("end") <= F.col("o_end") + OVERLAY)
    same = (inner["page_id"] == outer["page_id"]) & (inner["stretch"] == outer["stretch"])
    return pinned.union(inner.join(by_shuffle(outer), same & (F.col("o_index") < F.col("index")) & inside, "left_semi").select("page_id", "ord"))


def reveals(kept: DataFrame, observations: DataFrame) -> DataFrame:
    """(page_id, ord, reveal, duration, easing): for each band the first scroll observation (page_id, ord, trigger, top, name, duration, easing, properties) whose top it covers and that tells how it appears."""
    has = lambda p: F.array_contains("properties", p)
    props = F.coalesce("properties", F.array().cast("array<string>"))
    kind = F.when(has("transform") & ~has("opacity"), "parallax").when(has("position") | F.coalesce(F.col("name"), F.lit("")).contains("pin"), "pin").when(has("opacity"), "reveal")
    seen = observations.where("trigger = 'scroll' and top is not null").withColumn("properties", props)
    seen = seen.select("page_id", F.col("ord").alias("turn"), "top", kind.alias("reveal"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("easing", F.lit("linear")).alias("easing"), F.floor(F.col("top") / STRETCH).alias("stretch")).where("reveal is not null")
    spans = kept.select("page_id", "ord", "y", (F.col("y") + F.col("h")).alias("end"), _stretches(F.col("y"), F.col("y") + F.col("h")).alias("stretch"))
    met = spans.join(by_shuffle(seen), ["page_id", "stretch"]).where("top >= y and top < end")
    return met.groupBy("page_id", "ord").agg(F.min(F.struct("turn", "reveal", "duration", "easing")).alias("f")).select("page_id", "ord", "f.reveal", "f.duration", "f.easing")


def blueprint(bands: DataFrame, observations: DataFrame, viewport: float = 800) -> DataFrame:
    """(page_id, index, ord, role, confidence, hero, overlay, reveal, duration, easing, dropped) of the bands that count, by page in reading order.

    ``bands`` has BAND and page_type; observations as in ``reveals``. Where several bands of a page have one ord, they stand
    for one band and share its overlay and reveal. Null texts, classes and counts say nothing; a null page type is none.
    """
    kept = stored(kept_bands(bands, viewport))
    over = overlays(kept).distinct().withColumn("overlay", F.lit(True))
    rows = kept.join(by_shuffle(over), ["page_id", "ord"], "left").join(by_shuffle(reveals(kept, observations)), ["page_id", "ord"], "left")
    rows = rows.withColumn("said", section_role(F.coalesce("page_type", F.lit(""))))
    return rows.select("page_id", F.col("index").cast("int").alias("index"), "ord", "said.role", "said.confidence", "hero", F.coalesce("overlay", F.lit(False)).alias("overlay"), "reveal", "duration", "easing", F.col("dropped").cast("long").alias("dropped"))


def outline(rows: DataFrame) -> DataFrame:
    """(page_id, bands, dropped, hero_index, reading_order) of ``blueprint`` rows; the hero is the first band of that role, -1 without one."""
    line = F.array_sort(F.collect_list(F.struct("index", "role")))
    return rows.groupBy("page_id").agg(F.count("*").alias("bands"), F.max("dropped").alias("dropped"), F.coalesce(F.min(F.when(F.col("role") == "hero", F.col("index"))), F.lit(-1)).alias("hero_index"), F.array_join(F.transform(line, lambda x: x["role"]), " > ").alias("reading_order"))
