"""Labels by ordered rules and by weighted votes: owners, corners, page intent, regions, tone, links and tags of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.functions import csstext as T
from swatchwork.operators.usage import first_per_key, top

#: URL words of each page type, in order.
INTENT = [("pricing", "pricing|plans"), ("docs", "docs|documentation|guide|api"), ("blog", "blog|news|posts?"), ("about", "about|team|company"), ("product", "product|features?|shop"), ("legal", "legal|privacy|terms")]
#: Marker words of each tone.
TONES = {"friendly": "hey|welcome|love|easy|happy", "technical": "api|sdk|deploy|latency|config", "bold": "best|never|fastest|revolution|power"}


def owner(tag: Column, classes: Column) -> Column:
    """What an element is for, by tag, then by words of its classes."""
    words = T.class_tokens(classes)
    has = lambda *w: F.arrays_overlap(words, F.array(*(F.lit(x) for x in w)))
    return (
        F.when((tag == "button") | has("btn", "button", "cta"), "button")
        .when(tag.isin("input", "textarea", "select"), "input")
        .when(has("badge", "chip", "tag", "pill"), "badge")
        .when((tag == "nav") | has("nav", "menu"), "navigation")
        .when(tag.isin("img", "video", "picture", "canvas", "svg"), "media")
        .when(has("card", "tile", "panel"), "card")
        .when(tag.isin("p", "span", "li", "a") | tag.rlike("^h[1-6]$"), "text")
        .when(tag.isin("section", "header", "footer", "main"), "section")
        .otherwise("unknown")
    )


def corner(radius: Column, width: Column, height: Column) -> Column:
    """square up to 2 px, circle if the sides are nearly equal and it is fully round, pill if fully round, rounded."""
    side = F.least(width, height)
    near = F.abs(width - height) <= 0.1 * F.greatest(width, height)
    return F.when(radius <= 2, "square").when((radius * 2 >= side) & near, "circle").when(radius * 2 >= side, "pill").otherwise("rounded")


def geometry_votes(elements: DataFrame) -> DataFrame:
    """Per page and owner: the corner of most weight, with its share; mixed if the next is within 0.15. An element weighs the root of its area, 16 to 320."""
    weight = F.greatest(F.lit(16.0), F.least(F.lit(320.0), F.sqrt(F.col("area").cast("double"))))
    rows = elements.select("page_id", owner(F.col("tag"), F.col("class_list")).alias("owner"), corner(T.number(F.col("radius")), F.col("width"), F.col("height")).alias("corner"), weight.alias("w"))
    votes = rows.groupBy("page_id", "owner", "corner").agg(F.round(F.sum("w"), 4).alias("w"))
    line = Window.partitionBy("page_id", "owner")
    votes = votes.withColumn("share", F.round(F.col("w") / F.sum("w").over(line), 4))
    best = votes.withColumn("next", F.coalesce(F.lead("share").over(line.orderBy(F.desc("share"), "corner")), F.lit(0.0)))
    best = first_per_key(best, ["page_id", "owner"], F.desc("share"), F.asc("corner"))
    margin = F.round(F.col("share") - F.col("next"), 4)
    return best.select("page_id", "owner", F.when(margin < 0.15, "mixed").otherwise(F.col("corner")).alias("corner"), "share", margin.alias("margin"))


def visible(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def tag_histogram(pages: DataFrame) -> DataFrame:
    tags = F.explode(F.regexp_extract_all(visible(F.col("html")), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1))
    return pages.select("page_id", tags.alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("uses"))


def all_links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of each page, with the place at which they first stand."""
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(visible(F.col("html")), F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("ord", "href"))
    return rows.groupBy("page_id", "url", "href").agg(F.min("ord").alias("ord"))


def page_links(pages: DataFrame, n: int = 60) -> DataFrame:
    """Distinct link targets of each page in the order in which they first stand, n at most."""
    return top(all_links(pages), ["page_id"], n, F.asc("ord")).select("page_id", "url", "rank", "href")


def internal_links(links: DataFrame) -> DataFrame:
    """Links within the page's host, made whole, without fragments and files."""
    site = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    target = F.when(F.col("href").startswith("/"), F.concat(site, F.col("href"))).otherwise(F.col("href"))
    rows = links.withColumn("target", target).where((T.host(F.col("target")) == T.host(F.col("url"))) & ~F.col("href").contains("#") & ~F.lower("href").rlike(r"\.(png|jpe?g|gif|svg|pdf|zip)$"))
    return rows.where("target != url").select("page_id", "rank", "target")


def page_intent(pages: DataFrame) -> DataFrame:
    """Page type by URL words; the root is the landing page; unknown otherwise."""
    path = F.lower(T.path(F.col("url")))
    label = F.when(path == "/", "landing")
    for name, words in INTENT:
        label = label.when(path.rlike(rf"(^|/)({words})(/|\.|$)"), name)
    return pages.select("page_id", T.host(F.col("url")).alias("host"), path.alias("path"), label.otherwise("unknown").alias("intent"))


def section_regions(pages: DataFrame) -> DataFrame:
    """Landmark elements of each page and their characters of text."""
    out = []
    body = visible(F.col("html"))
    for tag, region in (("nav", "nav"), ("article", "content"), ("footer", "footer"), ("header", "header"), ("aside", "sidebar")):
        block = F.explode(F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)).alias("block")
        text = F.trim(F.regexp_replace(F.regexp_replace("block", r"<[^>]*>", " "), r"\s+", " "))
        out.append(pages.select("page_id", block).select("page_id", F.lit(region).alias("region"), F.length(text).alias("chars")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.union(x)
    return rows.groupBy("page_id", "region").agg(F.count("*").alias("sections"), F.sum("chars").alias("chars"))


def voice(texts: DataFrame) -> DataFrame:
    """Per row (id, text): which tones' words it has, its posture by pronouns, and words a sentence."""
    t = F.lower(F.coalesce("text", F.lit("")))
    letters = F.array_remove(F.split(t, r"[^\p{L}]+"), "")
    sentences = F.greatest(F.regexp_count(t, F.lit(r"[.!?]")), F.lit(1))
    many = lambda words: F.size(F.filter(letters, lambda w: w.isin(words.split("|"))))
    you, we, words = many("you|your|yours"), many("we|our|us"), F.size(letters)
    tones = ((many(w) > 0).alias(n) for n, w in TONES.items())
    posture = F.when(you > we, "you").when(we > you, "we").otherwise("neutral")
    return texts.select("id", *tones, posture.alias("posture"), F.round(words / sentences, 4).alias("words_per_sentence"))
