"""One system out of the pages of a site: tallies with page sets, merged colours, scopes, and a grade of consistency."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T
from swatchwork.operators.usage import first_per_key, interactive, top
from swatchwork.sources.storage import stored

#: OKLab distance up to which two colours are one.
NEAR = 0.04
#: Categories whose keys are colours; what each category weighs in the grade; how many keys a canonical list takes.
COLORS = ("colors", "backgrounds", "text", "primary")
WEIGHTS = {"colors": 0.35, "typography": 0.25, "spacing": 0.2, "borders": 0.2}
LISTED = {"backgrounds": 6, "text": 10, "primary": 1}
OUTLIERS = 25


def scope(share: Column) -> Column:
    return F.when(share >= 0.8, "site-wide").when(share >= 0.4, "section").otherwise("page-local")


#: Area from which a background counts as a page's; text colours that a page takes; families that name no font.
LARGE, TEXTS, GENERIC = 50_000, 10, ("serif", "sans-serif", "monospace", "system-ui", "inherit")


def page_counts(elements: DataFrame) -> DataFrame:
    """What each page's elements say, counted by source and text in one pass: (page_id, source, text, weight, n, acts, first, first_large); sizes of fonts are counted by weight too.

    Only numbers are aggregated: a text in an aggregate would have all element rows sorted.
    """
    sources = ("color", "background", "font_family", "font_size", "padding", "margin", "radius", "shadow")
    said = F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("text"), (F.col("font_weight") if c == "font_size" else F.lit(None).cast("string")).alias("weight")) for c in sources))).alias("s")
    rows = elements.select("page_id", "ord", "area", interactive().alias("acting"), said)
    return rows.where("s.text is not null").groupBy("page_id", "s.source", "s.text", "s.weight").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("acting"), 1)).alias("acts"), F.min("ord").alias("first"), F.min(F.when(F.col("area") > LARGE, F.col("ord"))).alias("first_large")
    )


def page_uses(elements: DataFrame) -> DataFrame:
    """(page_id, category, key, value, uses, turn): the colours, fonts, sizes, spacings, radii and shadows of each page; turn orders the keys of a category.

    Element rows are read once; all categories come from their counts.
    """
    counts = stored(page_counts(elements))
    of = lambda *sources: counts.where(F.col("source").isin(*sources))
    seen = of("color", "background").select("*", C.parse_color(F.col("text")).alias("c")).where("c.a > 0").select("page_id", "source", "n", "acts", "first", "first_large", C.to_hex(F.col("c")).alias("hex"))
    seen = stored(seen.groupBy("page_id", "source", "hex").agg(F.sum("n").alias("n"), F.sum("acts").alias("acts"), F.min("first").alias("first"), F.min("first_large").alias("first_large")))
    back = F.col("source") == "background"
    place = F.col("first") * 2 + back.cast("int")
    colors = seen.groupBy("page_id", "hex").agg(F.sum("n").alias("uses"), F.min(place).alias("turn"), F.sum(F.when(back, F.col("acts")).otherwise(0)).alias("acts"))
    size = T.number(F.col("text"))
    whole = lambda x: x.cast("long").cast("string")
    family = F.trim(F.substring_index("text", ",", 1))
    named = of("font_family").withColumn("family", family).where(~F.lower("family").isin(*GENERIC)).groupBy("page_id", "family").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    sized = lambda source: of(source).select("page_id", size.alias("x"), "n", "first", "weight").where("x is not null").groupBy("page_id", "x").agg(F.sum("n").alias("n"), F.min_by("weight", "first").alias("weight"))
    spaces = of("padding", "margin").select("page_id", T.half_up(size).alias("x")).where("x > 0 and x < 500").distinct()
    blur = F.regexp_extract("text", r"^\S+ \S+ ([\d.]+)px", 1).try_cast("double")
    depth = F.when(blur == 0, "flat").when(blur <= 4, "low").when(blur <= 12, "mid").otherwise("high")
    one = F.lit(1)
    parts = {
        "colors": colors.select("page_id", "hex", "hex", "uses", "turn"),
        "backgrounds": seen.where(back & F.col("first_large").isNotNull()).select("page_id", "hex", "hex", one, "first_large"),
        "text": top(seen.where(~back), ["page_id"], TEXTS, F.asc("first")).select("page_id", "hex", "hex", one, F.col("rank").cast("long")),
        "primary": first_per_key(colors.where("acts > 0"), ["page_id"], F.desc("acts"), F.asc("turn")).select("page_id", "hex", "hex", "acts", "turn"),
        "typography": named.select("page_id", F.lower("family"), "family", "n", "first"),
        "typeScale": sized("font_size").select("page_id", whole(F.col("x")), "weight", "n", F.col("x").cast("long")),
        "spacing": spaces.select("page_id", whole(F.col("x")), whole(F.col("x")), one, F.col("x").cast("long")),
        "borders": sized("radius").where("x > 0").select("page_id", whole(F.col("x")), whole(F.col("x")), "n", F.col("x").cast("long")),
        "shadows": of("shadow").where("text != 'none'").select("page_id", "text", depth, one, blur.cast("long")),
    }
    rows = None
    for name, part in parts.items():
        part = part.toDF("page_id", "key", "value", "uses", "turn").select("page_id", F.lit(name).alias("category"), "key", "value", F.col("uses").cast("long").alias("uses"), "turn")
        rows = part if rows is None else rows.union(part)
    return rows


def tally(uses: DataFrame) -> DataFrame:
    """(site, category, key, value, pages, uses, place) of single uses (site, category, key, value, page, uses, place).

    ``pages`` counts distinct pages; ``value`` is the one of the largest single use, the first of equals; ``place`` is where
    the key first stands. Null keys are left out; a null number of uses counts as one.
    """
    rows = uses.where("key is not null").withColumn("uses", F.coalesce(F.col("uses").cast("long"), F.lit(1)))
    best = F.max(F.when(F.col("value").isNotNull(), F.struct("uses", (-F.col("place")).alias("back"), "value")))["value"]
    return rows.groupBy("site", "category", "key").agg(best.alias("value"), F.countDistinct("page").alias("pages"), F.sum("uses").alias("uses"), F.min("place").alias("place"))


class _Merged:
    """Clusters in the order in which they begin. Each is found by the cell of its present key, whose side is the distance."""

    def __init__(self, near: float):
        self.near, self.keys, self.cells = near, [], defaultdict(set)

    def _cell(self, x: tuple) -> tuple[int, ...]:
        return tuple(math.floor(v / self.near) for v in x)

    def add(self, x: tuple[float, float, float], uses: int) -> int:
        """The cluster that the colour joins: the first whose key is near, or a new one. A colour of more uses becomes its key."""
        a, b, c = self._cell(x)
        around = (k for da in (-1, 0, 1) for db in (-1, 0, 1) for dc in (-1, 0, 1) for k in self.cells.get((a + da, b + db, c + dc), ()))
        hit = min((k for k in around if math.dist(self.keys[k][0], x) <= self.near), default=None)
        if hit is None:
            hit = len(self.keys)
            self.keys.append((x, uses))
        elif uses > self.keys[hit][1]:
            self.cells[self._cell(self.keys[hit][0])].discard(hit)
            self.keys[hit] = (x, uses)
        else:
            return hit
        self.cells[(a, b, c)].add(hit)
        return hit


def _merge(near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, found, leads = [], [], [], []
            for n, line in enumerate(batch.column("line")):
                rows = line.values
                merged = _Merged(near)
                own = [merged.add(x, uses) for *x, uses in zip(*(rows.field(c).to_pylist() for c in ("l", "a", "b", "uses")), strict=True)]
                names = rows.field("key").to_pylist()
                lead: dict[int, tuple[int, str]] = {}
                for k, name, uses in zip(own, names, rows.field("uses").to_pylist(), strict=True):
                    if k not in lead or uses > lead[k][0]:
                        lead[k] = (uses, name)
                at += [n] * len(own)
                keys += names
                found += own
                leads += [lead[k][1] for k in own]
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("site").take(pick), batch.column("category").take(pick), pa.array(keys, pa.string()), pa.array(found, pa.int32()), pa.array(leads, pa.string())], names=["site", "category", "key", "cluster", "lead"])

    return run


def merged_colors(tallied: DataFrame, near: float = NEAR) -> DataFrame:
    """(site, category, key, cluster, lead): which colours (key) of (site, category, key, pages, uses, place, total) stand for one.

    In the order of coverage (two decimals), then uses, then place, each colour joins the first cluster whose present key is
    within ``near`` in OKLab, and becomes its key if it has more uses; the order thus decides, and the fold is one group a
    site and category over its distinct colours. Near keys are found by cells, not by comparing with all clusters.
    Keys that are no colour are clusters of their own.
    """
    lab = T.bound(C.parse_color(F.col("key")), C.to_oklab)
    share = T.half_up(F.col("pages") / F.col("total") * 100)
    rows = tallied.select("site", "category", "key", "uses", lab.alias("lab"), F.struct((-share).alias("share"), (-F.col("uses")).alias("less"), "place", "key").alias("turn"))
    # a text that is no colour lies far from all others
    far = F.lit(1000.0) + F.abs(F.xxhash64("key")) % 1_000_000_007
    at = lambda c: F.coalesce(F.col("lab")[c], far if c == "l" else F.lit(0.0)).alias(c)
    lines = rows.groupBy("site", "category").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "uses", *(at(c) for c in "lab")))).alias("line"))
    lines = lines.select("site", "category", F.transform("line", lambda x: F.struct(x["key"].alias("key"), x["uses"].alias("uses"), *(x[c].alias(c) for c in "lab"))).alias("line"))
    schema = S.StructType([lines.schema["site"], lines.schema["category"], *S.StructType.fromDDL("key string, cluster int, lead string").fields])
    return lines.mapInArrow(_merge(near), schema)


def canonical(uses: DataFrame, pages: DataFrame, near: float = NEAR) -> DataFrame:
    """The tokens that a site's pages share: (site, category, rank, key, value, pages, uses, coverage, scope, merged).

    ``uses`` has (site, category, key, value, page, uses, place), ``pages`` (site, page, n): pages of one kind may share a
    name, so that the total is the sum of n and a name counts once. Colours are merged first; the most used colour of a
    cluster stands for it, and its pages are those of all its members. Ranked by coverage (two decimals), uses, and place.
    """
    rows = stored(uses.where("key is not null").withColumn("uses", F.coalesce(F.col("uses").cast("long"), F.lit(1))))
    totals = pages.groupBy("site").agg(F.sum("n").alias("total"))
    tallied = stored(tally(rows).join(totals, "site"))
    colored = F.col("category").isin(*COLORS)
    merged = stored(merged_colors(tallied.where(colored), near))
    # a colour's uses by page find their cluster, so that the sets of pages unite without being gathered
    lead = merged.select("site", "category", F.col("key").alias("member"), "cluster", "lead")
    by_page = rows.where(colored).groupBy("site", "category", F.col("key").alias("member"), "page").agg(F.sum("uses").alias("uses")).join(lead, ["site", "category", "member"])
    groups = by_page.groupBy("site", "category", "cluster", F.col("lead").alias("key")).agg(F.countDistinct("page").alias("pages"), F.sum("uses").alias("uses"), F.countDistinct("member").alias("merged"))
    values = tallied.select("site", "category", "key", "value", "total")
    groups = groups.join(values, ["site", "category", "key"]).select("site", "category", "key", "value", "pages", "uses", "merged", "total", F.col("cluster").cast("long").alias("turn"))
    plain = tallied.where(~colored).select("site", "category", "key", "value", "pages", "uses", F.lit(1).cast("long").alias("merged"), "total", F.col("place").cast("long").alias("turn"))
    share = F.col("pages") / F.col("total")
    found = groups.union(plain).select("*", (T.half_up(share * 100) / 100).alias("coverage"), scope(share).alias("scope"))
    rank = F.row_number().over(Window.partitionBy("site", "category").orderBy(F.desc("coverage"), F.desc("uses"), F.asc("turn"), F.asc("key")))
    return found.select("site", "category", rank.alias("rank"), "key", "value", "pages", "uses", "coverage", "scope", "merged", "total")


def elected(found: DataFrame) -> DataFrame:
    """The canonical lists: of ``canonical`` rows those that a site's profile takes, as many as LISTED says."""
    keep = F.lit(True)
    for category, n in LISTED.items():
        keep = keep & ((F.col("category") != category) | (F.col("rank") <= n))
    return found.where(keep)


def outliers(found: DataFrame, n: int = OUTLIERS) -> DataFrame:
    """Tokens of the graded categories that one page alone uses, twice at least, and that are not site-wide: the most used n of each site."""
    order = F.coalesce(*(F.when(F.col("category") == c, i) for i, c in enumerate(("colors", "typography", "spacing", "borders"))))
    rows = found.where(order.isNotNull() & (F.col("scope") != "site-wide") & (F.col("pages") == 1) & (F.col("uses") >= 2)).withColumn("turn", order)
    return top(rows.select("site", "category", "key", "uses", "coverage", "turn", F.col("rank").alias("at")), ["site"], n, F.desc("uses"), F.asc("turn"), F.asc("at")).select("site", "rank", "category", "key", "uses", "coverage")


def grades(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, pages, a score for each graded category, grade, letter, outliers): how much of a site's use is of site-wide tokens.

    A category's score is the share of its uses that are of site-wide tokens, in percent, 100 without any use. The grade is
    the weighted mean; a site of one page has none.
    """
    totals, found = pages.groupBy("site").agg(F.sum("n").alias("total")), stored(found)
    wide = F.when(F.col("scope") == "site-wide", F.col("uses")).otherwise(0)
    part = lambda c, x: F.sum(F.when(F.col("category") == c, x))
    share = found.groupBy("site").agg(*(F.coalesce(part(c, wide) / F.nullif(part(c, F.col("uses")), F.lit(0)), F.lit(1.0)).alias(c) for c in WEIGHTS))
    odd = outliers(found).groupBy("site").agg(F.count("*").alias("outliers"))
    rows = totals.join(share, "site", "left").join(odd, "site", "left").fillna(1.0, list(WEIGHTS)).fillna(0, ["outliers"])
    mean = sum(F.col(c) * w for c, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    grade = F.when(F.col("total") >= 2, T.half_up(F.round(mean * 100, 9)).cast("int"))
    rows = rows.select("site", F.col("total").alias("pages"), *(T.half_up(F.round(F.col(c) * 100, 9)).cast("int").alias(c) for c in WEIGHTS), grade.alias("grade"), "outliers")
    letter = F.coalesce(*(F.when(F.col("grade") >= least, x) for x, least in (("A", 90), ("B", 80), ("C", 70), ("D", 60))), F.when(F.col("grade").isNotNull(), "F"))
    return rows.withColumn("letter", letter)
