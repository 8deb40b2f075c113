"""Palettes, ramps and site synthesis against folds by hand and facts."""

import math
import random

import pytest

from swatchwork.operators import palettes, synthesis


def channels(hex_):
    return [int(hex_[k : k + 2], 16) / 255 for k in (1, 3, 5)]


def linear(v):
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def lab(hex_):
    r, g, b = map(linear, channels(hex_))
    xyz = ((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047, r * 0.2126729 + g * 0.7151522 + b * 0.0721750, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883)
    x, y, z = (math.cbrt(t) if t > 0.008856 else 7.787 * t + 16 / 116 for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def oklab(hex_):
    r, g, b = map(linear, channels(hex_))
    x, y, z = (math.cbrt(p * r + q * g + s * b) for p, q, s in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)))
    return (0.2104542553 * x + 0.793617785 * y - 0.0040720468 * z, 1.9779984951 * x - 2.428592205 * y + 0.4505937099 * z, 0.0259040371 * x + 0.7827717662 * y - 0.808675766 * z)


def square(p, q):
    return sum((x - y) ** 2 for x, y in zip(p, q, strict=True))


def short(line, k):
    """The palette of (hex, uses) in order, one step at a time."""
    points = [(h, lab(h), max(1, u)) for h, u in line]
    if len(points) <= k:
        return [(h, u, (h,)) for h, _, u in points]
    seeds = [max(points, key=lambda p: p[2])[1]]
    while len(seeds) < k:
        seeds.append(max(points, key=lambda p: min(square(p[1], s) for s in seeds) * math.log1p(p[2]))[1])
    for _ in range(60):
        groups = [[] for _ in seeds]
        for p in points:
            groups[min(range(k), key=lambda i: square(p[1], seeds[i]))].append(p)
        moved = [tuple(sum(p[1][c] * p[2] for p in g) / sum(p[2] for p in g) for c in range(3)) if g else s for g, s in zip(groups, seeds, strict=True)]
        step = sum(map(square, moved, seeds))
        seeds = moved
        if step < 0.5:
            break
    found = [(min(g, key=lambda p: round(square(p[1], s), 9))[0], sum(p[2] for p in g), tuple(p[0] for p in g)) for g, s in zip(groups, seeds, strict=True) if g]
    return sorted(found, key=lambda x: -x[1])


def test_palettes_by_hand(spark):
    r = random.Random(4)
    pages = {}
    for page in range(25):
        n = r.choice([1, 5, 12, 13, 40, 150])
        middle = [r.randrange(256) for _ in range(3)]
        colors = {"#" + "".join(f"{min(255, max(0, int(r.gauss(m, r.choice([3, 60]))))):02x}" for m in middle) for _ in range(n)}
        pages[page] = [(c, r.choice([0, 1, 1, 2, 9, 400])) for c in sorted(sorted(colors), key=lambda _: r.random())]
    rows = [(page, h, u, k, "x") for page, line in pages.items() for k, (h, u) in enumerate(line)] + [(3, "none", 9, 999, "x"), (3, None, 9, 999, "x"), (77, "bad", 1, 1, "x")]
    usage = spark.createDataFrame(rows, "page_id long, hex string, uses long, place long, line string").repartition(4)
    got = {}
    for x in palettes.compressed_palettes(usage).orderBy("page_id", "rank").collect():
        got.setdefault(x.page_id, []).append((x.hex, x.uses, tuple(x.hexes)))
    assert got == {page: short(line, 12) for page, line in pages.items()}
    assert all(len(x) <= 12 for x in got.values()) and palettes.compressed_palettes(usage.limit(0)).count() == 0


def test_ramps(spark):
    rows = palettes.tonal_ramps(spark.createDataFrame([("#4f46e5",), ("rgb(79, 70, 229)",), ("white",), ("#808080",), ("no colour",), (None,)], "hex string")).collect()
    ramps = {}
    for x in rows:
        ramps.setdefault(x.base, {})[x.step] = x.hex
        if x.step == x.anchor:
            assert x.hex == x.base
    assert set(ramps) == {"#4f46e5", "#ffffff", "#808080"} and all(len(x) == 11 for x in ramps.values())
    light = lambda h: sum(channels(h))
    for ramp in ramps.values():
        assert light(ramp["50"]) > light(ramp["500"]) > light(ramp["950"])
    assert all(len({h[1:3], h[3:5], h[5:7]}) == 1 for h in ramps["#808080"].values())  # grey stays grey


def fold(rows, near=synthesis.NEAR):
    """Clusters of (key, uses) in order: each has its present key and uses, and its members."""
    clusters = []
    for key, uses in rows:
        for c in clusters:
            if math.dist(oklab(c[0]), oklab(key)) <= near:
                c[2].append(key)
                if uses > c[1]:
                    c[0], c[1] = key, uses
                break
        else:
            clusters.append([key, uses, [key]])
    return clusters


def test_merged_colors_by_hand(spark):
    r = random.Random(9)
    sites = {}
    for site in range(12):
        base = [r.randrange(256) for _ in range(3)]
        keys = sorted({"#" + "".join(f"{min(255, max(0, b + r.randint(-20, 20))):02x}" for b in base) for _ in range(r.choice([1, 10, 120]))})
        sites[site] = [(k, r.randint(1, 10), r.choice([1, 3, 9, 9, 50]), r.randrange(10**6)) for k in keys]
    rows = [(s, "colors", k, pages, uses, place, 10) for s, line in sites.items() for k, pages, uses, place in line]
    tallied = spark.createDataFrame([*rows, (0, "colors", "grey?", 1, 1, 1, 10)], "site long, category string, key string, pages long, uses long, place long, total long")
    got = {}
    for x in synthesis.merged_colors(tallied).collect():
        got.setdefault(x.site, {}).setdefault((x.cluster, x.lead), set()).add(x.key)
    assert {"grey?"} in got[0].values()
    moved = 0
    for site, line in sites.items():
        order = sorted(line, key=lambda x: (-math.floor(x[1] / 10 * 100 + 0.5), -x[2], x[3], x[0]))
        want = fold([(k, uses) for k, _, uses, _ in order])
        moved += sum(c[0] != c[2][0] for c in want)
        assert sorted((lead, sorted(members)) for (_, lead), members in got[site].items() if lead != "grey?") == sorted((c[0], sorted(c[2])) for c in want)
    assert moved > 3  # keys did change on the way


def test_the_order_decides(spark):
    a, b, c = "#808080", "#8b8b8b", "#979797"  # b is near both, a and c are not near
    assert math.dist(oklab(a), oklab(b)) <= 0.04 and math.dist(oklab(b), oklab(c)) <= 0.04 < math.dist(oklab(a), oklab(c))
    frame = lambda rows: spark.createDataFrame([(1, "colors", k, p, u, i, 10) for i, (k, p, u) in enumerate(rows)], "site long, category string, key string, pages long, uses long, place long, total long")
    leads = lambda rows: {x.key: x.lead for x in synthesis.merged_colors(frame(rows)).collect()}
    assert leads([(a, 9, 1), (b, 8, 5), (c, 7, 2)]) == {a: b, b: b, c: b}  # the key moves from a to b, and c follows it
    assert leads([(a, 9, 5), (b, 8, 1), (c, 7, 2)]) == {a: a, b: a, c: c}


def site(spark, pages):
    """Uses and pages of one site, of dictionaries of category to {key: uses}."""
    uses = [(1, category, k, k, name, n, i * 1000 + j) for i, (name, page) in enumerate(pages) for category, keys in page.items() for j, (k, n) in enumerate(keys.items())]
    names = {}
    for name, _ in pages:
        names[name] = names.get(name, 0) + 1
    return (spark.createDataFrame(uses, "site long, category string, key string, value string, page string, uses long, place long"), spark.createDataFrame([(1, k, n) for k, n in names.items()], "site long, page string, n long"))


PAGE = {"colors": {"#ff4800": 20, "#111111": 30, "#ffffff": 40}, "primary": {"#ff4800": 20}, "typography": {"inter": 40}, "spacing": {"4": 1, "8": 1}, "borders": {"8": 10}}


def test_synthesis(spark):
    uses, pages = site(spark, [("home", PAGE), ("pricing", PAGE), ("blog", PAGE | {"colors": PAGE["colors"] | {"#00cc88": 6, "#fefefe": 50}})])
    found = synthesis.canonical(uses, pages).cache()
    rows = {(x.category, x.key): x for x in found.collect()}
    white = rows["colors", "#fefefe"] if ("colors", "#fefefe") in rows else rows["colors", "#ffffff"]
    assert white.merged == 2 and white.uses == 170 and white.pages == 3 and white.scope == "site-wide"
    assert rows["colors", "#00cc88"].scope == "page-local" and rows["colors", "#00cc88"].coverage == 0.33
    assert [x.key for x in synthesis.outliers(found).collect()] == ["#00cc88"]
    grade = synthesis.grades(found, pages).collect()[0]
    assert grade.letter == "A" and grade.typography == 100 and grade.outliers == 1 and grade.colors == round(100 * 320 / 326)
    assert {x.key for x in synthesis.elected(found).where("category = 'primary'").collect()} == {"#ff4800"}


def test_one_page_has_no_grade_and_names_count_once(spark):
    uses, pages = site(spark, [("home", PAGE)])
    grade = synthesis.grades(synthesis.canonical(uses, pages), pages).collect()[0]
    assert grade.grade is None and grade.letter is None and grade.pages == 1
    uses, pages = site(spark, [("blog", PAGE), ("blog", PAGE), ("home", {"spacing": {"4": 1}})])
    rows = {(x.category, x.key): x for x in synthesis.canonical(uses, pages).collect()}
    assert rows["spacing", "4"].pages == 2 and rows["spacing", "4"].total == 3 and rows["typography", "inter"].coverage == 0.33
    empty = synthesis.grades(synthesis.canonical(uses.limit(0), pages), pages).collect()[0]
    assert (empty.grade, empty.outliers) == (100, 0)


@pytest.mark.parametrize("column", ["value", "uses"])
def test_nulls_in_tallies(spark, column):
    uses, _ = site(spark, [("home", PAGE), ("blog", PAGE)])
    from pyspark.sql import functions as F

    rows = {x.key: x for x in synthesis.tally(uses.where("category = 'borders'").withColumn(column, F.lit(None).cast(dict(uses.dtypes)[column]))).collect()}
    assert rows["8"].pages == 2 and rows["8"].uses == (2 if column == "uses" else 20) and (rows["8"].value is None) == (column == "value")
