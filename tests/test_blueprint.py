"""Blueprints against comparisons of every two bands by hand, and the rules of roles."""

import random

import pytest
from pyspark.sql import functions as F

from swatchwork.operators import blueprint as B

SCHEMA = B.BAND + ", page_type string"
NAMES = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ")]
SEEN = "page_id long, ord long, trigger string, top double, name string, duration double, easing string, properties array<string>"


def band(page, ord_, **more):
    plain = {"tag": "section", "role": "", "position": "static", "x": 0.0, "w": 1280.0, "y": 0.0, "h": 400.0, "text": "", "class_name": "", "id": ""}
    return tuple(({"page_id": page, "ord": ord_} | plain | more).get(c) for c in NAMES)


def test_by_hand(spark):
    r = random.Random(11)
    bands, seen = [], []
    for page in range(60):
        n = r.choice([1, 3, 8, 40])
        for k in range(n):
            bands.append(band(page, k, tag=r.choice(["section", "div", "nav", "header", None]), role=r.choice(["", None, "banner"]), position=r.choice(["static", "static", "fixed", "absolute", "sticky", None]), x=r.choice([None, 0.0, 20.0]), w=r.choice([None, 1280.0, 300.0]), y=r.choice([None, *(float(r.randrange(-50, 4000)) for _ in range(9))]), h=r.choice([None, *(float(r.choice([20, 300, 900, 5000])) for _ in range(9))]), media_share=r.choice([None, 0.1, 0.5]), media_kind=r.choice([None, "none", "image"]), heading=r.choice([None, "h"]), heading_size=r.choice([None, 20.0, 48.0])))
        for k in range(r.choice([0, 30])):
            seen.append((page, k, r.choice(["scroll", "scroll", "load", None]), r.choice([None, *(float(r.randrange(-100, 6000)) for _ in range(9))]), r.choice([None, "x", "a-pin"]), r.choice([None, 300.0]), r.choice([None, "ease"]), r.choice([None, [], ["opacity"], ["transform"], ["transform", "opacity"], ["position"]])))
    got = {(x.page_id, x.ord): x for x in B.blueprint(spark.createDataFrame(bands, SCHEMA).repartition(5), spark.createDataFrame(seen, SEEN)).collect()}
    count = {"overlay": 0, "dropped": 0, "reveal": 0}
    for page in range(60):
        own = [dict(zip(NAMES, x, strict=True)) for x in bands if x[0] == page]
        valid = [b for b in own if b["y"] is not None and b["h"] is not None]
        height = max([0, *(b["y"] + b["h"] for b in valid)])
        nav = lambda b: (b["tag"] in ("nav", "header") or b["role"] in ("navigation", "banner")) and (b["y"] <= 200 or b["position"] in ("fixed", "sticky"))
        flow = lambda b: b["position"] not in ("fixed", "absolute", "sticky") and not nav(b)
        wrapper = lambda o: height > 0 and o["h"] > 0.8 * height and (o["h"] > 1600 or any(i is not o and flow(i) and i["y"] >= o["y"] and i["y"] + i["h"] <= o["y"] + o["h"] for i in valid))
        kept = sorted((b for b in valid if not wrapper(b)), key=lambda b: b["y"])
        able = [k for k, b in enumerate(kept) if b["y"] <= 1200 and not nav(b) and not (b["position"] == "fixed" and b["y"] == 0 and b["media_kind"] in (None, "none") and b["heading"] is None and b["heading_size"] is None) and ((b["media_share"] or 0) >= 0.4 or (b["heading_size"] or 0) >= 40)]
        hero = min(able, default=None)
        assert {k for p, k in got if p == page} == {b["ord"] for b in kept}
        for k, b in enumerate(kept):
            x = got[page, b["ord"]]
            edge = lambda e, c: e[c] or 0
            inside = lambda e: edge(b, "x") >= edge(e, "x") - 8 and b["y"] >= e["y"] - 8 and edge(b, "x") + edge(b, "w") <= edge(e, "x") + edge(e, "w") + 8 and b["y"] + b["h"] <= e["y"] + e["h"] + 8
            over = k != hero and (b["position"] in ("fixed", "absolute") or any(map(inside, kept[:k])))
            found = None
            for _, _, trigger, top, name, duration, easing, properties in sorted((s for s in seen if s[0] == page), key=lambda s: s[1]):
                properties = properties or []
                kind = "parallax" if "transform" in properties and "opacity" not in properties else "pin" if "position" in properties or "pin" in (name or "") else "reveal" if "opacity" in properties else None
                if trigger == "scroll" and top is not None and b["y"] <= top < b["y"] + b["h"] and kind:
                    found = (kind, duration or 0.0, easing or "linear")
                    break
            assert (x["index"], x.hero, x.overlay, x.dropped) == (k, k == hero, over, len(valid) - len(kept))
            assert (found is None and x.reveal is None) or (x.reveal, x.duration, x.easing) == found
            count["overlay"] += over
            count["reveal"] += found is not None
        count["dropped"] += len(valid) - len(kept)
    assert min(count.values()) > 5


ROLES = [
    ({"tag": "footer", "text": "faq"}, "footer"),
    ({"tag": "header", "y": 50.0}, "nav"),
    ({"tag": "nav", "y": 900.0}, "content"),
    ({"tag": "nav", "y": 900.0, "position": "sticky"}, "nav"),
    ({"class_name": "Trusted-By"}, "logo-wall"),
    ({"text": "Used by many", "card_count": 6}, "logo-wall"),
    ({"class_name": "bento-x"}, "bento"),
    ({"id": "Carousel"}, "gallery"),
    ({"class_name": "stats", "text": "we are 40% faster"}, "stats"),
    ({"class_name": "stats", "text": "we are faster"}, "content"),
    ({"text": "Frequently asked"}, "faq"),
    ({"text": "How it works", "card_count": 3}, "steps"),
    ({"text": "Free vs paid", "card_count": 2}, "comparison"),
    ({"text": "from $9 a seat", "card_count": 2}, "pricing-table"),
    ({"repeats": 4, "repeats_with_button": 2}, "feature-grid"),
    ({"text": "said the CEO"}, "testimonial"),
    ({"heading": "One", "button_count": 1, "y": 100.0}, "hero"),
    ({"text": "Why this", "card_count": 3}, "feature-grid"),
    ({"text": "Sign up", "button_count": 1}, "cta"),
    ({"text": "x" * 2000 + " faq"}, "content"),
    ({"card_count": 3, "page_type": "blog"}, "blog-grid"),
    ({"text": None, "class_name": None, "id": None, "tag": None}, "content"),
]


def test_roles(spark):
    rows = [band(k, 0, **({"y": 800.0} | x)) for k, (x, _) in enumerate(ROLES)]
    got = {x.page_id: x.role for x in B.blueprint(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SEEN)).collect()}
    assert [got[k] for k in range(len(ROLES))] == [role for _, role in ROLES]


def test_no_pair_of_all(spark):
    bands = spark.createDataFrame([band(1, k, y=k * 10.0) for k in range(50)], SCHEMA)
    rows = B.blueprint(bands, spark.createDataFrame([], SEEN))
    plan = rows._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    line = B.outline(rows).collect()[0]
    assert line.bands == 50 and line.hero_index == -1 and B.outline(rows.limit(0)).count() == 0
    assert rows.where(F.col("overlay")).count() == 0


@pytest.mark.parametrize("size", [10.0, 100_000.0])
def test_long_bands(spark, size):
    rows = [band(1, 0, h=size), band(1, 1, y=1.0, h=5.0), band(1, 2, y=size, h=5.0)]
    got = {x.ord: x.overlay for x in B.blueprint(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SEEN)).collect()}
    assert got == ({0: False, 1: True, 2: True} if size == 10.0 else {1: False, 2: False})


def test_no_table_that_grows_is_broadcast(spark):
    # files of regular bands are small, their rows are not
    bands = spark.createDataFrame([band(p, k, y=100.0 * k) for p in range(20) for k in range(12)], SCHEMA)
    seen = spark.createDataFrame([(p, 0, "scroll", 50.0, "x", 1.0, "ease", ["opacity"]) for p in range(20)], SEEN)
    found = B.blueprint(bands, seen)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("reveal = 'reveal'").count() == 20
