"""Component variants and anatomies by hand, design measurements one by one, and token documents read back."""

import json
import math
import random
import statistics

from swatchwork.operators import components, features, history, tokendoc
from swatchwork.sources import stylesheets


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = ([x or 0.0 for x in v] + [0.0] * (n - len(v)) for v in (a, b))
    x, y = math.hypot(*a), math.hypot(*b)
    return sum(p * q for p, q in zip(a, b, strict=True)) / x / y if x and y else float(x == y)


def found(r, n):
    for k in range(n):
        style = r.choice([None, [], [0.0, 0.0], [1.0, 0.0, None], *([float(r.choice([0, 1, 2, 9])) for _ in range(4)] for _ in range(6))])
        yield (r.randrange(4), k, r.choice(["button", "card", "input", "nav", None, ""]), r.choice(["a", "b", None]), style, r.choice([None, "", "primary", "ghost", "default"]), r.choice([None, "sm", "lg"]), r.choice([None, True, False]), f"c{k}", r.choice([None, "", f"t{k}"]), r.choice([None, [], ["icon"], ["icon", "text"], ["heading", "text", "icon", "badge"]]))


def test_variants_by_hand(spark):
    rows = [*found(random.Random(3), 400)]
    want = []
    for key in {x[0:1] + x[2:4] for x in rows}:
        groups = []
        for x in rows:
            if x[0:1] + x[2:4] == key:
                hit = next((g for g in groups if round(cosine(g[1], x[4] or []), 9) >= 0.95), None)
                if hit:
                    hit[2] += 1
                else:
                    groups.append([x[1], x[4] or [], 1])
        want += [(*key, k, first, n) for k, (first, _, n) in enumerate(groups)]
    frame = spark.createDataFrame(rows, components.CANDIDATE).repartition(5)
    got = sorted(map(tuple, components.variants(frame).collect()), key=str)
    assert got == sorted(want, key=str) and any(x[-1] > 3 for x in got) and len(got) < 350
    assert components.variants(frame.limit(0)).count() == 0


def test_anatomies_by_hand(spark):
    rows = [*found(random.Random(5), 150), (9, 0, "card", None, None, None, None, None, "x", "lone", None)]
    got = {(x.page_id, x.kind): x for x in components.anatomies(spark.createDataFrame(rows, components.CANDIDATE).repartition(5)).collect()}
    groups = {}
    for x in rows:
        groups.setdefault((x[0], x[2] or "other"), []).append(x)
    assert set(got) == {k for k, v in groups.items() if len(v) > 1} and (9, "card") not in got
    order = lambda xs: list(dict.fromkeys(xs))
    for key, x in got.items():
        items = groups[key]
        names = order(i[5] or "default" for i in items)
        of = {n: [i for i in items if (i[5] or "default") == n] for n in names}
        names.sort(key=lambda n: -len(of[n]))
        assert [v.name for v in x.variants] == names and x.instances == len(items)
        shapes = [">".join(i[10] or []) for i in items]
        assert x.slot_shape == max(order(shapes), key=shapes.count)
        for v in x.variants:
            own = of[v.name]
            on, off = ([i for i in own if bool(i[7]) == side] for side in (False, True))
            first = lambda s: s[0][8] if s else None
            assert (v["count"], v.states.default["count"], v.states.default.css, v.states.disabled["count"], v.states.disabled.css) == (len(own), len(on), first(on), len(off), first(off))
            assert [s.name for s in v.sizes] == order(i[6] or "default" for i in own) and [s["count"] for s in v.sizes] == [sum((i[6] or "default") == s.name for i in own) for s in v.sizes]
            assert v.sample_text == [i[9] for i in own[:5] if i[9]]
        assert x.props.variant == [n for n in order(i[5] for i in items if i[5]) if n != "default"] and x.props.size == order(i[6] for i in items if i[6]) and x.props.disabled == any(i[7] for i in items)
        own = items[0][10] or []
        assert x.slots == {"button": {"label": True, "icon": "icon" in own, "badge": "badge" in own}, "card": {"heading": "heading" in own, "description": "text" in own, "media": "icon" in own, "footer": len(own) > 3}, "input": {"leading": "icon" in own, "trailing": False}}.get(key[1], {})


EMPTY = dict.fromkeys(x.split()[0] for x in "page_id colors primary secondary accent backgrounds neutrals scale body weights families spacing base radii widths shadows durations easings springs scroll_linked".split())


def measured(spark, *profiles):
    rows = [tuple((EMPTY | p | {"page_id": k}).values()) for k, p in enumerate(profiles)]
    raw = features.raw_features(spark.createDataFrame(rows, features.PROFILE))
    return [{k: v for k, v in x.asDict().items() if v is not None and k != "page_id"} for x in raw.orderBy("page_id").collect()], raw


def test_measurements(spark):
    full = {
        "colors": ["#ff0000", "#00ff00", "#808080", "none"], "primary": "#ff0000", "backgrounds": ["#ffffff", "#fefefe", "#000000"], "neutrals": ["#808080", "#8a8080"],
        "scale": [(12.0, "18px"), (16.0, "1.5"), (24.0, "normal"), (12.0, None), (0.0, "9px")], "body": (16.0, "24px"), "weights": ["400", "700", "bold"], "families": ["a", "b"],
        "spacing": [4.0, 8.0, 10.0, 0.0, -4.0], "base": 4.0, "radii": [4.0, 8.0, 999.0, None], "widths": [1.0, 2.0], "shadows": [(0.0, 3.0, 4.0, None, None, False), (0.0, 0.0, 8.0, 16.0, "md", None), (9.0, 9.0, 9.0, None, None, True)],
        "durations": [100.0, 300.0, 0.0], "easings": [("ease-out", 3), ("linear", 1)], "springs": ["x"], "scroll_linked": True,
    }
    none, one, bare, no = ({}, {"colors": ["#808080"], "radii": [999.0], "easings": [("linear", 0)], "springs": []}, {"primary": "#00f", "backgrounds": ["#000"], "scale": [(10.0, None), (20.0, None)], "spacing": [3.0]}, {"scale": [(10.0, "15px"), (20.0, "2"), (40.0, "x")], "scroll_linked": False})
    (a, b, c, d, e), raw = measured(spark, full, none, one, bare, no)
    close = lambda x, y: math.isclose(x, y, abs_tol=1e-9)
    want = {
        "chroma_mean": 1, "chroma_max": 1, "hue_count": 2, "hue_spread": 1 - math.hypot((1 + math.cos(math.radians(120))) / 2, math.sin(math.radians(120)) / 2), "neutral_temp": (10 / 244) / 2, "surface_levels": 2, "surface_lightness": (1 + 254 / 255) / 3, "accent_delta": abs(0.5 - (1 + 254 / 255) / 3),
        "scale_ratio": (16 / 12 + 24 / 16) / 2, "scale_regularity": 1 - abs(16 / 12 - (16 / 12 + 1.5) / 2) / ((16 / 12 + 1.5) / 2), "display_contrast": 1.5, "body_line_height": 1.5, "weight_range": 300, "family_count": 2, "base_unit": 4, "ramp_regularity": 2 / 3, "scale_depth": 3, "scale_spread": 2.5,
        "radius_median": 6, "radius_variance": statistics.pstdev([4, 8]), "pill_rate": 1 / 3, "border_weight": 1.5, "shadow_softness": (4 / 7 + 8 / 16) / 2, "elevation_levels": 2, "duration_median": 200, "duration_spread": 200, "springiness": 1 / 3, "ease_out_share": 0.75, "linear_share": 0.25, "scroll_linked": 1,
    }
    assert set(a) == set(want) == {name for _, name, *_ in features.SPEC} and [k for k in want if not close(a[k], want[k])] == []
    assert b == {}
    assert c == {"chroma_mean": 0, "chroma_max": 0, "hue_count": 0, "radius_median": 0, "radius_variance": 0, "pill_rate": 1, "ease_out_share": 0, "linear_share": 0, "springiness": 0}
    assert d == {"chroma_mean": 1, "chroma_max": 1, "hue_count": 1, "hue_spread": 0, "surface_levels": 1, "surface_lightness": 0, "accent_delta": 0.5, "display_contrast": 20 / 15, "scale_depth": 1}
    assert e == {"scale_ratio": 2, "scale_regularity": 1, "display_contrast": 2, "body_line_height": 1.75, "scroll_linked": 0}
    vectors = {x.page_id: x for x in features.design_vectors(raw).collect()}
    assert vectors[0].coverage == 1 and vectors[1].coverage == 0 and vectors[1].vector == [None] * 30 and vectors[0].vector[2] == 2 / 6 and vectors[4].vector[8] == 1
    pairs = spark.createDataFrame([(0, 1), (0, 3), (3, 4)], "x int, y int")
    v = features.design_vectors(raw).select("page_id", "vector")
    rows = pairs.join(v.toDF("x", "a"), "x").join(v.toDF("y", "b"), "y")
    got = {(x.x, x.y): x for x in features.design_distances(rows).collect()}
    assert got[0, 1].distance is None and got[0, 1].compared == 0
    both = [(p, q) for p, q in zip(vectors[0].vector, vectors[3].vector, strict=True) if p is not None and q is not None]
    assert got[0, 3].compared == len(both) == 9 and close(got[0, 3].distance, sum(abs(p - q) for p, q in both) / 9) and got[0, 3].color_compared == 7 and got[0, 3].motion is None
    assert (got[3, 4].compared, got[3, 4].type_compared) == (1, 1)


def test_axis_percentiles(spark):
    ranks = spark.createDataFrame([(1, 0, 0.2), (1, 7, 0.4), (1, 8, 1.0), (2, 29, 0.5)], "id long, feature int, percentile double")
    assert sorted((x.id, x.axis, round(x.percentile, 6), x.features) for x in features.axis_percentiles(ranks).collect()) == [(1, "color", 0.3, 2), (1, "type", 1.0, 1), (2, "motion", 0.5, 1)]


def test_documents_read_back(spark):
    rows = [(1, c, k + 1, key, value) for c, keys in {"primary": [("#4f46e5", "#4f46e5")], "colors": [("#111111", "x")], "backgrounds": [("#ffffff", "w"), ("#eeeeee", "e")], "text": [("#0f172a", "t")], "spacing": [("16", "16"), ("4", "4"), ("8", "8")], "borders": [("8", "8")], "shadows": [(f"0 {k}px 1px", "low") for k in range(3)], "typography": [("inter", "Inter"), ("georgia", 'Geor"gia')], "typeScale": [("16", "400"), ("48", "700")]}.items() for k, (key, value) in enumerate(keys)]
    rows += [(2, "spacing", 1, "4", "4")]
    tokens = tokendoc.token_rows(spark.createDataFrame(rows, "site long, category string, rank int, key string, value string")).cache()
    documents = tokendoc.token_documents(tokens)
    trees = {x.site: json.loads(x.document) for x in documents.collect()}
    assert trees[1]["semantic"]["color"]["action"]["primary"] == {"$value": "{primitive.color.brand.primary}", "$type": "color"}
    assert [trees[1]["primitive"]["spacing"][f"s{k}"]["$value"] for k in range(3)] == ["4px", "8px", "16px"] and len(trees[1]["primitive"]["color"]["ramp"]["primary"]) == 11
    assert trees[1]["semantic"]["shadow"]["elevated"]["$value"] == "{primitive.shadow.sh1}" and trees[1]["semantic"]["typography"]["body"]["$value"] == {"fontFamily": "Inter", "fontSize": "48px", "fontWeight": "700", "lineHeight": "1.5"}
    assert trees[2]["primitive"]["color"]["brand"]["primary"]["$value"] == "#000000"
    back = stylesheets.read_tokens(documents.selectExpr("site AS id", "'t.json' AS name", "document AS text"))
    assert sorted(map(tuple, back.select("id", "path", "type", "value").collect())) == sorted(map(tuple, tokens.collect()))
    ends = {(x.site, x.path): x.resolved for x in tokendoc.resolved(tokens).collect()}
    assert ends[1, "semantic.color.action.primary"] == "#4f46e5" and ends[1, "semantic.color.surface.default"] == "#ffffff" and ends[2, "semantic.color.surface.default"] is None and ends[1, "semantic.radius.control"] == "8px"
    own = tokens.where("site = 1")
    far = {x.path: x.resolved for x in history.resolve_references(own.where("type != 'typography'").select("path", "value")).collect()}
    assert all(ends[1, path] == end for path, end in far.items())
