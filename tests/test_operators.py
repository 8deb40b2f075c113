"""Values by hand for functions, folds and state."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T
from swatchwork.operators import classify, compare, history, scales, tokens, usage, vectors
from swatchwork.streaming import watch


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("#fff", (255, 255, 255, 1.0)), ("rgb(1, 2, 3)", (1, 2, 3, 1.0)), ("rgba(1 2 3 / 0.5)", (1, 2, 3, 0.5)), (" RED ", (255, 0, 0, 1.0)), ("#00000080", (0, 0, 0, 128 / 255)), ("transparent", (0, 0, 0, 0.0)), ("none", None), ("", None)],
)
def test_parse_color(spark, text, want):
    got = value(spark, C.parse_color(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_color_functions(spark):
    black, white, red = (C.parse_color(F.lit(x)) for x in ("#000", "#fff", "#f00"))
    assert value(spark, C.contrast(black, white)) == pytest.approx(21)
    assert value(spark, C.to_hex(red)) == "#ff0000"
    assert tuple(value(spark, C.to_hsl(red))) == (0, 100, 50)
    assert value(spark, C.to_oklab(white))["l"] == pytest.approx(1, abs=1e-4)
    assert value(spark, C.to_lab(white))["l"] == pytest.approx(100, abs=0.01)
    assert value(spark, C.space_distance(C.to_lab(black), C.to_lab(black))) == 0


@pytest.mark.parametrize(("text", "want"), [("16px", 16.0), ("-1.5em", -1.5), (".5rem", 0.5), ("normal", None), (None, None)])
def test_number(spark, text, want):
    assert value(spark, T.number(F.lit(text).cast("string"))) == want


def test_css_text(spark):
    assert value(spark, T.layers(F.lit("a, rgb(1, 2, 3), b"))) == ["a", "rgb(1, 2, 3)", "b"]
    assert value(spark, T.milliseconds(F.lit("0.2s"))) == 200
    assert [value(spark, T.easing_family(F.lit(x))) for x in ("ease-in", "cubic-bezier(0.3, 1.5, 0.6, 1)", "steps(2)", "x")] == ["ease-in", "spring", "steps", "custom"]
    curves = {"": "linear", "ease": "ease-in-out", "cubic-bezier(0.4, 0, 0.2, 1)": "custom", "cubic-bezier(.1,0.5,.9,0.5)": "ease-in-out", "cubic-bezier(0.1, 0.1, 0.5, 1)": "ease-out", "cubic-bezier(0.5, 0.4, 0.9, 0.9)": "ease-in", "cubic-bezier(0.3, 0.1, 0.5, 0.2)": "ease-in", "cubic-bezier(0.2, 0.6, 0.4, 1)": "ease-out", "cubic-bezier(0, 0, x, 1)": "custom", "cubic-bezier(0, 0)": "custom"}
    assert {x: value(spark, T.easing_family(F.lit(x))) for x in curves} == curves
    assert value(spark, T.class_tokens(F.lit("btn primaryCta"))) == ["btn", "primary", "cta"]
    assert value(spark, T.normalized_url(F.lit("HTTPS://A.com/x/?q=1#f"))) == "https://a.com/x?q=1"
    assert value(spark, T.half_up(F.lit(-2.5))) == -2
    assert value(spark, classify.corner(F.lit(20.0), F.lit(40), F.lit(40))) == "circle"


def test_anchored_clusters(spark):
    values = spark.createDataFrame([(1, x) for x in (1, 2, 3, 4, 9, 10, 12)], "page_id long, value int")
    assert sorted((r.anchor, r.members) for r in scales.anchored_clusters(values, 2).collect()) == [(1, 3), (4, 1), (9, 2), (12, 1)]


def test_contrast_score_counts_places(spark):
    def e(ord_, fg, bg, tag="p", size="16px"):
        return (1, ord_, tag, fg, bg, size)

    shown = [e(k, "#000000", "#ffffff") for k in range(9)] + [e(10, "#aaaaaa", "#ffffff"), e(11, "#aaaaaa", "#bbbbbb", "div"), e(12, "#000000", "rgba(0, 0, 0, 0.5)"), e(13, "#767676", "#767676")]
    frame = spark.createDataFrame([*shown, (2, 1, "div", "#aaaaaa", "#ffffff", "16px")], "page_id long, ord long, tag string, color string, background string, font_size string")
    assert sorted((r.page_id, r.pairs, r.passing, r.failing, r.score) for r in usage.contrast_score(frame).collect()) == [(1, 2, 9, 1, 90), (2, 0, 0, 0, 100)]
    assert [(r.fg, r.level, r.uses) for r in usage.contrast_pairs(frame).orderBy("rank").collect()] == [("#aaaaaa", "FAIL", 1), ("#000000", "AAA", 9)]
    bold = spark.createDataFrame([e(1, "#888888", "#ffffff", "b", "14px"), e(2, "#888888", "#ffffff", "p", "12px")], frame.schema)
    assert usage.contrast_pairs(bold).first().level == "AA"


def test_type_ratio_facts(spark):
    pages = {1: [16, 20, 25, 31.25], 2: [12, 12.1, 12.2], 3: [16, 20], 4: [10, 14, 15, 27, 28, 80]}
    values = spark.createDataFrame([(k, float(x)) for k, xs in pages.items() for x in xs], "page_id long, value double")
    got = {r.page_id: r for r in scales.type_ratio(values).collect()}
    assert (got[1].ratio_name, got[1].ratio, got[1].fit, got[1].coverage, got[1].anchor) == ("major third", 1.25, 1.0, 1.0, 16.0)
    assert [got[k].ratio_name for k in (2, 3)] == ["none", "none"] and got[3].steps == 2


def test_breakpoint_labels(spark):
    rows = [(1, 1, "(min-width: 47.99em) and (max-width: 900px)"), (1, 2, "(max-width: 320px)"), (1, 3, "(min-width: 560px)"), (1, 4, "(max-width: 768px)"), (1, 5, "print")]
    got = {r.px: (r.kind, r.label) for r in tokens.breakpoints(spark.createDataFrame(rows, "page_id long, ord long, query string")).collect()}
    assert got == {768: ("max-width", "md"), 900: ("max-width", "900px"), 320: ("max-width", "xs"), 560: ("min-width", "560px")}


def test_color_clusters(spark):
    colors = spark.createDataFrame([(1, "#000000", 5, 1), (1, "#050505", 3, 2), (1, "#ffffff", 4, 3)], "page_id long, hex string, uses long, first_place long")
    assert sorted((r.hex, r.uses, r.members) for r in scales.color_clusters(colors).collect()) == [("#000000", 8, 2), ("#ffffff", 4, 1)]


def test_vectors(spark):
    d = lambda a, b: value(spark, vectors.distance(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")))
    assert d([0.0, 1.0], [1.0, 1.0]) == 0.5
    part = spark.createDataFrame([(1, [0.5, None]), (2, [None, 0.2])], "id long, vector array<double>")
    assert vectors.nearest(part, part).count() == 0  # no feature that both have


def test_references(spark):
    tokens = spark.createDataFrame([("a", "{b}"), ("b", "{c}"), ("c", "1px"), ("x", "{y}"), ("y", "{x}"), ("z", "{no}")], "path string, value string")
    assert {r.path: r.resolved for r in history.resolve_references(tokens).collect()} == {"a": "1px", "b": "1px", "c": "1px", "x": None, "y": None, "z": None}


def test_references_of_any_length(spark):
    chain = [(f"t{k}", f"{{t{k + 1}}}") for k in range(40)] + [("t40", "1px")]
    lost = [(f"u{k}", f"{{u{k + 1}}}") for k in range(20)] + [("x", "{x}"), ("y", "{x}")]
    tokens = spark.createDataFrame([*chain, *lost], "path string, value string")
    got = {r.path: (r.resolved, r.hops) for r in history.resolve_references(tokens).collect()}
    assert got == {f"t{k}": ("1px", 40 - k) for k in range(41)} | {k: (None, None) for k, _ in lost}


def test_flat_tokens(spark):
    from swatchwork.operators import tokens

    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"$value":1.50}}}}}}}'
    rows = [(1, '{"color":{"$type":"color","red":{"$value":"#f00","$type":"x"},"link":{"$value":"{color.red}"}},"note":"n"}'), (2, deep), (3, '{"p":{"q":{"r":{"s":{"t":{"u":"v"}}}}},"w":"{p.q}","$x":1,"z":null,"l":[1,2]}')]
    rows += [(4, '{"s":{"$value":{"x":1,"y":["é",true]}},"l":[{"$value":2}]}'), (5, None), (6, "no"), (7, "{}"), (8, '{"k":"\\ud800"}')]
    got = tokens.flat_tokens(spark.createDataFrame(rows, "id long, json string")).collect()
    want = {(1, "color.red", "#f00"), (1, "color.link", "{color.red}"), (2, "a.b.c.d.e.f", "1.50"), (3, "p.q.r.s.t.u", "v"), (3, "w", "{p.q}"), (3, "z", None), (3, "l", "[1,2]"), (4, "s", '{"x":1,"y":["é",true]}'), (4, "l.0", "2"), (8, "k", "?")}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_route_reconcile_takes_all_routes(spark, duck):
    from conftest import DATA, rows

    from swatchwork.operators import compare
    from swatchwork.plans import catalog

    want = duck.sql(catalog.SQL["route_reconcile"].replace(" WHERE route % 24 = 0", "")).df()
    assert rows(catalog.QUERIES["route_reconcile"](spark, DATA).toPandas()) == rows(want)
    tokens = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (2, "b", "y"), (1, "c", "x"), (3, "c", "z")], "route int, token string, value string")
    assert {(r.token, r.routes, r.values, r.status) for r in compare.reconcile_routes(tokens).collect()} == {("a", 3, 1, "shared"), ("b", 1, 1, "added"), ("c", 2, 2, "changed")}


@pytest.mark.parametrize("name", ["vector_knn", "vector_outliers", "vector_percentiles"])
def test_vectors_are_whole(spark, duck, name):
    from conftest import DATA, rows

    from swatchwork.plans import catalog

    size = int(duck.sql("SELECT max(len(embedding)) AS n FROM embeddings").df()["n"][0])
    sql = catalog.SQL[name].replace("embedding[1:30]", "embedding").replace("generate_series(1, 30)", f"generate_series(1, {size})").replace("x + y) / 30", f"x + y) / {size}")
    assert size > 30
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(sql).df())


def test_every_vector_asks_for_its_neighbours(spark, duck):
    from conftest import DATA

    from swatchwork.plans import catalog

    every = {(x, 5) for (x,) in duck.sql("SELECT vec_id FROM embeddings").fetchall()}
    got = catalog.QUERIES["vector_knn"](spark, DATA).groupBy("query_id").count().collect()
    assert {tuple(r) for r in got} == every == set(duck.sql(f"SELECT query_id, count(*) FROM ({catalog.SQL['vector_knn']}) GROUP BY query_id").fetchall())


def test_sites_count_all_links(spark, tmp_path):
    from swatchwork.plans import catalog

    html = "".join(f'<a href="/{k}">x</a>' for k in range(70))
    spark.createDataFrame([(k, f"http://h.com/{k}", html + f'<a href="/own{k}">x</a>') for k in (1, 2)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    cover = catalog.QUERIES["site_coverage"](spark, str(tmp_path)).collect()
    assert len(cover) == 72 and {r.value for r in cover if r.scope == "site-wide"} == {f"/{k}" for k in range(70)}
    assert catalog.QUERIES["site_consistency"](spark, str(tmp_path)).first()["consistency"] == round(140 / 142, 4)
    assert catalog.QUERIES["page_links"](spark, str(tmp_path)).count() == 120


def test_consistency_of_one_page_is_unknown(spark):
    rows = spark.createDataFrame([("s", 1, "v", 3)], "site string, page long, value string, uses int")
    assert compare.consistency(compare.coverage(rows)).first()["consistency"] is None


def test_stream_equals_batch(spark, tmp_path):
    data = pd.DataFrame({"key": [1, 1, 1, 2], "seq": [1, 2, 3, 1], "ms": [0, 10, 2000, 5], "value": ["a", "b", "b", "z"]})
    spark.createDataFrame(data).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key long, seq long, ms long, value string").parquet(str(tmp_path / "in"))
    got = watch.drained(watch.watch(stream().select("key", "seq", "value")), "w", str(tmp_path)).collect()
    assert [(r.key, r.seq, r.before, r.value) for r in got] == [(1, 2, "a", "b")]
    got = watch.drained(watch.rate_limit(stream().select("key", "seq", "ms"), 1, 1000), "r", str(tmp_path)).collect()
    assert sorted((r.key, r.seq, r.allowed) for r in got) == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True)]


def test_order_does_not_matter(spark):
    """The same rows in other partitions give the same results."""
    from conftest import DATA

    from swatchwork.operators import usage
    from swatchwork.sources import elements

    e = elements.from_lineitem(spark, DATA)
    one, two = (sorted(map(tuple, usage.dominant_colors(x).collect())) for x in (e, e.repartition(7, "ord")))
    assert one == two
