"""Palettes around another primary, light and dark sides, motion seen: values by hand and by a plain second way."""

import math

import pytest
from pyspark.sql import functions as F

from swatchwork.operators import themes


def _oklch(hex_):
    lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in (int(hex_[k : k + 2], 16) / 255 for k in (1, 3, 5))]
    cones = [math.cbrt(sum(w * x for w, x in zip(m, lin, strict=True))) for m in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    light, a, b = (sum(w * x for w, x in zip(m, cones, strict=True)) for m in ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)))
    return light, math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360


def test_recoloured(spark):
    rows = [(1, "#3366cc", 5, 3), (1, "#CC3366", 5, 2), (1, "#808080", 99, 0), (1, "#abc", 1, 4), (1, "red", 50, 1), (1, None, 3, 9), (2, "#111111", None, 1), (2, "#222222", 4, 2), (3, "transparent", 1, 1), (None, "#00aa00", 1, 1)]
    palette = spark.createDataFrame(rows, "page_id long, hex string, uses long, place long").withColumn("own", F.lit(1)).withColumn("source", F.lit("x"))
    out = [x for x in themes.recoloured(palette, "ff4800").collect()]
    assert len(out) == len(rows)
    got = {(x.page_id, x.hex): x for x in out}
    assert got[1, "#CC3366"].new_hex == "#ff4800" and got[1, "#CC3366"].pinned and got[1, "#3366cc"].source == "#cc3366"
    assert [got[1, x].new_hex for x in ("#808080", "red", None)] == ["#808080", "red", None]
    light, chroma, hue = _oklch("#3366cc")
    shift = (_oklch("#ff4800")[2] - _oklch("#cc3366")[2] + 180) % 360 - 180
    assert got[1, "#3366cc"].hue_shift == pytest.approx(shift, abs=0.006)
    new = _oklch(got[1, "#3366cc"].new_hex)
    assert new[0] == pytest.approx(light, abs=0.02) and abs((new[2] - hue - shift + 180) % 360 - 180) < 8
    assert got[2, "#111111"].new_hex == "#ff4800" and got[2, "#222222"].new_hex == "#222222"  # all neutral: the first one is the primary
    assert (got[3, "transparent"].new_hex, got[3, "transparent"].source, got[3, "transparent"].pinned) == ("transparent", None, False)
    assert got[None, "#00aa00"].new_hex == "#ff4800"
    named = spark.createDataFrame([(1, "#36c"), (9, "#000")], "page_id long, hex string")
    got = {x.hex: x for x in themes.recoloured(palette.where("page_id = 1"), "#0f0", named).collect()}
    assert got["#3366cc"].new_hex == "#00ff00" and got["#CC3366"].source == "#3366cc" and not got["#CC3366"].pinned
    assert themes.recoloured(palette.where("false"), "#0f0").count() == 0
    with pytest.raises(ValueError):
        themes.recoloured(palette, "orange")


def test_turned_text(spark):
    texts = ["linear-gradient(90deg, #36c 0%, #808080, #CC3366)", "none", "", None, "#12", "#12345 x", "#36c#36c"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    got = [x.t for x in frame.select("k", themes.turned_text(F.col("t"), F.lit(0.0)).alias("t")).orderBy("k").collect()]
    assert got == ["linear-gradient(90deg, #3366cc 0%, #808080, #cc3366)", "none", "", None, "#12", "#12345 x", "#3366cc#3366cc"]
    assert [x[0] for x in spark.createDataFrame([(10.0, 350.0), (350.0, 10.0), (0.0, 180.0), (5.0, 5.0)], "a double, b double").select(themes.hue_between(F.col("a"), F.col("b"))).collect()] == [-20.0, 20.0, 180.0, 0.0]


def test_themes(spark):
    roles = "page_id long, role string, hex string"
    light = spark.createDataFrame([(1, "primary", "#ABCDEF"), (1, "text", "#000000"), (1, "accent", ""), (1, "shadow", "#111111"), (2, "text", "#000000")], roles)
    dark = spark.createDataFrame([(1, "primary", "#123456"), (1, "primary", "#123456"), (1, "background", "#000001"), (3, "nothing", None)], roles)
    assert sorted(map(tuple, themes.theme_roles(light, dark).collect())) == [(1, "background", None, "#000001"), (1, "primary", "#abcdef", "#123456"), (1, "text", "#000000", None)]
    variables = "page_id long, name string, value string, place long, light string"
    light = spark.createDataFrame([(1, "--a", "1", 1, ""), (1, "--a", "2", 5, ""), (1, "--b", "x", 1, ""), (1, "--c", None, 1, ""), (1, "--d", "y", 2, ""), (2, "--a", "1", 1, "")], variables)
    dark = spark.createDataFrame([(1, "--a", "2", 1, ""), (1, "--b", "z", 1, ""), (1, "--e", "q", 1, "")], variables)
    found = themes.theme_variables(light, dark)
    assert sorted(map(tuple, found.collect())) == [(1, "--b", "x", "z"), (1, "--d", "y", None), (1, "--e", None, "q")]
    colours = "page_id long, hex string, place long"
    light = spark.createDataFrame([(1, f"#0000{k:02x}", 100 - k) for k in range(30)] + [(1, "#FFFFFF", 0), (2, "#000000", 1), (4, "#0000AA", 1)], colours)
    dark = spark.createDataFrame([(1, "#ffffff", 7), (1, None, 1), (1, "", 1), (4, "#0000aa", 1), (4, "#0000ab", 1), (4, "#0000ab", 2)], colours)
    got = {x.page_id: x for x in themes.theme_audit(light, dark, found).collect()}
    assert sorted(got) == [1, 4]
    assert got[1].missing_in_dark == [f"#0000{k:02x}" for k in range(29, 9, -1)] and got[1].missing_in_light == [] and (got[1].variables, got[1].coverage) == (3, "paired")
    assert (got[4].missing_in_dark, got[4].missing_in_light, got[4].coverage) == ([], ["#0000ab"], "light-only-vars")
    assert themes.theme_audit(light, dark.where("false"), found).count() == 0


def test_motion(spark):
    schema = "page_id long, ord long, trigger string, selector string, name string, duration double, easing string, properties array<string>, kind string"
    rows = [
        (1, 5, "scroll", ".a", "", 199.5, "ease", ["opacity", " transform ", "opacity", ""], "k"),
        (1, 2, "scroll", ".a", "", 200.4, None, ["transform", "opacity"], "k"),  # the same after rounding, and earlier
        (1, 3, "scroll", ".a", "pin", 90.0, None, ["transform"], "k"),
        (1, 4, "scroll", ".a", "pin", 1500.0, "x" * 99, None, "k"),
        (1, 6, "blur", None, "", None, None, [None, ""], "k"),  # nothing in it
        (1, 7, None, "s" * 300, None, float("nan"), None, [], "k"),
        (1, 8, "hover", "", "", -4.0, None, ["color"], "k"),
    ]
    seen = themes.observed_motion(spark.createDataFrame(rows, schema))
    got = {x.ord: x for x in seen.collect()}
    assert sorted(got) == [2, 3, 4, 7, 8]
    assert (got[2].duration, got[2].easing, got[2].properties) == (200, "linear", ["opacity", "transform"])
    assert (got[7].trigger, len(got[7].selector), got[7].duration, got[7].properties) == ("load", 200, 0, []) and len(got[4].easing) == 80
    by = {x.trigger: x for x in themes.motion_by_trigger(seen).collect()}
    assert [(d.name, d.ms, d.css) for d in by["scroll"].durations] == [("xs", 90, "90ms"), ("sm", 200, "200ms"), ("xxl", 1500, "1.5s")]
    assert (by["scroll"].observed, by["scroll"].targets, by["hover"].targets, by["hover"].durations, by["load"].turn) == (3, 1, 0, [], 0)
    recipes = [(x.rank, x.selector, x.kind, x.duration) for x in themes.scroll_recipes(seen).orderBy("rank").collect()]
    assert recipes == [(1, ".a", "reveal", 200), (2, ".a", "parallax", 90), (3, ".a", "pin", 1500)]
    assert themes.motion_by_trigger(seen.where("false")).count() == 0


@pytest.mark.parametrize("query, rows", [("theme_roles", 3), ("theme_variables", 48)])
def test_elements_are_summed_by_page_before_their_colours_are_read(spark, monkeypatch, query, rows):
    from swatchwork.operators import usage
    from swatchwork.plans import catalog
    from swatchwork.plans import themes as plans  # noqa: F401  adds its queries
    from swatchwork.sources import elements

    read, parsed = [], usage.parsed
    monkeypatch.setattr(usage, "parsed", lambda df, *columns: read.append(df.count()) or parsed(df, *columns))
    data = "/root/testdata/sf0.001"
    assert catalog.QUERIES[query](spark, data).count()
    e = elements.from_lineitem(spark, data)
    assert len(read) == 1
    assert read[0] <= rows * e.select("page_id").distinct().count() < e.count()
