"""Plans of steps that many queries share: what a task holds must not grow with the rows that it reads."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from swatchwork.operators import components, scales, synthesis, usage, vectors
from swatchwork.plans import systems
from swatchwork.sources import elements, stylesheets

DATA = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def aggregate_over_elements(df) -> str:
    """The aggregate that reads element rows themselves, the last one of the plan."""
    return [line for line in plan(df) if "Aggregate" in line][-1]


def test_elements_are_counted_without_sorting(spark):
    counts = synthesis.page_counts(elements.from_lineitem(spark, DATA))
    assert " HashAggregate" in aggregate_over_elements(counts) or "-HashAggregate" in aggregate_over_elements(counts)
    assert not any("SortAggregate" in line for line in plan(counts))


def test_profiles_collect_counted_texts(spark):
    profiles = systems.page_profiles(elements.from_lineitem(spark, DATA))
    last = aggregate_over_elements(profiles)
    assert "ObjectHashAggregate" not in last and "SortAggregate" not in last and "HashAggregate" in last
    assert sum("FileScan" in line for line in plan(profiles)) == 1


def test_styles_move_elements_once_and_hold_none_before(spark):
    lines = plan(usage.common_style(elements.from_lineitem(spark, DATA)))
    exchanges = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 1 and not any("Aggregate" in line for line in lines[exchanges[0] :])


def test_pairs_hold_no_elements_before_they_move(spark):
    lines = plan(usage.all_contrast_pairs(elements.from_lineitem(spark, DATA)))
    moved = next(k for k, line in enumerate(lines) if "Exchange hashpartitioning(page_id" in line and "REPARTITION_BY_COL" in line)
    below = lines[moved : moved + 1 + next(n for n, line in enumerate(lines[moved:]) if "FileScan" in line)]
    assert not any("Aggregate" in line for line in below)


def test_nearest_compares_by_matrices(spark):
    r = random.Random(5)
    some = [(k, [r.choice([None, 0.1, 0.25, 0.3000005, 0.5]) for _ in range(r.choice([2, 3, 4]))]) for k in range(300)]
    rows = [*some, (300, None), (None, [0.1]), (301, []), *((k, [0.5, 0.5, 0.5]) for k in range(400, 460))]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = corpus.where("id % 20 = 0")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).crossJoin(corpus).where("id != query_id")
    pairs = pairs.select("query_id", "id", F.round(vectors.distance(F.col("q"), F.col("vector")), 6).alias("distance")).where("distance is not null")
    want = usage.top(pairs, ["query_id"], 5, F.asc("distance"), F.asc("id"))
    got = vectors.nearest(asked, corpus, block=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any("NestedLoop" in line or "Cartesian" in line for line in plan(got))


def test_neighbours_meet_in_bounded_cells(spark):
    r = random.Random(6)
    some = [(k, [r.choice([0.1, 0.25, 0.3000005, 0.5, *([None, float("inf")] if k % 9 == 0 else [])]) for _ in range(4 - (k % 10 == 0))]) for k in range(300)]
    rows = [*some, (300, None), (None, [0.1]), (301, []), (7, [0.1] * 4), *((k, [0.5] * 4) for k in range(400, 460)), *((k, [r.random() * 10 ** (k % 40 // 8) for _ in range(4)]) for k in range(500, 700))]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    pairs = corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).crossJoin(corpus).where("id != query_id")
    pairs = pairs.select("query_id", "id", F.round(vectors.distance(F.col("q"), F.col("vector")), 6).alias("distance")).where("distance is not null")
    want = sorted(map(str, usage.top(pairs, ["query_id"], 5, F.asc("distance"), F.asc("id")).collect()))
    for size in (8192, 30):
        got = vectors.neighbours(corpus, size=size)
        assert sorted(map(str, got.collect())) == want
        assert not any("NestedLoop" in line or "Cartesian" in line for line in plan(got))


def test_variants_gather_no_group(spark):
    rows = [(page, k * 7919 % 61, kind, None, [float(k % 5), None if k % 3 else 1.0, *([2.0] * (k % 2))]) for page in range(3) for kind in (None, "card", "text") for k in range(61)]
    frame = spark.createDataFrame(rows, "page_id long, ord long, kind string, structural_hash string, style_vector array<double>").repartition(3)
    assert not any("Aggregate" in line for line in plan(components.variants(frame)))
    want = sorted(map(tuple, components.variants(frame).collect()), key=str)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # groups that go on over several batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, components.variants(frame).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sum(x[-1] for x in want) == len(rows) and len({x[:3] for x in want}) == 9


def test_sheets_are_cut_once(spark):
    sheets = spark.range(50).selectExpr("id", "concat(':root{--a:', id, '} @media (x) { b { top: 1px } } @font-face { font-family: F }') AS text")
    assert sum("MapInArrow" in line for line in plan(stylesheets.sheet_facts(sheets))) == 0
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["a{b:c}"] * 50})
    assert [x.num_rows for x in stylesheets._blocks(iter([batch]))] == [50]


def test_ramps_read_colours_without_pages(spark):
    e = elements.from_lineitem(spark, DATA)
    colors = usage.distinct_colors(e)
    assert not any("page_id" in line or "Join" in line for line in plan(colors))
    assert {x.hex for x in colors.collect()} == {x.hex for x in usage.color_usage(e).select("hex").distinct().collect()}


def test_colour_texts_are_read_after_they_are_distinct(spark):
    lines = plan(usage.parsed(elements.from_lineitem(spark, DATA), "color", "background").where("a > 0"))
    lowest = max(k for k, line in enumerate(lines) if "Aggregate" in line)
    assert any("rgba?" in line for line in lines[:lowest]) and not any("rgba?" in line for line in lines[lowest:])


def test_clusters_look_no_seed_up_by_a_join(spark):
    r = random.Random(3)
    rows = {(page, "#%02x%02x%02x" % tuple(r.choice([0, 9, 14, 15, 30, 255]) for _ in range(3))): (r.randint(1, 5), k) for page in (1, None) for k in range(90)}
    frame = spark.createDataFrame([(p, h, u, k) for (p, h), (u, k) in rows.items()], "page_id long, hex string, uses long, first_place long").repartition(3)
    got = scales.color_clusters(frame)
    assert not any("Join" in line for line in plan(got))
    want = []
    for page in (1, None):
        groups = []
        for _, h, u in sorted((k, h, u) for (p, h), (u, k) in rows.items() if p == page):
            c = [int(h[n : n + 2], 16) for n in (1, 3, 5)]
            near = next((g for g in groups if sum((x - y) ** 2 for x, y in zip(g[0], c, strict=True)) < 225), None)
            near[1].append((u, h)) if near else groups.append((c, [(u, h)]))
        want += [(page, max(g, key=lambda x: x[0])[1], sum(u for u, _ in g), len(g)) for _, g in groups]
    assert sorted(((x.page_id, x.hex, x.uses, x.members) for x in got.collect()), key=str) == sorted(want, key=str)


def test_near_colours_meet_once(spark):
    r = random.Random(4)
    rows = sorted({(page, "#%02x%02x%02x" % tuple(r.randint(0, 24) for _ in range(3))) for page in (1, 2) for _ in range(120)})
    got = scales.near_duplicate_colors(spark.createDataFrame(rows, "page_id long, hex string").repartition(3))
    assert sum("Generate" in line for line in plan(got)) == 1
    gap = lambda a, b: sum((int(a[n : n + 2], 16) - int(b[n : n + 2], 16)) ** 2 for n in (1, 3, 5)) ** 0.5
    want = [(p, a, b, round(gap(a, b), 4)) for p, a in rows for q, b in rows if p == q and a < b and gap(a, b) < 8]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_spacings_are_read_once_they_are_distinct(spark):
    lines = plan(scales.spacing_values(elements.from_lineitem(spark, DATA)))
    moved = max(k for k, line in enumerate(lines) if "Exchange" in line)
    assert any("regexp" in line for line in lines[:moved]) and not any("regexp" in line for line in lines[moved:])


def test_units_tell_how_many_values_they_divide(spark):
    pages = {1: [4, 8, 12, 16, 7], 2: [5, 10], 3: [3, 11, 13, 17], 4: [0, 500]}
    rows = [(page, 1, f"{v}px", f"{v}px") for page, values in pages.items() for v in values]
    values = scales.spacing_values(spark.createDataFrame(rows, "page_id long, ord long, padding string, margin string"))
    got = {r.page_id: (r.n_values, r.base_unit, r.on_base) for r in scales.unit_fit(values).collect()}
    assert got == {1: (5, 4, 4), 2: (2, None, 0), 3: (4, None, 0)}
