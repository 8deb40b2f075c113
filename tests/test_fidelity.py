"""Fidelity of rebuilt pages: identity, what is missing, and every check by hand."""

import math
import random

from test_systems import oklab

from swatchwork.operators import fidelity

PAIR = f"id long, original {fidelity.MOTION}, rebuilt {fidelity.MOTION}"
FULL = ("springy", [200.0, 400.0], [("spring", 3), ("linear", 1)], 2, ["fade", "fade", "slide"], True, [60.0])
EDGE = [
    (FULL, FULL, [1, 1, 1, 1, 1, 1, 1]),
    (FULL, None, [0, 0, 0.5, 0, 0, 0, 0]),
    (None, FULL, [0, 0.7, 0.5, 0.6, 0, 0.6, 0.6]),
    (None, None, [1, 1, 1, 1, 1, 1, 1]),
    (FULL, ("responsive", [210.0, 900.0], [("spring", 1), ("ease-out", 1)], None, ["fade", "spin"], None, [100.0]), [0.5, (1 - 10 / 200 + 1 - 190 / 400) / 2, 1 - (0.25 + 0.25 + 0.5) / 2, 0, 1 / 4, 0, 1 - 40 / (24 * 4)]),
    ((None, [100.0, 0.0, -3.0], None, 0, [], False, []), (None, None, [("linear", None)], 0, None, None, None), [1, 0, 0.5, 1, 1, 1, 1]),
]


def test_motion(spark):
    rows = [(k, a, b) for k, (a, b, _) in enumerate(EDGE)]
    scored = fidelity.motion_fidelity(spark.createDataFrame(rows, PAIR)).cache()
    got = {x.id: x for x in scored.collect()}
    plans = {}
    for x in fidelity.correction_plan(scored).orderBy("id", "rank").collect():
        plans.setdefault(x.id, []).append(x)
    for k, (_, _, want) in enumerate(EDGE):
        assert all(math.isclose(x.score, w, abs_tol=1e-9) for x, w in zip(got[k].aspects, want, strict=True)), (k, got[k].aspects)
        assert got[k].score == math.floor(100 * sum(w * v for w, v in zip(want, fidelity.WEIGHTS.values(), strict=True)) / 11 + 0.5)
        mend = sorted(((-math.floor(round(v * (1 - w), 9) * 100 + 0.5) / 100, at) for at, (w, v) in enumerate(zip(want, fidelity.WEIGHTS.values(), strict=True)) if w < 0.75))
        assert [(-x.gain, list(fidelity.WEIGHTS).index(x.aspect)) for x in plans.get(k, [])] == mend
    assert got[0].score == 100 and 0 not in plans and {x.priority for x in plans[1]} == {"low"}


def band(r, page, k):
    return (page, k, r.choice([None, False, False, True]), r.choice(["hero", "cta", None]), r.choice([None, "", "#ffffff", "#fefefe", "#123456", "bad"]), r.choice([None, None, "", "u"]), r.choice([None, None, True]), r.choice([None, 0, 1, 2]), r.choice([None, "none", "image"]), r.choice([None, 0.0, 100.0, 110.0, 120.0]))


def by_hand(a, b):
    a, b = ([x for x in side if not x[2]] for side in (a, b))
    hits = 0
    for x, y in zip(a, b, strict=False):
        if x[6] or y[6]:
            back = bool(x[6] and y[6])
        elif x[5] or y[5]:
            back = bool(x[5] and y[5])
        elif not x[4] or not y[4]:
            back = not x[4] and not y[4]
        else:
            back = "bad" not in (x[4], y[4]) and math.dist(oklab(x[4]), oklab(y[4])) <= 0.08
        tall = max(x[9] or 0, y[9] or 0)
        hits += (x[3] == y[3]) + back + ((x[7] or 1) == (y[7] or 1)) + ((x[8] or "none") == (y[8] or "none")) + (tall == 0 or abs((x[9] or 0) - (y[9] or 0)) / tall <= 0.15)
    n = max(len(a), len(b))
    return (math.floor(100 * hits / (5 * n) + 0.5), hits, 5 * n, min(len(a), len(b)), abs(len(a) - len(b)), len(a) != len(b)) if n else None


def test_blueprints(spark):
    r = random.Random(6)
    sides = [[[band(r, page, k) for k in range(r.choice([0, 1, 5, 9]))] for page in range(80)] for _ in "ab"]
    frames = [spark.createDataFrame([x for page in side for x in page], fidelity.BANDS).repartition(3) for side in sides]
    got = {x.id: tuple(x)[1:] for x in fidelity.blueprint_fidelity(*frames).collect()}
    want = {page: told for page in range(80) if (told := by_hand(sides[0][page], sides[1][page]))}
    assert got == want and len({x[0] for x in got.values()}) > 10
    same = {x.score for x in fidelity.blueprint_fidelity(frames[0].where("color != 'bad' or color is null"), frames[0].where("color != 'bad' or color is null")).collect()}
    assert same == {100}
    assert fidelity.blueprint_fidelity(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_together(spark):
    rows = spark.createDataFrame([(1, 90, 80), (2, None, 59), (3, 71, None), (4, None, None)], "id long, visual int, motion int")
    assert [(x.overall, x.grade) for x in fidelity.combined(rows).orderBy("id").collect()] == [(86, "B"), (59, "F"), (71, "C"), (None, "unknown")]
