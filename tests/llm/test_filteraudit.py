"""The filter audit against counts by hand, over odd rows."""

import itertools
import random
import re
from collections import Counter

import pytest

from swatchwork.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, labels):
    least = {}
    for k, t, *_ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    cells = []
    for k, t, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > least[t]}
        cells.append((source or "", frozenset(c for c in fails if fails[c]), k in good, k in toxic))
    out, shapley = [], Counter()
    for order in itertools.permutations("ABCDE"):
        for s in range(5):
            f, before = order[s], set(order[:s])
            for part in {c[0] for c in cells}:
                own = [c for c in cells if c[0] == part]
                removed = [c for c in own if f in c[1] and not c[1] & before]
                shapley[part, f] += len(removed)
                kept = sum(not c[1] & (before | {f}) for c in own)
                fails = sum(f in c[1] for c in own)
                out.append([part, "".join(order), s + 1, kept, len(removed), fails - len(removed), sum(c[1] == {f} for c in own), sum(c[2] for c in removed), sum(c[3] for c in removed)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def rows():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(900)]
    texts = [None, "", " \n ", "one", "A B C", "# x", "same " * 300]
    for _ in range(60):
        w = [r.choice(vocabulary[: r.choice([40, 900])]) for _ in range(r.choice([50, 150, 260]))]
        texts.append(" ".join(x.upper() if r.random() < 0.03 else x for x in w) + r.choice(["", "", " 5%", "|"]))
    out = [(k, r.choice(texts), r.choice(["a", "b", None, "", "c"]), "e", True) for k in range(300)]
    out += [(5, out[5][1], "b", "e", True), (5, "other", None, None, None), *[(None, texts[9], "a", None, None)] * 4, (None, None, None, None, None), (1000, "X", "only one", None, None)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None]), "q") for k in range(0, 320, 2)] + [(4, 1, 1, "q"), (4, 0, 0, "q"), (None, 1, 1, "q")]
    return out, labels


def test_by_hand(spark):
    docs, labels = rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, part string, good boolean").repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, digest string")
    got = filteraudit.audit(filteraudit.flag(frame, said), list("ABCDE"))
    assert sorted(tuple(x) for x in got.collect() if x.part is not None) == by_hand(docs, [x[:3] for x in labels])
    together = [x[:2] + (None,) + x[3:] for x in docs]
    assert sorted(("", *x[1:]) for x in got.collect() if x.part is None) == by_hand(together, [x[:3] for x in labels])
    assert filteraudit.audit(filteraudit.flag(frame.limit(0), said), list("ABCDE")).count() == 0
    assert filteraudit.audit(filteraudit.flag(frame, said.limit(0)), list("ABCDE")).where("good_lost + toxic_lost > 0").count() == 0


def test_other_filters(spark):
    frame = spark.createDataFrame([("p", True, None, 1), ("p", False, True, 2), (None, False, False, 3)], "part string, x boolean, y boolean, n int").selectExpr("*", "true AS good", "null AS toxic")
    got = {(x.part, x.filter_order, x.step): x for x in filteraudit.audit(frame, ["x", "y"]).collect()}
    assert len(got) == 3 * 4 and got["p", "xy", 2].kept == 0 and got["", "xy", 2].kept == 1 and got[None, "yx", 1].removed == 1 and got["p", "xy", 1].shapley == 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, duck, sf):
    from conftest import DATA
    from conftest import rows as told

    assert told(filteraudit.op13_filter_audit(spark, DATA).toPandas()) == told(duck.sql(filteraudit.OP13_SQL).df())
