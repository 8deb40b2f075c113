"""Near-duplicates against brute force on groups of near copies, worn texts and shared passages."""

import random

import pytest
from test_ops import edited, prose, words

from swatchwork.llm import neardup


def brute(texts, n):
    sets = {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for k, t in texts.items()}
    part = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and x and y and part[a] != part[b] and 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if p == old else p for k, p in part.items()}
    return part


@pytest.mark.parametrize("sketch", [neardup.SKETCH, None, 16])
def test_groups(spark, sketch):
    r = random.Random(8)
    shared = prose(300, 100)
    texts = {}
    for group in range(6):
        base = shared + " " + prose(60 + 40 * group, group)  # groups that overlap with each other, with and without a link
        for k in range(25):
            texts[len(texts)] = edited(base, r.choice([0, 0.005, 0.01, 0.02, 0.03]), 1000 * group + k)
    for k in range(60):
        texts[len(texts)] = shared + " " + prose(r.randint(50, 140), 5000 + k)  # a passage that many texts hold, no copies
    for k in range(20):
        texts[len(texts)] = " ".join(words(shared)[: 100 + 10 * k])  # a chain of texts, each linked with the next ones
    want = brute(texts, 5)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame, sketch=sketch).collect()}
    if sketch == 16:  # a small sketch loses links, but makes none up
        assert all(want[k] <= c for k, c in got.items())
    else:
        assert got == want


def test_a_group_of_worn_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(3)
    base, texts = [f"w{k}" for k in range(120)], {}
    for k in range(120):  # many are too far from the text that all come from; some share their edits with others
        w = list(base)
        for at in r.sample(range(5, 115), r.choice([0, 2, 3, 3, 4, 4])):
            w[at] = f"x{at}"
        texts[k] = " ".join(w)
    compared = []
    overlaps = neardup._Texts.overlaps

    def counted(self, pairs):
        compared.append(pairs.count())
        return overlaps(self, pairs)

    monkeypatch.setattr(neardup._Texts, "overlaps", counted)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame).collect()}
    assert got == brute(texts, 5)
    assert len(set(got.values())) > 10
    assert compared[-1] < 4 * len(texts), compared
