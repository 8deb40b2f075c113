"""Periodic runs against a search by hand, for texts that repeat in every way."""

import hashlib
import random
import re
import zlib

import pytest

from swatchwork.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            end = i
            while end + p < len(w) and w[end] == w[end + p]:
                end += 1
            if end + p - i >= max(12, 2 * p):
                found.setdefault((i, end + p - i), p)
            i = end
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(k, w):
    if k is None or not w or (h := zlib.crc32(str(k).encode())) % 10:
        return w
    g = h // 10
    a, n = g % len(w), len(w)
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def texts():
    r = random.Random(3)
    yield from (None, "", " \n\t ", "a", "a a", "a " * 11, "a " * 12, "é " * 500, "a b " * 6, "a b " * 5 + "a", "x " + "a b c " * 4 + "y", "   " * 20)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield " ".join(fibonacci[-1])
    yield " ".join("ab"[bin(k).count("1") % 2] for k in range(600))
    for _ in range(150):
        letters = "abcdefgh"[: r.randint(1, 8)]
        yield " ".join(r.choice(letters) for _ in range(r.randint(1, 120)))
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            unit = [r.choice(["the", "of", "Ω", "ship", "sea", "wave"]) for _ in range(r.randint(1, 25))]
            parts += (unit * r.randint(1, 9))[: r.randint(1, 200)]
        yield r.choice([" ", "\n", " \t "]).join(parts)
    yield " ".join(r.choice(["p", "q", "r"]) for _ in range(20_000)) + " " + "long loop of words here now " * 3000


@pytest.fixture(scope="module")
def rows():
    out = [(k * 7, t) for k, t in enumerate(texts())]
    return [*out, out[30], (None, "z " * 30), (None, None)]


SCHEMA = "doc_id long, text string"


def test_by_hand(spark, rows):
    given = [(k, t, "n", 1) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(given, SCHEMA + ", words string, runs int").repartition(3)
    got = {x.doc_id: x for x in runs.periodic_runs(docs).collect()}
    assert len(got) == len(rows)
    many = 0
    for k, t, *_ in given:
        w = WORD.findall(t or "")
        if len(w) > 10_000:
            continue
        want = by_hand(w)
        many += len(want)
        assert [tuple(x) for x in got[k].runs] == want, t
        assert (got[k].n_words, got[k].collapsed) == (len(w), collapsed(w, want))
    assert many > 200
    long = max(got.values(), key=lambda x: x.n_words)
    assert max(x.length for x in long.runs) in (18000, 18001, 18002) and len(long.collapsed.split(" ")) < 21_000


def test_contract(spark, rows):
    want = []
    for k, t in rows:
        w = planted(k, WORD.findall(t or ""))
        if len(w) > 10_000:
            continue
        found = by_hand(w)
        s, n, p = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((k, len(found), s, n, p, 1000 * n // p if p else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(collapsed(w, found))))
    small = [x for x in rows if len(x[1] or "") < 30_000]
    docs = spark.createDataFrame(small, SCHEMA)
    got = runs.digests(runs.periodic_runs(runs.with_planted_runs(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in small) > 10
    assert runs.digests(runs.periodic_runs(runs.with_planted_runs(docs.limit(0)))).count() == 0
