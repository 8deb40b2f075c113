"""Alignments of lines against the plain table, in one piece and in halves."""

import random

import pytest

from swatchwork.llm import pages


@pytest.mark.parametrize("table", [1 << 22, 12])
def test_longest_common_subsequence(monkeypatch, table):
    monkeypatch.setattr(pages, "TABLE", table)
    r = random.Random(1)
    for _ in range(300):
        a, b = [[r.choice("abcdefg"[: r.randint(1, 7)]) for _ in range(r.randint(0, 14))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, pages.shared(a, b), strict=True) if k]
        assert len(kept) == best[-1][-1]
        rest = iter(b)
        assert all(x in rest for x in kept)


def test_long_pages():
    a = [f"line {k}" for k in range(6000)]
    b = [x for k, x in enumerate(a) if k % 7] + ["other"] * 50
    assert pages.shared(["first", *a], b).sum() == 6000 - 858


def test_marks(spark):
    page = '<body><div class="overflow-hidden"><article aria-hidden="false"><p>Story {0}</p><p class="social-science">Field {0}</p></article></div></body>'
    rows = [(k, f"http://h.org/x?id={k}", page.format(k)) for k in range(4)] + [(9, None, page.format(9)), (9, None, page.format(9))]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id, x.text) for x in got) == sorted((k, f"Story {k}\nField {k}") for k in (0, 1, 2, 3, 9, 9))


def _plain(rows: list) -> list:
    """Main texts of (page_id, url, html) by the plain way: each page with the nearest different ones of its host, in one list."""
    read = [(*x, *pages.blocks(x[2] or "")) for x in rows]
    host = lambda u: (u or "").split("://", 1)[-1].split("/", 1)[0].lower()
    path = lambda u: "/" + "/".join(u.split("://", 1)[-1].split("/")[1:])
    order = sorted((x for x in read if host(x[1]) and x[3]), key=lambda x: (host(x[1]), path(x[1]).rpartition("/")[0], path(x[1])))
    out = [(x[0], "\n".join(x[3])) for x in read if not (host(x[1]) and x[3])]
    for k, (page_id, url, _, lines, inside) in enumerate(order):
        keep = [True] * len(lines)
        for others in (order[k - 1 :: -1] if k else [], order[k + 1 :]):
            other = next((x for x in others if host(x[1]) != host(url) or x[3] != lines), None)
            if other and host(other[1]) == host(url) and not all(inside):
                keep = [a and (b or not c) for a, b, c in zip(keep, inside, pages.shared(lines, other[3]), strict=True)]
        out.append((page_id, "\n".join(x for x, a in zip(lines, keep, strict=True) if a)))
    return sorted(out)


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_neighbours(spark, parts):
    """Pages of a large host and of small ones, with long runs of copies: results are those of one list, wherever blocks end."""
    r = random.Random(3)
    rows = []
    for k in range(400):
        host = r.choice(["big.org", "big.org", "big.org", f"h{k % 9}.org"])
        lines = [f"Menu {r.randint(0, 2)}", f"Text {k if not 100 <= k < 260 else 'same'}", r.choice(["Foot", "Base"])]
        rows.append((k, f"http://{host}/{'abc'[k // 150]}/p{k:05d}", "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "<article><p>Foot</p></article></body>"))
    rows += [(500 + k, f"http://big.org/b/p{k:05d}", "<p>Copy</p><p>of one</p>") for k in range(2000, 2150)]
    rows += [(700, None, "<p>no url</p>"), (701, "http://big.org/a/p00000x", None), (702, "/no/host", "<p>x</p>")] + [(703, "http://big.org/b/p02149x", "<p>Copy</p><p>other</p>")] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((x.page_id, x.text) for x in got) == _plain(rows)
    assert all(x.n_chars == len(x.text) for x in got)
