"""Each operator on a small table with every odd case, against brute force or facts."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from swatchwork.llm import chat, components, decontaminate, language, licenses, mixing, neardup, pages, perplexity, quality, repetition, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = ["the", "of", "and", *("".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(400))]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split(" "))


BASE = prose(120, 1)
TEXTS = [None, "", "  \n\t", "one", "One two", "a b c d", "A B C D", BASE, BASE, BASE.upper(), *(edited(BASE, s, k) for k in range(40) for s in (0.01, 0.03, 0.05)), *(prose(n, n) for n in range(20, 90)), prose(30_000, 3), "x " * 3000, "same line here\n" * 40, "*** $$$ ### " * 30]
DOCS = [(k, t, ["en", "de", None][k % 3], ["s0", "s1", "s2", None][min(3, k * k % 11 % 5)], "x", 7) for k, t in enumerate(TEXTS)] 
DOCS += [DOCS[8], (None, BASE, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, hashes string, held_out int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def fold(k, n):
    return zlib.crc32(str(k).encode()) % n if k is not None else 0


def test_repetition(docs, none):
    got = repetition.repetition_rules(docs).collect()
    assert len(got) == len(DOCS)
    texts = {d[0]: d[1] for d in DOCS}
    for r in got:
        t = texts[r.doc_id] or ""
        w = words(t, False)
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert repetition.repetition_rules(none).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, none, n):
    sets = collections.defaultdict(set)
    for k, t, *_ in DOCS:
        w = words(t)
        sets[k].add(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    ids = [k for k in sets if k is not None]
    parent = {k: k for k in ids}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                        p, q = sorted((top(a), top(b)))
                        parent[q] = p
    got = neardup.near_duplicates(docs, n).collect()
    assert len(got) == len(DOCS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(next(iter(sets[r.doc_id]))), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(none, n).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(links).collect()} == {**{k: 0 for k in range(31)}, 40: 40, 50: 40}


def test_decontamination(spark, docs, none):
    item, worn = prose(40, 11), prose(35, 12)
    bench = spark.createDataFrame([(1, item, "x"), (2, worn, "x"), (3, "too short", "x"), (4, None, None), (5, prose(30, 13), "x")], "item_id long, text string, grams string")
    w = worn.split(" ")
    w[8], w[20] = "changed", "altered"
    del w[14]
    extra = spark.createDataFrame([(900, prose(50, 21) + " " + item + " " + prose(50, 22)), (901, prose(9, 23) + " " + " ".join(w)), (902, item.upper().replace(",", "")), (903, " ".join(item.split(" ")[:8]))], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(rows, bench).collect()}
    assert {(900, 1), (901, 2), (902, 1)} == set(got)
    assert got[900, 1].score == 1.0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(rows, bench.where("false")).count() == 0


def test_alignment_by_table():
    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        a, b = [[r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2)]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_language(spark, none):
    make = {"xx": "ka ta po mu sel rin".split(), "yy": "zwo grü bäch den tag uff".split()}
    r = random.Random(4)
    rows = [(k, " ".join("".join(r.choice(make[lang]) for _ in range(2)) for _ in range(30)), lang) for k in range(120) for lang in [["xx", "yy"][k % 2]]]
    rows += [(500, None, None), (501, "", None), (502, "123 !!", "xx"), (None, rows[0][1], None)]
    got = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {k: lang for k, _, lang in rows}
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.held_out == (fold(x.doc_id, 5) == 0)
        assert x.lang_pred == ("und" if x.doc_id in (500, 501, 502) else truth[x.doc_id] or "xx")
    assert language.language_id(none).count() == 0
    untaught = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.language_id(untaught).first()["lang_pred"] == "und"


def test_language_posteriors_by_enumeration():
    import itertools

    import numpy as np

    g = np.random.default_rng(1)
    e, moves, start = g.normal(size=(5, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    model = language.Model(["a", "b", "c"], None, moves, start, None, None, None)
    row = np.array([0, 0, 0, 1, 1])
    want = np.zeros((5, 3))
    for part in ([0, 1, 2], [3, 4]):
        total = np.zeros((len(part), 3))
        for path in itertools.product(range(3), repeat=len(part)):
            s = start[path[0]] + sum(e[i, y] for i, y in zip(part, path, strict=True)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
            for k, y in enumerate(path):
                total[k, y] += math.exp(s)
        want[part] = total / total.sum(1, keepdims=True)
    assert np.allclose(language.posteriors(e, row, model), want)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(k, int(k < len(TEXTS) - 3), 0) for k in range(7, len(TEXTS))] + [(None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_classifier(docs, labels).collect()
    assert len(got) == len(DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    assert sum(r.predicted for r in got if r.doc_id in range(10, 100)) > 85
    assert {r.score for r in quality.quality_classifier(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_classifier(none, labels).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(DOCS)
    source = {d[0]: d[3] for d in DOCS}
    sizes = collections.Counter()
    for k, t, _, s, *_ in DOCS:
        sizes[s] += len(words(t))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order) if s in sizes}
    full = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and w * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.target == pytest.approx(3 * sizes[s] if s in full else weight[s] * level)
    assert mixing.mix(none).count() == 0
    assert {r.target for r in mixing.mix(docs.where("text is null")).collect()} == {0.0}


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt; & <|im_end|>\n<|im_start|>user\nhi", None, "", "é<s>&amp;amp; <image_1>", "x\n" * 500]
    turns = [(k % 3, k, ["user", "assistant", None, "sys\ntem"][k % 4], t, 1) for k, t in enumerate(texts * 4)] + [(0, 0, "user", texts[0], 1), (None, None, "assistant", "a", 1)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns int")
    chats = chat.format_chats(frame)
    got = chats.select("conv_id", "n_turns", chat.read_turns(chats.formatted).alias("t"), chat.read_loss(chats.formatted, chats.loss_spans).alias("loss")).collect()
    for r in got:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id), key=lambda x: x[0])
        assert r.n_turns == len(own)
        assert sorted((x.role, x.text) for x in r.t) == sorted((x[1], x[2]) for x in own)
        assert r.loss == "".join(x.text for x in r.t if x.role == "assistant")
    parts = [("text", "a", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]
    one = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, content array<{chat.PART}>")).first()
    assert "a<|image_1|><|audio_2|><|document_3|>" in one.formatted
    assert [(x.number, x.ref, x.tokens) for x in one.attachments] == [(1, "i.png", 4), (2, "a.wav", 50), (3, "d.pdf", 768)] and one.expanded_tokens == 822
    assert chat.format_chats(frame.where("false")).count() == 0


def test_chat_query_by_sql(spark, duck):
    from conftest import DATA, rows

    from swatchwork.llm import queries

    assert rows(queries.QUERIES["op6_chat_format"](spark, DATA).toPandas()) == rows(duck.sql(queries.ORACLE_SQL["op6_chat_format"]).df())
    probe = queries.QUERIES["op6_chat_format"](spark, DATA).where("conv_id = -7").first()
    assert probe.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_licenses(spark, docs, none):
    worn = "Permission is hereby granted, free of charge, to every single person obtaining a copy of software and associated documentation files"
    extra = spark.createDataFrame([(900, "MIT License, mit license; CC  BY-NC"), (901, worn), (902, "gnu general public"), (903, "GNU Lesser General Public License all rights")], "doc_id long, text string")
    texts = docs.select("doc_id", "text").union(extra)
    known = {d[0]: d[1] for d in DOCS} | {r.doc_id: r.text for r in extra.collect()}
    got = licenses.license_scan(texts).collect()
    assert len(got) == len(DOCS) + 4
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (known[r.doc_id] or "").translate(LOWER))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert {p[1] for p in places} <= set(filter(None, r.labels.split(",")))
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[k] for k in (900, 901, 902, 903)] == ["cc-by,cc-by-nc,mit", "mit", "", "lgpl"]
    assert licenses.license_scan(none).count() == 0


@pytest.mark.parametrize("hot", [perplexity.HOT, 40])
def test_lm_scores(spark, none, hot):
    from pyspark.sql import functions as F

    from swatchwork.llm import common

    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(8, TEXTS[8]), (None, BASE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = perplexity.lm_scores(docs, common.fold(F.col("doc_id"), 7) == 2, shard_bytes=20_000, block_words=5_000, hot=hot).collect()
    assert len(got) == len(rows)
    tokens = {k: [*words(t), "\n"] for k, t in rows}
    train = [tokens[k] for k, _ in rows if fold(k, 7) != 2]
    count = collections.Counter(w for t in train for w in t)
    after, before, pairs, triples = (collections.Counter() for _ in range(4))
    for t in train:
        for u, v, w in zip(["\r\r", "\r", *t], ["\r", *t], t, strict=False):
            after[v] += 1
            before[u, v] += 1
            pairs[v, w] += 1
            triples[u, v, w] += 1
    n, v = sum(count.values()), len(count)
    k2, k3 = perplexity.STRENGTH
    for r in got:
        t = tokens[r.doc_id]
        share = [(count[w] + 1) / (n + v + 1) for w in t]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, share)))
        exact = 0
        for u, v_, w, s in zip(["\r\r", "\r", *t], ["\r", *t], t, share, strict=False):
            two = (pairs[v_, w] + k2 * s) / (after[v_] + k2)
            exact += math.log10((triples[u, v_, w] + k3 * two) / (before[u, v_] + k3))
        # half a step of a quantised logarithm for each of two numbers in the trie, and again in the answer
        assert abs(r.score - exact) <= 2 * len(t) * math.log10(2) / trie.STEPS
    assert perplexity.lm_scores(none, F.lit(False)).count() == 0


def test_elias_fano():
    import numpy as np

    g = np.random.default_rng(2)
    for n in (0, 1, 5, 3000, 200_000):
        for top in (60, 40, 12, 64):
            values = np.unique(g.integers(0, (1 << top) - 1, n, dtype=np.uint64))
            ef = trie.EliasFano(*trie.EliasFano.encode(values))
            keys = np.concatenate([values[:2000], g.integers(0, (1 << top) - 1, 50, dtype=np.uint64)])
            at = np.searchsorted(values, keys)
            want = [int(i) if i < len(values) and values[i] == k else -1 for i, k in zip(at, keys, strict=True)]
            assert ef.find(keys).tolist() == want
            assert (ef[np.arange(len(values))] == values).all()
            assert not n or len(values) < 1000 or ef.low.nbytes + ef.upper.nbytes <= len(values) * (2.6 + max(0, math.log2(values[-1] / len(values)))) / 8 + 200
    counts = np.array([0, 1 << 40, 3 << 50])
    built = trie.Trie.open(trie.Trie.build(np.array([3, 5, 9], np.uint64), np.array([1, 2]), np.array([7, 8], np.uint64), np.array([1, 0], np.uint64), counts[1:], counts, (1.0, 1.0)))
    assert built.total(np.array([3, 5, 9, 11], np.uint64)).tolist() == [0, 1 << 40, 3 << 50, 0]


def test_pages(spark):
    page = '<html><head><title>t</title></head><body><div>Home About</div><div>{}</div><p>Made with love</p><div id="cookie-notice">We use cookies</div><div class="comments"><p>nice</p></div></body></html>'
    rows = [(k, f"http://h.com/a/{k}", page.format(f"Story {k}<br>more &amp; text&nbsp; {k}"), "x") for k in range(4)]
    rows += [(10, None, None, "x"), (11, "http://x.org", "<p>one<p>two <b>bold</b> x", "x"), (12, "", "", "x"), (13, "http://y.org/a/b", "<nav>n</nav><article><h1>A</h1><script>var x='<p>no</p>'</script><p>Made   with\nlove</p></article><footer>f</footer>", "x"), (14, "not a url", "<p>a &lt;b&gt; &#233;</p>" * 2000, "x")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, lines string")).collect()}
    assert [got[k] for k in range(4)] == [f"Story {k}\nmore & text {k}" for k in range(4)]
    assert (got[10], got[11], got[12], got[13]) == ("", "one\ntwo bold x", "", "A\nMade with love")
    assert got[14] == "\n".join(["a <b> é"] * 2000)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_outside_articles(spark):
    page = '<body><div>Home About</div><div class="social-history" style="overflow:hidden">{0}</div><article><p>Read on</p></article><p data-id="form">Born in {0}</p><p hidden>no</p><p>Made with love</p></body>'
    html = [page.format(f"Story {k}") for k in (0, 1, 1, 1, 2)]  # the copy in the middle has copies on both sides
    rows = [(k, f"http://h.com/a/{k}", x) for k, x in enumerate(html)]
    # a folder of one page on a host with others, and pages without text between different ones
    rows += [(10, "http://i.com/a/1", page.format("Story a")), (11, "http://i.com/b/1", page.format("Story b")), (12, "http://i.com/a/9", None)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {x}\nRead on\nBorn in Story {x}" for k, x in zip((0, 1, 2, 3, 4, 10, 11), "01112ab", strict=True)} | {12: ""}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([d for d in DOCS if d[0] is not None], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < len(TEXTS) - 3), 0) for k in range(7, len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, TEXTS[140])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        kept = after.collect()
        assert set(kept) <= set(now.collect()), name
        now = spark.createDataFrame(kept, SCHEMA)
    assert 140 not in {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in now.collect()}
