"""Elements of HTML, stylesheets, the styles that hold, and token files: facts and round trips."""

import random

import pytest

from swatchwork.operators import cascade
from swatchwork.sources import html, stylesheets

PAGE = """<!DOCTYPE html><!-- <p>no</p> --><html><head><title>a <b>c</b></title><style>p > b{}</style><meta charset=utf-8></head>
<body class="  wide
 top" id=main><header role=banner><a href='/x?a=1&amp;b=2' class=cta>Go<br>on</a></header>
<p>One<p class="lead">Two <b>bold</b> end<div><ul><li>1<li>2<ul><li>2a</ul><li>3</ul></div>
<svg viewBox="0 0 1 1"><path d="M0"/><g><text>in</text></g></svg><script>var t="</p><div>";</script>
<table><tr><td>x<td>y<tr><td>z</table><noscript><p>n</p></noscript><textarea><b>raw</b></textarea>
<input disabled value="a>b"><section style="Color: RED; background:url(a;b.png) !important"></section></i></body></html>tail"""


def rows(spark, text, **chosen):
    frame = spark.createDataFrame([(1, text, "t")], "page_id long, html string, tag string")
    return html.from_pages(frame, **chosen).orderBy("ord").collect()


def test_elements(spark):
    got = rows(spark, PAGE)
    assert [x.tag for x in got] == "html body header a br p p b div ul li li ul li li svg table tr td td tr td textarea input section".split()
    at = {k: x for k, x in enumerate(got)}
    above = lambda k: at[at[k].parent].tag
    assert [above(k) for k in range(1, len(got))] == "html body header a body body p body div ul ul li ul ul body body table tr tr table tr body body body".split()
    assert at[1].class_list == "wide top" and at[1].id == "main" and at[2].role == "banner" and at[3].href == "/x?a=1&b=2" and at[3].line_text == "Goon"
    assert [x.tag for x in got if x.has_text] == "a p p b li li li li td td td textarea".split()
    assert at[6].line_text == "Two end" and at[22].line_text == "<b>raw</b>" and at[23].attributes == {"disabled": "", "value": "a>b"}
    assert [x.ord for x in got] == list(range(len(got))) and at[0].depth == 0 and at[0].parent is None


def test_chosen_elements(spark):
    tags = lambda **chosen: [x.tag for x in rows(spark, PAGE, **chosen)]
    assert "header" not in tags(ignore=["header"]) and "a" not in tags(ignore=["HEADER"]) and tags(ignore=["p > b", ""]) == tags()
    assert tags(scope=["div"]) == "div ul li li ul li li".split() and tags(scope=["p.lead"]) == ["p", "b"] and tags(scope=["#none"]) == tags()
    assert tags(scope=["table"], ignore=["td"]) == ["table", "tr", "tr"]


@pytest.mark.parametrize("text", [None, "", "plain", "<", "<p", "<!--", "</p></p>", "<p 'x", "<script>", "<a b='c", "<div/>x", "&amp;<b>&lt;"])
def test_broken_pages(spark, text):
    got = rows(spark, text)
    assert [x.tag for x in got] == {"<div/>x": ["div"], "&amp;<b>&lt;": ["b"]}.get(text, [])
    if text == "&amp;<b>&lt;":
        assert got[0].line_text == "<"


def test_deep_and_long_pages(spark):
    deep = rows(spark, "<div>" * 20_000 + "x")
    assert len(deep) == 20_000 and deep[-1].depth == 19_999 and deep[-1].has_text
    assert len(rows(spark, "<p>a " * 30_000)) == 30_000


r = random.Random(2)
WORDS = ["color", "--x", "margin-top", "content", "src"]
VALUES = ["red", '"}{;"', "'a;b'", "url(x;y{.png)", "calc(1px + (2 * 3em))", '"\\""', "a, b"]


def sheet(depth):
    """A random sheet as nested (prelude, declarations, blocks)."""
    out = []
    for _ in range(r.randint(1, 3)):
        inner = sheet(depth - 1) if depth and r.random() < 0.7 else []
        prelude = r.choice(["@media (min-width: 3px)", "@supports (display: grid)", "@layer base", ".a > b", "a:not(.b, .c)", '[title="{;}"]', "&:hover"])
        out.append((prelude, [(r.choice(WORDS), r.choice(VALUES), r.random() < 0.2) for _ in range(r.randint(0, 3))], inner))
    return out


def text_of(blocks):
    gap = lambda: r.choice(["", " ", "\n", " /* { ; } */ "])
    return gap().join(f"{p}{gap()}{{{gap()}" + "".join(f"{n}{gap()}:{gap()}{v}{' !important' if i else ''}{gap()};" for n, v, i in d) + gap() + text_of(b) + gap() + "}" for p, d, b in blocks)


def flat(blocks, around=()):
    for p, d, b in blocks:
        yield p, [*around], d
        yield from flat(b, (*around, p))


def test_blocks_round_trip():
    for _ in range(300):
        blocks = sheet(r.randint(0, 4))
        got = stylesheets.blocks(text_of(blocks))
        name = lambda x: ("@" + x["kind"] + " " if x["kind"] != "rule" else "") + x["prelude"]
        assert [(name(x), x["around"], [(d["property"], d["value"], d["important"]) for d in x["declarations"]]) for x in got] == list(flat(blocks))
    assert [x["kind"] for x in stylesheets.blocks("@import url(a.css); @charset 'x'; a{b:c")] == ["import", "charset", "rule"]
    assert stylesheets.blocks(None) == stylesheets.blocks("") == stylesheets.blocks("}};/* ") == []


CSS = """@media (min-width:600px){ @supports (display:grid) { .grid, .b { width: 50vw; color: oklch(50% 0.1 20) } } }
:root { --a: 1px; --b: color-mix(in oklab, red, rgb(0 0 0)); } @media print { :root { --a: 2px } }
@keyframes spin { from { top: 0 } 50%, 75% { top: 1px; left: 2px } } @-webkit-keyframes old { to { top: 0 } }
@container card (width > 10px) { p { font-size: clamp(1rem, 2vw, 3rem); padding: env(safe-area-inset-top) ENV( safe-area-inset-top ) } }
@font-face { font-family: 'My Font'; src: url(a.woff2); font-weight: 700 } @font-face { src: url(b) }
.card { color: red; &:hover { color: blue } b { color: green } } /* @media fake { } */"""


def test_facts(spark):
    frame = spark.createDataFrame([(1, CSS), (2, None), (3, "p{")], "id long, text string")
    got = {}
    for x in stylesheets.sheet_facts(frame).orderBy("ord").collect():
        assert x.id == 1
        got.setdefault(x.fact, []).append((x.name, x.value))
    assert [v for _, v in got["media"]] == ["(min-width:600px)", "print"] and [v for _, v in got["container"]] == ["card (width > 10px)"]
    assert got["fluid"] == [("width", "50vw"), ("font-size", "clamp(1rem, 2vw, 3rem)")] and got["env"] == [("safe-area-inset-top", "")]
    assert got["modern"] == [("oklch", "oklch(50% 0.1 20)"), ("color-mix", "color-mix(in oklab, red, rgb(0 0 0))")]
    assert got["keyframes"] == [("spin", "from { top: 0 }"), ("spin", "50%, 75% { top: 1px; left: 2px }"), ("old", "to { top: 0 }")]
    assert got["variable"] == [("--a", "1px"), ("--b", "color-mix(in oklab, red, rgb(0 0 0))")]
    assert got["font"] == [("My Font", "normal | 700 | url(a.woff2)")]
    said = stylesheets.declarations(stylesheets.css_blocks(frame)).collect()
    assert {(x.selector, x.value) for x in said if x.property == "color"} == {(".grid", "oklch(50% 0.1 20)"), (".b", "oklch(50% 0.1 20)"), (".card", "red"), (".card:hover", "blue"), (".card b", "green")}
    assert {x.media for x in said if x.selector == ".b"} == {"@media (min-width:600px)"} and not any(x.selector in ("from", "to") for x in said)


def test_styles_that_hold(spark):
    page = '<body><p id=a class="x y" style="margin: 1px; color: black">1</p><p class=x>2</p><b>3</b></body>'
    css = "*{color:grey} p{color:red;margin:0;top:1px!important} .x{color:green;top:2px} p.x.y{top:3px} #a{left:1px} @media print{p{color:pink}} p b{color:lime} .x{bottom:1px} .x{bottom:2px}"
    e = html.from_pages(spark.createDataFrame([(5, page)], "page_id long, html string"))
    said = stylesheets.declarations(stylesheets.css_blocks(spark.createDataFrame([(0, css), (1, "p{margin:9px!important}")], "id long, text string"))).selectExpr("5L AS page_id", "id AS sheet", "*").drop("id")
    got = {(x.ord, x.property): (x.value, x.origin) for x in cascade.declared_styles(e, said).collect()}
    assert got[1, "color"] == ("black", "attribute") and got[1, "margin"] == ("9px", "sheet") and got[1, "top"] == ("1px", "sheet") and got[1, "left"] == ("1px", "sheet")
    assert got[2, "color"] == ("green", "sheet") and got[2, "bottom"] == ("2px", "sheet") and got[3, "color"] == ("grey", "sheet") and (2, "left") not in got


def test_token_files(spark):
    tree = '{"color":{"$type":"color","$description":"d","red":{"$value":"#f00"},"deep":{"a":{"$value":1.50,"$type":"number"},"b":{"$value":{"x":[1]}}}},"list":[{"n":{"$value":null}}],"$value":"top"}'
    files = [(1, "a.json", tree), (2, "b.JSON", '{"colors":{"primary":"#000","n":3,"o":{"k":1}},"flat":1,"list":[1]}'), (3, "c.css", ":root{--a-b: 1px ;\n--c:url(x)\n;--d:4}"), (4, "d.json", "{broken"), (5, "e.json", None), (6, "f.json", "[1]")]
    got = {(x.id, x.path): (x.value, x.type) for x in stylesheets.read_tokens(spark.createDataFrame(files, "id long, name string, text string")).collect()}
    assert got == {
        (1, "color.red"): ("#f00", "color"),
        (1, "color.deep.a"): ("1.50", "number"),
        (1, "color.deep.b"): ('{"x":[1]}', "color"),
        (1, "list.0.n"): (None, None),
        (2, "colors.primary"): ("#000", "color"),
        (2, "colors.n"): ("3", "color"),
        (2, "colors.o"): ('{"k":1}', "color"),
        (3, "a-b"): ("1px", "unknown"),
        (3, "c"): ("url(x)", "unknown"),
    }
    with pytest.raises(Exception, match="not a .json or .css file"):
        stylesheets.read_tokens(spark.createDataFrame([(1, "a.yaml", "x")], "id long, name string, text string")).collect()
