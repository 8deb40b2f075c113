"""Element rows read from the HTML of pages, in document order."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, those whose content is text, those that say nothing of a page's look, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
SKIPPED = frozenset("script style link meta template noscript source track title base head".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of the first kind ends an open one of the second, unless one of the third is between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SIMPLE = re.compile(r"^(?:([A-Za-z][\w-]*)|\*)?((?:[.#][\w-]+)*)$")
SCHEMA = """page_id long, ord int, parent int, depth int, tag string, class_list string, id string, role string, href string, style string,
    attributes map<string,string>, has_text boolean, text_chars int, line_text string"""


class _Element:
    __slots__ = ("tag", "attributes", "ord", "above", "depth", "out", "has_text", "text", "svg")

    def __init__(self, tag: str, attributes: dict[str, str], above: _Element | None):
        self.tag, self.attributes, self.above = tag, attributes, above
        self.ord: int | None = None
        self.depth = above.depth + 1 if above else 0
        self.out = self.has_text = False
        self.svg = above is not None and (above.svg or above.tag == "svg")
        self.text: list[str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return found


def selector(text: str) -> tuple[str | None, list[str], list[str]] | None:
    """Tag, ids and classes of a simple selector such as nav#top.wide; None for any other."""
    m = _SIMPLE.match(text.strip())
    if not m or not text.strip():
        return None
    return m[1] and m[1].lower(), re.findall(r"#([\w-]+)", m[2]), re.findall(r"\.([\w-]+)", m[2])


def _matches(e: _Element, selectors: list) -> bool:
    classes = (e.attributes.get("class") or "").split()
    return any((tag is None or tag == e.tag) and all(e.attributes.get("id") == i for i in ids) and all(c in classes for c in own) for tag, ids, own in selectors)


def parse(text: str) -> Iterator[_Element]:
    """All elements in document order; end tags that are missing are implied, and those that nothing has opened are passed over."""
    stack: list[_Element] = []

    def shut(names: tuple, within: tuple) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                del stack[k:]
                return shut(names, within)
            if stack[k].tag in within:
                return None
        return None

    at = 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        words = text[at : m.start() if m else len(text)]
        if words and stack:
            stack[-1].text.append(words)
            stack[-1].has_text |= bool(words.strip())
        if not m:
            return
        at = m.end()
        if m[1]:
            name = m[1].lower()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
        elif m[2]:
            name = m[2].lower()
            if name in ENDS_P:
                shut(("p",), ("button", "table", "td", "th"))
            if name in ENDS:
                shut(*ENDS[name])
            e = _Element(name, _attributes(m[3] or ""), stack[-1] if stack else None)
            closed = (m[3] or "").endswith("/") and (e.svg or name == "svg")
            if name in RAW and not closed:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
                e.text.append(text[at : end.start() if end else len(text)])
                e.has_text = bool(e.text[0].strip())
                at = end.end() if end else len(text)
            elif name not in VOID and not closed:
                stack.append(e)
            yield e


def elements_of(text: str | None, ignored: list, scope: list) -> list[_Element]:
    """The elements that count: none in the head or inside a drawing, none that draws nothing, none under an ignored one; under the scope's matches where there are any."""
    every = list(parse(text or ""))
    for e in every:
        e.out = bool(e.above and (e.above.out or e.above.tag == "head")) or e.tag in SKIPPED or e.svg or bool(ignored and _matches(e, ignored))
    if scope and (roots := {id(e) for e in every if not e.out and _matches(e, scope)}):
        inside: set[int] = set()
        for e in every:
            if id(e) in roots or (e.above and id(e.above) in inside):
                inside.add(id(e))
        for e in every:
            e.out |= id(e) not in inside
    kept = [e for e in every if not e.out]
    for k, e in enumerate(kept):
        e.ord = k
    return kept


def _read(ignored: list, scope: list):
    kinds = pa.schema([("page_id", pa.int64()), *((c, pa.int32()) for c in ("ord", "parent", "depth")), *((c, pa.string()) for c in ("tag", "class_list", "id", "role", "href", "style")), ("attributes", pa.map_(pa.string(), pa.string())), ("has_text", pa.bool_()), ("text_chars", pa.int32()), ("line_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                rows = []
                for e in elements_of(text.as_py(), ignored, scope):
                    up = e.above
                    while up is not None and up.ord is None:
                        up = up.above
                    a, words = e.attributes, " ".join(entities.unescape("".join(e.text)).split())
                    rows.append((page, e.ord, up.ord if up else None, e.depth, e.tag, " ".join(a.get("class", "").split()), a.get("id"), a.get("role", ""), a.get("href"), a.get("style"), list(a.items()), e.has_text, len(words), words))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return run


def from_pages(pages: DataFrame, ignore: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Element rows of (page_id, html), see SCHEMA: in document order, with the nearest element above that counts as the parent.

    Left out are the head, what draws nothing (scripts, styles, templates and so on), what is inside a drawing, and what
    matches a selector of ``ignore`` with all below it. ``scope`` keeps what matches and all below, or everything where a
    page has no match. Selectors are simple ones: tag, #id, .class and these together; others match nothing.
    ``has_text`` says whether the element itself, not one below it, has visible text; ``line_text`` is that text. Comments,
    missing and superfluous end tags, unquoted attributes and character references are read as browsers do in the cases
    that ENDS and ENDS_P name. Pages are read whole, each in one task, with no limit of elements; null HTML has none.
    """
    given = [[s for x in chosen or [] if (s := selector(x))] for chosen in (ignore, scope)]
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_read(*given), SCHEMA)
