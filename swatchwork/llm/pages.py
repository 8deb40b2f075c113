"""Main text of web pages by differencing pages of near URLs.

A page is cut into blocks of text, and blocks in parts that are marked as menus, headers, footers, forms, adverts,
notices or comments are set aside. Pages of one host are paired by URL path: a page with the nearest ones before and
after it, in the order of folders and paths, that are not copies of it. The blocks of a pair are aligned by longest common
subsequence, and shared ones are template and go. An article only protects the blocks in it; what stands outside stays
unless it is shared.

Pages are put in order by a range partitioning, so a host of any size is spread over as many tasks as its pages need, and
pass by one after another. First only their URLs and digests are put in order. That gives each block of the order its
bounds and, across blocks of nothing but copies, the pages beside it that its first and last pages are compared with. Then
the lines move once to their block, and those few pages to the blocks beside as well. So no result depends on where blocks
end. Bounds and pages beside are five URLs for each of ``spark.sql.shuffle.partitions`` blocks; only they pass the driver.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common

#: Entries of an alignment's table; longer pages are aligned in halves.
TABLE = 1 << 22
#: Elements whose content is never main text, and elements without content.
SKIPPED = frozenset("head title script style noscript template nav header footer aside form button select textarea option iframe svg canvas object dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that stand inside a line of text.
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ins del big".split())
ARTICLE = frozenset(["article", "main"])
#: Words in classes, ids and roles that mark what is not main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead "
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments respond reply replies disqus "
    "form search toolbar pagination pager skip contentinfo complementary".split()
)
#: Elements that end an open paragraph when they begin.
_ENDS_P = frozenset("p div article section main ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote footer header nav aside form figure address hr details fieldset".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s\xa0]+")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _set_aside(attributes: dict[str, str]) -> bool:
    """Whether a class, id or role consists of marking words only (cookie-notice, but not social-history), or nothing is shown."""
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").split():
            words = [x for x in re.split(r"[^a-z0-9]+", value) if x]
            if words and ASIDE.issuperset(words):
                return True
    return "hidden" in attributes or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """The page's blocks of text that are not set aside, in order, and whether each stands in an article."""
    out: list[str] = []
    inside: list[bool] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set aside, article
    text: list[str] = []
    aside = article = False
    at = 0

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if line:
            out.append(line)
            inside.append(article)

    def close(k: int) -> None:
        nonlocal aside, article
        del stack[k:]
        aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not aside:
            text.append(html.unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE or name == "br":
            flush()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            # a closing tag does not reach out of the article or the part set aside that it stands in
            if k is not None and not (name in INLINE and any(stack[j][0] not in INLINE for j in range(k + 1, len(stack)))):
                close(k)
            continue
        if name in VOID:
            continue
        if name in _ENDS_P:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
            if k is not None and all(x[0] in INLINE or x[0] == "p" for x in stack[k:]):
                close(k)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[0].endswith("/>") and name not in INLINE:
            continue
        # a header inside an article is its headline
        skip = name in SKIPPED and not (name == "header" and article)
        marks = _attributes(m[3] or "")
        aside = aside or skip or (name not in ("html", "body") and _set_aside(marks))
        article = article or name in ARTICLE or "main" in marks.get("role", "").split() or "articlebody" in marks.get("itemprop", "").split()
        stack.append((name, aside, article))
    if not aside:
        flush()
    return out, inside


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and every front of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(np.where(y == v, row[:-1] + 1, 0), row[1:]))
    return row


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries of x are in one longest common subsequence of x and y; memory is bounded by TABLE and both lengths."""
    out = np.zeros(len(x), bool)
    if not len(x) or not len(y):
        return out
    if len(x) == 1:
        out[0] = bool((y == x[0]).any())
        return out
    if (len(x) + 1) * (len(y) + 1) > TABLE:  # halves of x with the fronts and ends of y that suit them best
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return np.concatenate([_common(x[:half], y[:cut]), _common(x[half:], y[cut:])])
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        match = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(np.maximum(match, table[i + 1, :-1])[::-1])[::-1]
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and table[i, j] == table[i + 1, j + 1] + 1:
            out[i] = True
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def shared(a: list, b: list) -> np.ndarray:
    """Which entries of a are in a longest common subsequence of a and b; those at both ends count off first."""
    out = np.zeros(len(a), bool)
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        out[hi_a] = True
    number = {v: k for k, v in enumerate(set(a[lo:hi_a]) & set(b[lo:hi_b]))}
    at = [k for k in range(lo, hi_a) if a[k] in number]
    out[at] = _common(np.array([number[a[k]] for k in at], np.int64), np.array([number[v] for v in b[lo:hi_b] if v in number], np.int64))
    return out


def _main(lines: list[str], inside: list[bool], neighbours: list[list[str]]) -> str:
    """The lines that no neighbour shares, and those in an article: documents share passages, so these stay."""
    keep = np.ones(len(lines), bool)
    if not all(inside):
        for other in neighbours:
            keep &= ~shared(lines, other) | np.array(inside)
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


#: The order of pages: by URL path within the host, then what tells pages of one URL apart.
ORDER = ["host", "folder", "path", "address", "mark", "twin"]
_KEY = "host string, folder string, path string, address string, mark long, twin long"
#: Bytes of lines that a worker gathers before it hands them on.
BATCH_BYTES = 1 << 22
Key = tuple[str, str, str, str, int, int]


def _keys(batch: pa.RecordBatch) -> Iterator[Key]:
    return zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True)


def _digest(lines: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place in the order and a digest of the lines of each page that has a host and a line."""
    for batch in batches:
        out = []
        for key, page in zip(_keys(batch), batch.column("html"), strict=True):
            if key[0] and (lines := blocks(page.as_py() or "")[0]):
                out.append((*key, _digest(lines)))
        if out:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True))], names=[*ORDER, "digest"])


def _beside(edges: list) -> tuple[list[Key], dict[Key, list[int]]]:
    """The first place of each block, and the pages that are needed in other blocks: for each block the page before it, the last before that with other lines, and the same behind it.

    ``edges`` has for each block its first and last page, and the first and last that differ from these, each None or (place, digest).
    """
    wanted: dict[Key, list[int]] = {}

    def walk(numbers, near: str, far: str, far_other: str) -> None:
        one = two = None
        for k in numbers:
            edge = edges[k]
            for page in (one, two):
                if page and page[0][0] == edge[near][0][0]:
                    wanted.setdefault(page[0], []).append(k)
            if edge[far_other]:
                one, two = edge[far], edge[far_other]
            else:  # nothing but copies
                one, two = edge[far], one if one and one[1] != edge[far][1] else two

    walk(range(len(edges)), "first", "last", "other_last")
    walk(range(len(edges) - 1, -1, -1), "last", "first", "other_first")
    return [x["first"][0] for x in edges], wanted


def _placed(bounds: list[Key], wanted: dict[Key, list[int]], count: int):
    """The lines of each page with its block, and once more for each other block that needs them."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = size = 0
        out: list[tuple] = []

        def ready() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)]
            out.clear()
            types = [pa.int32(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["block", "own", *ORDER, "page_id", "url", "lines", "inside"])

        for batch in batches:
            for key, page_id, url, page in zip(_keys(batch), batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
                lines, inside = blocks(page.as_py() or "")
                row = (*key, page_id.as_py(), url.as_py(), lines, inside)
                if key[0] and lines:
                    out.append((bisect_right(bounds, key) - 1, True, *row))
                    out.extend((k, False, *row) for k in wanted.get(key, ()))
                else:  # compared with nothing: dealt in turn
                    out.append((loose % count, True, "", *row[1:]))
                    loose += 1
                size += sum(map(len, lines))
                if size > BATCH_BYTES:
                    yield ready()
                    size = 0
        if out:
            yield ready()

    return placed


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pages sorted by block and order to the main texts of the blocks' own pages."""
    out: list[tuple] = []
    size = 0
    at, before, lines = None, None, None  # block and host, the last page that differs from the present run of copies, and the run's lines
    run: dict[tuple, int] = {}  # pages of the run and how often each is there

    def put(page_id: int | None, url: str | None, text: str, times: int = 1) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for _ in range(times):
            out.append((page_id, url, text))
            size += len(text)
            if size > BATCH_BYTES:
                yield ready()

    def close(after: list[str] | None) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple, str] = {}
        for (page_id, url, inside), times in run.items():
            if inside not in texts:
                texts[inside] = _main(lines, list(inside), [x for x in (before, after) if x is not None])
            yield from put(page_id, url, texts[inside], times)
        run.clear()

    def ready() -> pa.RecordBatch:
        nonlocal size
        ids, urls, texts = zip(*out, strict=True)
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for block, own, host, page_id, url, found, inside in zip(*(batch.column(c) for c in ("block", "own", "host", "page_id", "url", "lines", "inside")), strict=True):
            block, own, host, found, inside = block.as_py(), own.as_py(), host.as_py(), found.as_py(), inside.as_py()
            if not host:
                yield from put(page_id.as_py(), url.as_py(), _main(found, inside, []))
                continue
            if (block, host) != at:
                yield from close(None)
                at, before, lines = (block, host), None, found
            elif found != lines:
                yield from close(found)
                before, lines = lines, found
            if own:
                page = (page_id.as_py(), url.as_py(), tuple(inside))
                run[page] = run.get(page, 0) + 1
    yield from close(None)
    if out:
        yield ready()


def _edges(outline: DataFrame) -> list[dict]:
    """For each block of the outline, in order, the pages that ``_beside`` looks at."""
    page = F.struct(F.struct(*ORDER).alias("place"), "digest")
    ends = common.stored(outline.groupBy("block").agg(F.min(page).alias("first"), F.max(page).alias("last")))
    rows = outline.join(F.broadcast(ends), "block")  # a row a block
    differs = lambda end: F.when(F.col("digest") != F.col(f"{end}.digest"), page)
    rows = rows.groupBy("block").agg(F.first("first").alias("first"), F.first("last").alias("last"), F.min(differs("first")).alias("other_first"), F.max(differs("last")).alias("other_last"))
    plain = lambda x: x and (tuple(x["place"]), bytes(x["digest"]))
    return [{c: plain(x[c]) for c in ("first", "last", "other_first", "other_last")} for x in sorted(rows.collect(), key=lambda x: x["block"])]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url, html): the main text of the whole page.

    Blocks are joined by one line feed. Null and empty pages have an empty text. Pages with a null url or without a host,
    and pages that are alone on their host but for copies, are judged by their own marks only. Pages of one path are in the
    order of the rest of their URLs, then of digests of their ids and contents; repeated rows stay and have one text. Pages
    of any length are read and aligned whole. Other columns are not looked at, and an empty table gives an empty table.
    """
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    place = F.regexp_replace(rest, r"[?#].*$", "")
    path = F.regexp_replace(F.expr("substring(place, length(substring_index(place, '/', 1)) + 1)"), "/+$", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("place", place).withColumn("host", F.lower(F.substring_index("place", "/", 1))).withColumn("path", path).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    rows = rows.select("page_id", "url", "html", "host", "folder", "path", F.coalesce("url", F.lit("")).alias("address"), F.xxhash64("page_id").alias("mark"), F.xxhash64("html").alias("twin"))
    # stored first, as a range partitioning reads its input twice
    outline = common.stored(rows.select(*ORDER, "html").mapInArrow(_outline, f"{_KEY}, digest binary")).repartitionByRange(count, *ORDER)
    bounds, wanted = _beside(_edges(common.stored(outline.withColumn("block", F.spark_partition_id()))))
    moved = rows.mapInArrow(_placed(bounds, wanted, count), f"block int, own boolean, {_KEY}, page_id long, url string, lines array<string>, inside array<boolean>")
    moved = moved.repartitionById(count, F.col("block")).sortWithinPartitions("block", *ORDER)
    return moved.select("block", "own", "host", "page_id", "url", "lines", "inside").mapInArrow(_difference, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
