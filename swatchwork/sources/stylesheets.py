"""Stylesheets and token files: blocks of CSS with the conditions around them, what they say, and tokens by name."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators import tokens
from swatchwork.sources.storage import stored

_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|url\(\s*[^"')\s][^)]*\)|[{};]|\\.|[^/"'{};\\u]+|.""", re.S | re.I)
_AT = re.compile(r"@([\w-]+)\s*(.*)", re.S)
BLOCKS = "id long, ord int, parent int, depth int, kind string, prelude string, around array<string>, declarations array<struct<property:string,value:string,important:boolean>>"
#: Blocks that go back from a Python worker together, or as many as one sheet has.
TOGETHER = 2000
#: Properties whose values may follow the viewport, and the functions of newer colours.
FLUID = "font-size|line-height|letter-spacing|gap|padding|padding-block|padding-inline|max-width|width|border-radius"
MODERN = "oklch|oklab|color-mix|light-dark"


def blocks(text: str | None) -> list[dict]:
    """Blocks in the order in which they open. Braces, semicolons and comment marks inside strings and url() mean nothing; what is open at the end is closed there."""
    found: list[dict] = []
    stack: list[dict] = []
    part: list[str] = []

    def declare() -> None:
        words = "".join(part).strip()
        part.clear()
        name, colon, value = words.partition(":")
        if stack and colon and (name := name.strip()):
            value = " ".join(value.split())
            plain = re.sub(r"\s*!\s*important$", "", value, flags=re.I)
            stack[-1]["declarations"].append({"property": name if name.startswith("--") else name.lower(), "value": plain, "important": plain != value})
        elif not stack and (at := _AT.match(words)):
            found.append({"parent": None, "depth": 0, "kind": at[1].lower(), "prelude": at[2], "around": [], "declarations": []})

    for m in _TOKEN.finditer(text or ""):
        token = m[0]
        if token.startswith("/*"):
            part.append(" ")
        elif token == "{":
            prelude = " ".join("".join(part).split())
            part.clear()
            at = _AT.match(prelude)
            kind, rest = (at[1].lower(), at[2]) if at else ("rule", prelude)
            up = stack[-1] if stack else None
            stack.append({"parent": up and up["ord"], "depth": len(stack), "kind": kind, "prelude": rest, "around": [*up["around"], ("@" + up["kind"] + " " if up["kind"] != "rule" else "") + up["prelude"]] if up else [], "declarations": [], "ord": len(found)})
            found.append(stack[-1])
        elif token == "}":
            declare()
            if stack:
                stack.pop()
        elif token == ";":
            declare()
        else:
            part.append(token)
    declare()
    for k, x in enumerate(found):
        x["ord"] = k
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    said = pa.list_(pa.struct([("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))
    kinds = {"ord": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "kind": pa.string(), "prelude": pa.string(), "around": pa.list_(pa.string()), "declarations": said}
    for batch in batches:
        keys: list[int | None] = []
        rows: list[dict] = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            found = blocks(text.as_py())
            keys += [key] * len(found)
            rows += found
            if len(rows) >= TOGETHER:
                yield _batch(keys, rows, kinds)
                keys, rows = [], []
        if rows:
            yield _batch(keys, rows, kinds)


def _batch(keys: list[int | None], rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([x[c] for x in rows], t) for c, t in kinds.items())], names=["id", *kinds])


def css_blocks(sheets: DataFrame) -> DataFrame:
    """Blocks of stylesheets (id, text), see BLOCKS: rules and at-rules, nested to any depth.

    ``around`` holds the preludes of the blocks outside a block, the outermost first, so that a rule keeps its conditions.
    An at-rule without a block, such as @import, is a block without declarations. Null and empty sheets have none.
    """
    return sheets.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks, BLOCKS)


def declarations(read: DataFrame) -> DataFrame:
    """(id, ord, place, selector, media, property, value, important): a row for each selector and declaration of ``css_blocks``.

    A rule inside another, as nesting has it, is told with the outer selector in front, or in place of &. Steps of keyframes
    are no rules.
    """
    outer = F.filter("around", lambda x: ~x.startswith("@"))
    own = F.aggregate(F.concat(outer, F.array("prelude")), F.lit(""), lambda a, x: F.when(a == "", x).when(x.contains("&"), F.replace(x, F.lit("&"), a)).otherwise(F.concat(a, F.lit(" "), x)))
    rows = read.where("kind = 'rule' and not exists(around, x -> x rlike '^@(-[a-z]+-)?keyframes')").select("id", "ord", own.alias("selectors"), F.array_join(F.filter("around", lambda x: x.startswith("@media")), " and ").alias("media"), F.posexplode("declarations").alias("place", "d"))
    one = F.explode(F.split("selectors", r"\s*,\s*(?![^(]*\))"))
    return rows.select("id", "ord", "place", one.alias("selector"), "media", "d.property", "d.value", "d.important")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def sheet_facts(sheets: DataFrame) -> DataFrame:
    """What the texts of stylesheets (id, text) say: (id, fact, ord, name, value), in the order of each fact.

    Facts: media and container (their conditions), fluid (property and value that follow the viewport), env, modern (kind
    and text of newer colours), keyframes (name and each step), variable (of :root, the first of a name), font (family and
    its style, weight and source). Texts are searched by pattern, but blocks and steps come from ``css_blocks``, so that
    nested ones count, whatever the layout of the text.
    """
    texts = sheets.select(F.col("id").cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"(?s)/\*.*?\*/", " ").alias("text"))
    fact = lambda name, found, key, value: texts.select("id", F.lit(name).alias("fact"), F.posexplode(found).alias("ord", "x")).select("id", "fact", "ord", key(F.col("x")).alias("name"), value(F.col("x")).alias("value"))
    none = lambda x: F.lit("")
    same = lambda x: _strip(x)
    fluid = rf"(?i)(?<![\w-])((?:{FLUID})\s*:\s*[^;}}]*?(?:clamp\(|[\d.]+v(?:w|h|min|max)\b)[^;}}]*)"
    kind = lambda x: F.coalesce(F.nullif(F.lower(F.regexp_extract(x, rf"(?i)^({MODERN})", 1)), F.lit("")), F.lower(F.regexp_extract(x, r"(?i)(display-p3|rec2020)", 1)))
    modern = rf"(?i)((?:{MODERN})\((?:[^()]|\([^()]*\))*\)|color\(\s*(?:display-p3|rec2020)[^)]+\))"
    rows = (
        fact("fluid", _all(F.col("text"), fluid), lambda x: F.lower(_strip(F.substring_index(x, ":", 1))), lambda x: _strip(F.regexp_replace(x, r"^[^:]*:", "")))
        .union(fact("env", F.array_distinct(F.transform(_all(F.col("text"), r"(?i)env\(\s*(safe-area-inset-[a-z]+|viewport-[a-z-]+)"), lambda x: F.lower(x))), same, none))
        .union(fact("modern", _all(F.col("text"), modern), kind, same))
    )
    read = stored(css_blocks(sheets))  # six facts read the blocks, which are cut once
    by = lambda *order: F.row_number().over(Window.partitionBy("id").orderBy(*order)) - 1
    for name in ("media", "container"):
        rows = rows.union(read.where(F.col("kind") == name).select("id", F.lit(name), by("ord"), F.lit(""), "prelude"))
    inner = read.select("id", F.col("parent").alias("up"), F.col("ord").alias("step"), F.col("prelude").alias("offset"), F.array_join(F.transform("declarations", lambda d: F.concat(d["property"], F.lit(": "), d["value"])), "; ").alias("style"))
    frames = read.where("kind rlike '^(-[a-z]+-)?keyframes$'").select("id", "ord", F.col("prelude").alias("name"))
    frames = frames.join(inner, (frames["id"] == inner["id"]) & (F.col("ord") == F.col("up"))).select(frames["id"], "ord", "step", "name", F.concat(F.col("offset"), F.lit(" { "), F.col("style"), F.lit(" }")).alias("value"))
    rows = rows.union(frames.select("id", F.lit("keyframes"), by("ord", "step"), "name", "value"))
    said = read.select("id", "ord", "kind", "prelude", F.posexplode("declarations").alias("place", "d"))
    roots = said.where("kind = 'rule' and array_contains(split(prelude, ' *, *'), ':root') and d.property like '--%'")
    roots = roots.groupBy("id", F.col("d.property").alias("name")).agg(F.min(F.struct("ord", "place", "d.value")).alias("first"))
    rows = rows.union(roots.select("id", F.lit("variable"), by("first.ord", "first.place"), "name", "first.value"))
    of = lambda p, otherwise: F.coalesce(F.max(F.when(F.col("d.property") == p, F.col("d.value"))), F.lit(otherwise))
    faces = said.where("kind = 'font-face'").groupBy("id", "ord").agg(F.regexp_replace(of("font-family", ""), "[\"']", "").alias("family"), of("font-style", "normal").alias("style"), of("font-weight", "400").alias("weight"), of("src", "").alias("src")).where("family != ''")
    return rows.union(faces.select("id", F.lit("font"), by("ord"), "family", F.concat_ws(" | ", "style", "weight", "src"))).select("id", "fact", F.col("ord").cast("int").alias("ord"), "name", "value")


def typed_leaves(text: str | None) -> list[tuple[str, str | None, str | None]]:
    """Path, value and type of each object with a $value; the type is its own or else the nearest above. A broken text has none."""
    try:
        tree = json.loads(text or "", parse_float=tokens._Number, parse_int=tokens._Number)
    except ValueError:
        return []
    found = []
    left = [("", tree, None)] if isinstance(tree, dict) else []
    while left:
        path, node, kind = left.pop()
        kind = node.get("$type", kind) if isinstance(node, dict) else kind
        for key, value in node.items() if isinstance(node, dict) else ((str(k), v) for k, v in enumerate(node)):
            here = f"{path}.{key}" if path else key
            if key.startswith("$") or not isinstance(value, dict | list):
                continue
            if isinstance(value, dict) and "$value" in value:
                found.append((here, tokens._text(value["$value"]), tokens._text(value.get("$type", kind))))
            else:
                left.append((here, value, kind))
    return found


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [typed_leaves(x) for x in batch.column("json").to_pylist()]
        ids = batch.column("id").take(pa.array([k for k, x in enumerate(found) for _ in x], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([leaf[n] for x in found for leaf in x], pa.string()) for n in range(3))], names=["id", "path", "value", "type"])


def read_tokens(files: DataFrame) -> DataFrame:
    """Tokens of files (id, name, text): (id, path, value, type).

    A .json file gives the $value of its objects with the nearest $type above or beside, or, where it has none, its values
    two levels deep (group and key; the type is the group without a last s). A .css file gives its custom properties, of type
    unknown. Any other file makes the query fail, as a file that nothing reads would be missed in silence.
    """
    kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    texts = files.select(F.col("id").cast("long").alias("id"), F.when(kind.isin("json", "css"), kind).otherwise(F.raise_error(F.concat(F.lit("not a .json or .css file: "), F.coalesce("name", F.lit("null"))))).alias("kind"), F.col("text").cast("string").alias("text"))
    trees = texts.where("kind = 'json'")
    typed = trees.select("id", F.col("text").alias("json")).mapInArrow(_typed, "id long, path string, value string, type string")
    # a file without any $value has groups; its objects are taken apart as variants
    pairs = trees.where("not coalesce(text like '%\"$value\"%', false)").select("id", F.try_parse_json("text").alias("v")).where("schema_of_variant(v) like 'OBJECT%'")
    sql = files.sparkSession.sql
    groups = sql("SELECT id, g.key AS grp, g.value AS v FROM {pairs}, LATERAL variant_explode(v) g WHERE schema_of_variant(g.value) LIKE 'OBJECT%'", pairs=pairs)
    plain = sql("SELECT id, concat(grp, '.', e.key) AS path, CAST(e.value AS STRING) AS value, regexp_replace(grp, 's$', '') AS type FROM {groups}, LATERAL variant_explode(v) e", groups=groups)
    css = texts.where("kind = 'css'").select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(--[\w-]+:\s*[^;]+);"), 1)).alias("x")).select("id", F.regexp_extract("x", r"^--([\w-]+)", 1), _strip(F.regexp_replace("x", r"^[^:]*:", "")), F.lit("unknown"))
    return typed.union(plain).union(css)
