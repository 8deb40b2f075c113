"""Queries over what the sources read: elements and stylesheets of real pages, facts of stylesheets, token files, runs and observations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.operators import cascade
from swatchwork.plans.catalog import _stream, _table, query
from swatchwork.sources import html, storage, stylesheets
from swatchwork.streaming import observations, runs, watch

# --- pages -------------------------------------------------------------------------------------------------------------
#: Pages without comments, scripts, styles and head, for SQL; fit for the supplied pages, whose tags are well written.
_BODY = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!doctype[^>]*>', '', 'g')"
_TAGS = f"""tg AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all({_BODY}, '<[a-zA-Z][^>]*>') AS t FROM pages)),
  el AS (SELECT page_id, ord::INT AS ord, lower(regexp_extract(t, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, regexp_extract(t, ' class="([^"]*)"', 1) AS class_list, CASE WHEN regexp_matches(t, ' href="') THEN regexp_extract(t, ' href="([^"]*)"', 1) END AS href FROM tg)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.from_pages(_table(spark, sf_dir, "pages"))


query("html_elements", f"WITH {_TAGS} SELECT * FROM el")(lambda s, d: _elements(s, d).select("page_id", "ord", "tag", "class_list", "href"))
query("html_tree")(lambda s, d: _elements(s, d).select("page_id", "ord", "parent", "depth", "tag", "has_text", "text_chars"))


def page_sheets(pages: DataFrame) -> DataFrame:
    """The style blocks of pages: (id, sheet, text), id being the page's; in document order."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), 1)
    return pages.select(F.col("page_id").alias("id"), F.posexplode(found).alias("sheet", "text"))


@query("html_declared_styles", f"""WITH {_TAGS}, sh AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style', 1)) AS css FROM pages),
  ru AS (SELECT page_id, unnest(regexp_extract_all(css, '([^{{}}]+\\{{[^{{}}]*\\}})', 1)) AS r FROM sh), de AS (SELECT page_id, trim(split_part(r, '{{', 1)) AS selector, unnest(string_split(rtrim(split_part(r, '{{', 2), '}}'), ';')) AS d FROM ru)
  SELECT el.page_id, trim(split_part(d, ':', 1)) AS property, trim(split_part(d, ':', 2)) AS value, count(*) AS elements FROM de JOIN el ON el.page_id = de.page_id AND el.tag = de.selector WHERE contains(d, ':') GROUP BY ALL""")
def html_declared_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    sheets = page_sheets(pages)
    # a page's sheets are read as one text each and told apart by their place
    numbered = sheets.select((F.col("id") * 4096 + F.col("sheet")).alias("id"), "text")
    rules = stylesheets.declarations(stylesheets.css_blocks(numbered)).withColumns({"page_id": F.floor(F.col("id") / 4096), "sheet": F.col("id") % 4096})
    return cascade.style_counts(cascade.declared_styles(html.from_pages(pages), rules))


# --- stylesheets and token files ---------------------------------------------------------------------------------------
#: A stylesheet for each part, made of its numbers and words: nested at-rules, strings with braces, comments.
_SHEET = """'/* ' || p_name || ' { */ @media (min-width: ' || p_size * 10 || 'px) { @supports (display: grid) { .c' || p_partkey % 50 || ', a[title="}"] { color: oklch(' || p_size || '% 0.1 ' || p_partkey % 360 || '); width: ' || p_size || 'vw } } } '
  || ':root { --size-' || p_size || ': ' || p_partkey || 'px; --pad: env(safe-area-inset-top) } '
  || '@keyframes k' || p_partkey % 7 || ' { from { opacity: 0 } ' || p_size || '% { opacity: 1; top: ' || p_size || 'px } } '
  || CASE WHEN p_partkey % 3 = 0 THEN '@container card (width > ' || p_size || 'px) { b { font-size: clamp(1rem, ' || p_size || 'vw, 3rem) } } ' ELSE '@font-face { font-family: "F' || p_size || '"; src: url(f' || p_partkey % 9 || '.woff2) } ' END"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SHEET).alias("text"))


query("stylesheet_facts", f"""WITH s AS (SELECT p_partkey AS id, {_SHEET} AS raw FROM part), t AS (SELECT id, regexp_replace(raw, '(?s)/\\*.*?\\*/', ' ', 'g') AS text FROM s),
  m AS (SELECT id, 'media' AS fact, unnest(regexp_extract_all(text, '@media\\s*([^{{]+)\\{{', 1)) AS value FROM t UNION ALL SELECT id, 'container', unnest(regexp_extract_all(text, '@container\\s*([^{{]*)\\{{', 1)) FROM t),
  f AS (SELECT id, unnest(regexp_extract_all(text, '(?i)((?:font-size|width)\\s*:\\s*[^;}}]*(?:clamp\\(|[0-9.]+v(?:w|h|min|max)\\b)[^;}}]*)', 1)) AS x FROM t),
  k AS (SELECT id, regexp_extract(b, '@keyframes\\s+([a-z0-9-]+)', 1) AS name, unnest(x) AS step, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT id, regexp_extract(text, '@keyframes[^{{]*\\{{(?:[^{{}}]*\\{{[^}}]*\\}})*', 0) AS b,
    regexp_extract_all(regexp_extract(text, '@keyframes[^{{]*\\{{((?:[^{{}}]*\\{{[^}}]*\\}})*)', 1), '([^{{}}]+\\{{[^}}]*\\}})', 1) AS x FROM t)),
  v AS (SELECT id, unnest(x) AS d, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT id, regexp_extract_all(regexp_extract(text, ':root\\s*\\{{([^}}]+)\\}}', 1), '(--[a-z0-9-]+\\s*:\\s*[^;}}]+)', 1) AS x FROM t)),
  o AS (SELECT id, regexp_extract(text, '@font-face\\s*\\{{([^}}]+)\\}}', 1) AS b FROM t WHERE contains(text, '@font-face'))
SELECT id, fact, 0 AS ord, '' AS name, trim(value) AS value FROM m
UNION ALL SELECT id, 'fluid', row_number() OVER (PARTITION BY id ORDER BY strpos(text, x))::INT - 1, trim(split_part(x, ':', 1)), trim(regexp_replace(x, '^[^:]*:', '')) FROM f JOIN t USING (id)
UNION ALL SELECT id, 'env', 0, regexp_extract(text, 'env\\(\\s*([a-z-]+)', 1), '' FROM t
UNION ALL SELECT id, 'modern', 0, 'oklch', regexp_extract(text, '(oklch\\([^)]+\\))', 1) FROM t
UNION ALL SELECT id, 'keyframes', ord::INT, name, trim(regexp_extract(step, '^([^{{]*)', 1)) || ' {{ ' || array_to_string(list_transform(list_filter(string_split(regexp_extract(step, '\\{{([^}}]*)\\}}', 1), ';'), lambda z: contains(z, ':')), lambda z: trim(split_part(z, ':', 1)) || ': ' || trim(split_part(z, ':', 2))), '; ') || ' }}' FROM k
UNION ALL SELECT id, 'variable', ord::INT, trim(split_part(d, ':', 1)), trim(regexp_replace(d, '^[^:]*:', '')) FROM v
UNION ALL SELECT id, 'font', 0, regexp_extract(b, 'font-family\\s*:\\s*[''"]?([^''";]+)', 1), 'normal | 400 | ' || trim(regexp_extract(b, 'src\\s*:\\s*([^;]+)', 1)) FROM o""")(lambda s, d: stylesheets.sheet_facts(_sheets(s, d)))

#: Token files of parts: a tree with types above and beside, plain groups, or custom properties.
_FILE = """CASE p_partkey % 3 WHEN 0 THEN '{"color":{"$type":"color","b' || p_size || '":{"$value":"#' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '"},"own":{"$type":"alias","$value":"{color.b' || p_size || '}"}}}'
  WHEN 1 THEN '{"sizes":{"s' || p_size || '":' || p_partkey || ',"m":"2px"},"odd":' || p_size || '}' ELSE ':root{--a' || p_size || ': ' || p_partkey || 'px; --b:url(x);}' END"""
query("token_files", f"""WITH f AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, {_FILE.replace("CAST(p_partkey % 1000 AS STRING)", "(p_partkey % 1000)::VARCHAR")} AS text FROM part)
SELECT id, 'color.' || k AS path, json_extract_string(text, '$.color.' || k || '."$value"') AS value, coalesce(json_extract_string(text, '$.color.' || k || '."$type"'), json_extract_string(text, '$.color."$type"')) AS type FROM (SELECT id, text, unnest(list_filter(json_keys(text, '$.color'), lambda k: k[1] <> '$')) AS k FROM f WHERE kind = 0)
UNION ALL SELECT id, 'sizes.' || k, json_extract_string(text, '$.sizes.' || k), 'size' FROM (SELECT id, text, unnest(json_keys(text, '$.sizes')) AS k FROM f WHERE kind = 1)
UNION ALL SELECT id, regexp_extract(x, '^--([a-z0-9-]+)', 1), trim(regexp_replace(x, '^[^:]*:', '')), 'unknown' FROM (SELECT id, unnest(regexp_extract_all(text, '(--[a-z0-9-]+:\\s*[^;]+);', 1)) AS x FROM f WHERE kind = 2)""")(
    lambda s, d: stylesheets.read_tokens(_table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 2, "t.css").otherwise("t.JSON").alias("name"), F.expr(_FILE).alias("text")))
)

# --- observations and runs ---------------------------------------------------------------------------------------------
_OBSERVED = """user_id AS page_id, event_id AS ord, event_id AS observation_id, ts, CASE event_type WHEN 'view' THEN 'load' WHEN 'click' THEN 'hover' WHEN 'signup' THEN 'focus' ELSE 'scroll' END AS trigger,
  concat('.s', event_id % 5) AS selector, CASE event_id % 3 WHEN 0 THEN 'fade' WHEN 1 THEN 'slide' ELSE 'spin' END AS name, CAST(floor(value) AS BIGINT) % 2 * 100.5e0 AS duration,
  CASE WHEN event_id % 2 = 0 THEN 'opacity' ELSE 'transform,opacity' END AS properties, CASE WHEN event_id % 11 <> 0 THEN event_id % 40 END AS instance_id"""
_MERGED_SQL = f"""WITH o AS (SELECT {_OBSERVED} FROM events), l AS (SELECT DISTINCT page_id, instance_id FROM o WHERE trigger = 'load' AND instance_id IS NOT NULL),
  k AS (SELECT o.*, CASE trigger WHEN 'load' THEN 0 WHEN 'scroll' THEN 1 ELSE 2 END AS turn FROM o LEFT JOIN l ON trigger = 'scroll' AND o.page_id = l.page_id AND o.instance_id = l.instance_id WHERE l.page_id IS NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, trigger, selector, name, duration, properties ORDER BY ord) AS n FROM k)
SELECT * FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY turn, ord)::INT AS rank, ord, trigger, selector, name, duration, properties, coalesce(instance_id, -1) AS instance_id FROM f WHERE n = 1) WHERE rank <= {observations.LIMIT}"""
query("observation_merge", _MERGED_SQL)(lambda s, d: observations.merged(_table(s, d, "events").selectExpr(*_expressions(_OBSERVED))).fillna(-1, ["instance_id"]))


def _expressions(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def _folder(spark: SparkSession) -> str:
    return f"{storage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_observation_merge", _MERGED_SQL)
def stream_observation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*_expressions(_OBSERVED))
    return observations.latest(watch.told(observations.merged_stream(rows), "observations", _folder(spark))).fillna(-1, ["instance_id"])


_TYPE = "CASE WHEN event_id % 211 = 0 THEN 'start' WHEN event_type = 'view' THEN 'frame' WHEN event_type IN ('click', 'purchase') THEN 'token' WHEN event_type = 'signup' THEN 'stage' WHEN event_id % 6 = 0 THEN 'cache' WHEN event_id % 6 = 1 THEN 'permalink' WHEN event_id % 6 = 2 THEN 'summary' WHEN event_id % 6 = 3 THEN 'files' WHEN event_id % 6 = 4 THEN 'error' ELSE 'idle' END"
_RUNS = f"""user_id AS run, event_id AS place, {_TYPE} AS type, CASE WHEN event_type = 'signup' THEN concat('stage', event_id % 4) WHEN event_id % 4 = 0 THEN 'dimension' WHEN event_id % 17 = 0 THEN 'fontFamily' ELSE 'color' END AS name,
  concat('p', event_id % 40) AS path, CASE WHEN event_type = 'error' AND event_id % 12 = 1 THEN '' WHEN event_type = 'error' AND event_id % 12 = 4 THEN NULL WHEN event_type <> 'error' AND event_id % 4 = 0 AND event_id % 12 <> 0 THEN concat(event_id % 90, 'px') WHEN event_id % 13 = 0 THEN 'auto' ELSE concat('#', event_id % 4096) END AS value,
  CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) % 60 END AS seq"""
_RUNS_SQL = f"""WITH e AS (SELECT {_RUNS} FROM events), b AS (SELECT run, coalesce(max(place) FILTER (type = 'start'), -1) AS begun FROM e GROUP BY run),
  a AS (SELECT e.*, type = 'token' AND value IS NOT NULL AS tok FROM e JOIN b USING (run) WHERE place >= begun),
  fr AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS i FROM a WHERE type = 'frame'),
  fold AS (WITH RECURSIVE r AS (SELECT run, i, CASE WHEN seq IS NULL THEN 0 WHEN seq >= -1 THEN seq ELSE -1 END AS cur, seq IS NULL OR seq >= -1 AS took, coalesce(value, '') AS shown FROM fr WHERE i = 1
    UNION ALL SELECT fr.run, fr.i, CASE WHEN fr.seq IS NULL THEN cur + 1 ELSE greatest(cur, fr.seq) END, true, CASE WHEN fr.seq IS NULL OR fr.seq >= cur THEN coalesce(fr.value, '') ELSE shown END FROM r JOIN fr ON fr.run = r.run AND fr.i = r.i + 1) SELECT run, arg_max(cur, i) AS frame_seq, arg_max(shown, i) AS frame, count(*) AS frames FROM r GROUP BY run),
  sw AS (SELECT run, place, path || '=' || value AS x, row_number() OVER (PARTITION BY run, path ORDER BY place) AS k FROM a WHERE tok AND name = 'color' AND starts_with(value, '#')),
  sx AS (SELECT run, string_agg(x, ',' ORDER BY place) AS swatches FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM sw WHERE k = 1) WHERE n <= {runs.SWATCHES} GROUP BY run),
  dx AS (SELECT run, string_agg(path || '=' || value, ',' ORDER BY place) AS dimensions FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM a WHERE tok AND name = 'dimension' AND regexp_matches(value, '^[0-9]')) WHERE n <= {runs.DIMENSIONS} GROUP BY run),
  st AS (SELECT run, string_agg(name, ',' ORDER BY p) AS stages FROM (SELECT run, name, min(place) AS p FROM a WHERE type = 'stage' GROUP BY 1, 2) GROUP BY run),
  g AS (SELECT run, coalesce(arg_max(CASE type WHEN 'start' THEN 'streaming' WHEN 'idle' THEN 'idle' WHEN 'files' THEN 'done' ELSE 'error' END, place) FILTER (type IN ('start', 'idle', 'files', 'error')), 'idle') AS status, bool_or(type = 'cache') AS cached,
    arg_max(value, place) FILTER (type = 'permalink' AND value <> '') AS hash, arg_max(name, place) FILTER (type = 'stage') AS stage, arg_min(value, place) FILTER (tok AND name = 'fontFamily' AND value <> '') AS font,
    arg_max(value, place) FILTER (type = 'summary') AS summary, arg_max(value, place) FILTER (type = 'files') AS files, arg_max(coalesce(value, 'Extraction failed'), place) FILTER (type = 'error') AS error FROM a GROUP BY run)
SELECT run, status, cached, hash, stage, coalesce(stages, '') AS stages, coalesce(frame_seq, -1) AS frame_seq, frame, coalesce(frames, 0) AS frames, coalesce(swatches, '') AS swatches, font, coalesce(dimensions, '') AS dimensions, summary, files, error
FROM g LEFT JOIN fold USING (run) LEFT JOIN sx USING (run) LEFT JOIN dx USING (run) LEFT JOIN st USING (run)"""
query("run_states", _RUNS_SQL)(lambda s, d: runs.reduced(_table(s, d, "events").selectExpr(*_expressions(_RUNS))).fillna(-1, ["frame_seq"]))


@query("stream_run_states", _RUNS_SQL)
def stream_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    with runs.with_rocksdb(spark):
        told = watch.told(runs.reduced_stream(_stream(spark, sf_dir).selectExpr(*_expressions(_RUNS))), "runs", _folder(spark))
    return runs.latest(told).fillna(-1, ["frame_seq"])
