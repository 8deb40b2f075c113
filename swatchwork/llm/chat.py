"""Chat formatting of typed content parts, with DataFrame functions alone.

A turn's content is an array of parts: text, image, audio or document. A visitor goes over the parts in order and puts
every attachment down as a numbered placeholder, noting its reference and the number of tokens that it will expand to.
Turns are marked by control strings; such strings inside texts, roles or references are escaped by character references,
which reading back undoes. Loss spans cover each assistant turn's content, in code points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: An image is cut into squares of this many pixels, a token each; audio has so many tokens a second, a document so many a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What may stand at the start of a control string of this or another usual template.
_ANGLE, _BRACKET = r"<(?=\||/?s>|<SYS>>|</SYS>>)", r"\[(?=/?INST\])"
_REFERENCE = r"&(?=(?:amp|lt|#91|#10);)"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, _REFERENCE, "&amp;")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "&lt;"), _BRACKET, "&#91;")


def unescape(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _in_line(text: Column) -> Column:
    """Escaped, with line feeds too, as roles and types stand in a line with control strings."""
    return F.replace(escape(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("&#10;"))


def _tokens(p: Column) -> Column:
    side = lambda c: F.ceil(F.greatest(F.coalesce(p[c], F.lit(0)), F.lit(0)) / IMAGE_PATCH)
    return (
        F.when(p["type"] == "image", side("width") * side("height"))
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(0)), F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _visit(parts: Column) -> Column:
    """One string for the parts of a turn: escaped texts, and <|kind_n|> for the n-th attachment of the turn."""
    kinds = F.transform(parts, lambda p: F.when(_is_text(p), F.lit(0)).otherwise(1))
    number = lambda i: F.aggregate(F.slice(kinds, 1, i + 1), F.lit(0), lambda a, x: a + x)
    placeholder = lambda p, i: F.concat(F.lit("<|"), _in_line(p["type"]), F.lit("_"), number(i).cast("string"), F.lit("|>"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p, i))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens), a row for each conversation of ``turns``.

    ``turns`` has conv_id, turn, role, and content (an array of PART) or text; with both, the content goes first and a
    text after it. Turns stand in the order of turn, then role, then parts; null turns first. Null roles and texts count
    as empty; repeated turns all stay. A part of another type than text, image, audio and document becomes a placeholder
    of no tokens; its type is escaped as roles are. ``attachments`` has (turn_index, number, type, ref, tokens) in order. Null conv_ids make one
    conversation. No turns, no rows; other columns are not looked at.
    """
    text_part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))).cast(PART)
    own = F.array(text_part(F.coalesce(F.col("text").cast("string"), F.lit("")))) if "text" in turns.columns else F.array().cast(f"array<{PART}>")
    given = F.coalesce(F.col("content").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if "content" in turns.columns else F.array().cast(f"array<{PART}>")
    parts = F.filter(F.concat(given, own), lambda p: p.isNotNull())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    told = lambda t: F.struct(_in_line(t["role"]).alias("role"), _visit(t["parts"]).alias("body"), F.filter(t["parts"], lambda p: ~_is_text(p)).alias("other"))
    chats = chats.select("conv_id", F.transform("turns", told).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "")
    # where each body begins and ends: running lengths over the turns
    step = lambda a, t: F.struct(
        (a["at"] + F.length(head(t)) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(head(t))).alias("begin"), (a["at"] + F.length(head(t)) + F.length(t["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")), step, lambda a: a["spans"])
    attachments = F.flatten(
        F.transform("turns", lambda t, i: F.transform(t["other"], lambda p, n: F.struct(i.alias("turn_index"), (n + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))))
    )
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds, unescaped; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - len(END))
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(body(x), F.instr(x, "\n") + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = format_chats(turns.unionByName(extra)).select("conv_id", "formatted", "loss_spans")
    read = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(text, '&((?:amp|lt|#91|#10);)', '&amp;\1', 'g'),
    '<(\||/?s>|<SYS>>|</SYS>>)', '&lt;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g')) AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + escaped + 11)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
