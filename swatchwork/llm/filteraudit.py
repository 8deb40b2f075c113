"""How filters work together: what each removes alone, after others, in every order, from CUBE counts of failure flags.

Documents are first counted by part and flags, so that the CUBE runs over a few rows a part, however many documents there
are. A grouping set selects a subset of the filters; its row in which all selected flags are false counts the documents
that the whole subset lets pass. Each step of an order then is a pair of subsets that differ in one filter.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common

#: Failure conditions over text, words and n_words; the letter E is for repeated texts.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
COUNTS = ["n", "good", "toxic"]


def text_filters() -> dict[str, Column]:
    """Filters A to D as conditions under which a text fails."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.length(text),
        "D": F.coalesce(text.rlike(SYMBOLS), F.lit(False)),
    }


def flag(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeated: str = "E") -> DataFrame:
    """(doc_id, part, a boolean for each filter and for ``repeated``, good, toxic), a row for each row of ``docs`` (doc_id, text, source).

    A null text counts as an empty one and a null source as the part "". A row fails ``repeated`` if a row with a smaller
    doc_id has the same text (compared by SHA-256); a null doc_id neither fails it nor makes others fail, and rows that
    repeat one doc_id are not smaller than each other. A document is good (toxic) if any row of ``labels`` (doc_id, quality,
    toxic) with its doc_id says 1. Texts never move: only ids, digests and flags do. Other columns are not looked at.
    """
    filters = text_filters() if filters is None else filters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", common.SPACES), ""))
    rows = common.stored(rows.select("doc_id", "part", *(failed.alias(name) for name, failed in filters.items()), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # by digest and id, so that the copies of one text are spread; a null id meets no row
    rows = rows.join(firsts, ["digest", "doc_id"], "left")
    rows = rows.withColumn(repeated, F.col("doc_id").isNotNull() & F.col("first").isNull())
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # rows without an id are spread by their text; the other side's salt is 0, told so that it isn't folded away
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    known = known.withColumn("salt", F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"))
    no = F.lit(False)
    return rows.join(known, ["doc_id", "salt"], "left").select("doc_id", "part", *filters, repeated, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def subset_survivors(flagged: DataFrame, names: list[str]) -> DataFrame:
    """(part, subset, n, good, toxic): the rows of ``flagged`` that fail no filter of the subset, for each part and subset, zeros included.

    Bit i of ``subset`` stands for names[i]. Part null holds all parts together. Null flags count as passed. No rows, no parts.
    """
    passed = lambda c: F.coalesce(F.col(c), F.lit(False))
    cells = flagged.groupBy(F.coalesce("part", F.lit("")).alias("part"), *(passed(c).alias(c) for c in names)).agg(F.count("*").alias("n"), *(F.sum(passed(c).cast("long")).alias(c) for c in COUNTS[1:]))
    cells = common.stored(cells)
    cube = cells.cube("part", *names).agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.grouping(c).alias(f"no_{c}") for c in ["part", *names]))
    lone = [(F.col(f"no_{c}") == 1) | ~F.col(c) for c in names]
    for each in lone:
        cube = cube.where(each)
    subset = sum((1 - F.col(f"no_{c}")) * F.lit(1 << i) for i, c in enumerate(names))
    found = cube.select("part", subset.cast("int").alias("subset"), *COUNTS)
    # a subset that nothing survives has no row
    parts = cells.select("part").distinct().union(cells.limit(1).select(F.lit(None).cast("string")))
    spine = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    both = spine.alias("s").join(found.alias("f"), F.col("s.part").eqNullSafe(F.col("f.part")) & (F.col("s.subset") == F.col("f.subset")), "left")
    return both.select("s.part", "s.subset", *(F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in COUNTS))


def audit(flagged: DataFrame, names: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    ``names`` are single letters, five or so: there are as many rows a part as steps in all their orders. Part null holds all
    parts together. Counts are of documents; ``shapley`` is the filter's removed, summed over all orders.
    """
    k = len(names)
    survivors = common.stored(subset_survivors(flagged, names))
    edges = F.explode(F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(names))))
    before = survivors.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in COUNTS), edges.alias("e")).select("*", "e.*").where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    after = survivors.select(F.col("part").alias("after_part"), F.col("subset").alias("after"), *COUNTS)
    pairs = before.join(after, F.col("part").eqNullSafe(F.col("after_part")) & (F.col("before") + F.col("bit") == F.col("after")))
    pairs = pairs.select("part", "letter", "bit", "before", F.col("n").alias("kept"), *((F.col(f"{c}_before") - F.col(c)).alias(name) for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)))
    pairs = common.stored(pairs)
    orders_with = F.element_at(F.array(*(F.lit(math.factorial(b) * math.factorial(k - 1 - b)) for b in range(k))), F.bit_count("before") + 1)
    at = lambda subset: F.sum(F.when(F.col("before") == subset, F.col("removed")).otherwise(0))
    totals = pairs.groupBy(F.col("part").alias("t_part"), F.col("letter").alias("t_letter")).agg(at(0).alias("fails"), at(F.lit((1 << k) - 1) - F.col("bit")).alias("unique_fails"), F.sum(orders_with * F.col("removed")).alias("shapley"))
    bit = {c: 1 << i for i, c in enumerate(names)}
    # a fixed table: every order of the filters, whatever the data
    steps = [("".join(order), s + 1, order[s], sum(bit[c] for c in order[:s])) for order in permutations(names) for s in range(k)]
    steps = flagged.sparkSession.createDataFrame(steps, "filter_order string, step int, letter string, before int")
    out = pairs.join(F.broadcast(steps), ["letter", "before"]).join(totals, F.col("part").eqNullSafe(F.col("t_part")) & (F.col("letter") == F.col("t_letter")))
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return audit(flagged, list("ABCDE")).where(F.col("part").isNotNull())


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flagged AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM texts
), said AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged LEFT JOIN said USING (doc_id) GROUP BY ALL
), survivors AS (
  SELECT part, s.range AS subset, coalesce(sum(n) FILTER (fails & s.range = 0), 0) AS n,
    coalesce(sum(good) FILTER (fails & s.range = 0), 0) AS good, coalesce(sum(toxic) FILTER (fails & s.range = 0), 0) AS toxic
  FROM masks, range(32) s GROUP BY ALL
), letters AS (SELECT i.range AS i, 1 << i.range AS bit, substr('ABCDE', i.range + 1, 1) AS letter FROM range(5) i
), orders AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), steps AS (
  SELECT filter_order, s.range AS step, bits[s.range] AS bit, coalesce(list_sum(bits[1:s.range - 1]), 0)::BIGINT AS before
  FROM orders, range(1, 6) s
), moves AS (
  SELECT x.part, filter_order, step, bit, y.n AS kept, x.n - y.n AS removed, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps JOIN survivors x ON x.subset = before JOIN survivors y ON y.part = x.part AND y.subset = before + bit
), totals AS (
  SELECT part, bit, coalesce(sum(n) FILTER (fails & bit <> 0), 0) AS failing, coalesce(sum(n) FILTER (fails = bit), 0) AS alone
  FROM masks, letters GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant,
  alone::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM moves JOIN totals USING (part, bit)
"""
