"""A corpus from raw documents to a mix, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, decontaminate, language, mixing, neardup, quality

#: A text whose best language has less than this share of it is rejected.
LEAST_LANGUAGE = 0.4


def _id() -> Column:
    """The id of a row; one without gets a large one of its own text, so that rows without an id are judged too."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 3))


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("doc_id"), "text")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (doc_id)."""
    own, gone = _free(docs, "own"), _free(docs, "gone")
    left = docs.withColumn(own, _id()).join(common.small(common.stored(ids.select(F.col("doc_id").alias(gone)).distinct())), F.col(own) == F.col(gone), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def _free(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those in which no language stands out.

    Null and empty texts go. Learns from rows with a language outside fold 0; rows with a null language are judged only. If
    nothing can be learned, all rows go. Repeated rows are kept or rejected together. Whole texts of any length are read.
    An empty table gives an empty table, with all columns, whatever they are called.
    """
    common.bounded_batches(spark)
    return language.keep_identified(docs, language.learn(docs), LEAST_LANGUAGE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier takes for bad.

    Null and empty texts are judged as empty ones; a null id is judged, but nothing is learned from it. Without labels of
    good texts all rows stay. Repeated rows are kept or rejected together. Whole texts of any length are read. An empty
    table gives an empty table, with all columns, whatever they are called.
    """
    common.bounded_batches(spark)
    return quality.keep_good(docs, quality.learn(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 80 percent of their runs of five words.

    The smallest id of a group stays, and one of several rows with this id. Rows without an id take part by their text and
    give way to those with one. Null and empty texts are in no group. Whole texts of any length are read. An empty table
    gives an empty table, with all columns, whatever they are called.
    """
    common.bounded_batches(spark)
    ids = _ids_and_texts(docs)
    name, mine = _free(docs, "several"), _free(docs, "mine")
    several = common.small(common.stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name))))
    kept = _without(docs, neardup.near_duplicates(ids).where("not kept")).withColumn(mine, _id())
    own, text = F.col(mine) == F.col(name), F.col("text").cast("string")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(several, own, "left_semi").groupBy(mine).agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64(text), text)).alias("row"))
    return kept.join(several, own, "left_anti").select(*columns).union(one.select("row.*"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark.

    Rows with one id go together, with or without an item in each; rows without an id are judged by their text. Null and
    empty texts stay. Whole texts of any length are read. An empty table gives an empty table, and with an empty benchmark
    all rows stay, with all columns, whatever they are called.
    """
    common.bounded_batches(spark)
    return _without(docs, decontaminate.contaminated(_ids_and_texts(docs), common.table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; nulls, ties, repeated rows and other columns as in ``mixing.mix``."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: Learned models, alignments and seeded draws cannot be told in SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the checkpoint folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)
    return docs
