"""Quality by positive-unlabelled learning: the non-negative unbiased risk of a linear scorer.

The scorer sees how a text is written, not what it says: shares of letters, capitals, digits and marks, of words that
repeat the one before, of distinct words, and the shapes of its words (runs of one kind of character become one). It is
fitted to texts that are trusted to be good and to unlabelled texts of the corpus. The risk of the negative class, which
only the unlabelled texts can tell, is kept from falling below zero. Labels of bad texts serve for two numbers only: the
share of good ones among all labels estimates the class prior, and a logistic curve over labelled texts turns the scorer's
value into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

#: Bounds of the training sample: labelled texts, and texts whose label is not looked at.
LABELLED, UNLABELLED = 4000, 4000
SHAPES, STEPS, RATE, DECAY, THRESHOLD = 256, 300, 0.05, 1e-3, 0.3
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")
_CLASSES = {"lower": b"a", "upper": b"A", "digit": b"0", "symbol": b"#*$%&|<>~^=+@_\\/{}[]", "stress": b"!?", "stop": b".", "comma": b",;:", "line": b"\n"}
DENSE = [*_CLASSES, "again", "distinct", "most", "no_letter", "capital", "end_mark", "length", "long_word", "words"]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        value = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def features(piece: textbatch.Piece) -> np.ndarray:
    """A row of numbers for each text: DENSE, then the share of words in each of the hashed shapes."""
    n, data = piece.n, piece.data
    s, e, row = piece.cuts()
    words = np.bincount(row, minlength=n)
    share = lambda counts, of=None: np.divide(counts, words if of is None else of, out=np.zeros(n), where=(words if of is None else of) > 0)
    of_words = lambda flag: share(np.bincount(row[flag], minlength=n))
    size = np.diff(piece.starts)
    kind = _KIND[data]
    out = [share(piece.per_row(np.isin(np.arange(256), list(c))[kind]), size) for c in _CLASSES.values()]
    word = textbatch.mixed(piece.hashes(s, e) + np.uint64(1))
    again = np.zeros(len(s), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    own = textbatch.mixed(np.arange(1, n + 1, dtype=np.uint64))
    _, first, times = np.unique(word ^ own[row], return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, row[first], times)
    held = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    letters = held((kind == ord("a")) | (kind == ord("A")))
    lower, upper = held(kind == ord("a")), held(kind == ord("A"))
    in_word = lambda total: total[e] - total[s]
    out += [of_words(again), share(np.bincount(row[first], minlength=n)), share(most), of_words(in_word(letters) == 0)]
    out += [of_words((in_word(lower) == 0) & (in_word(upper) > 1)), of_words(np.isin(data[e - 1], list(b".!?:;,"))) if len(s) else np.zeros(n)]
    out += [share(np.bincount(row, e - s, n)), of_words(e - s > 24), np.log1p(words)]
    # shapes: the first byte of every run of one kind
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = kind[1:] != kind[:-1] if len(data) else False
    begin[s] = True
    at = held(begin[:-1])
    brief = textbatch.Piece(kind[begin[:-1]], np.array([0, int(at[-1])]), 0)
    shape = (textbatch.mixed(brief.hashes(at[s], at[e])) >> np.uint64(56)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    shapes = np.bincount(row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    return np.column_stack([*out, np.sqrt(shapes / np.maximum(words, 1)[:, None])])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbatch.pieces(batch.column("text")):
            part = batch.slice(piece.first, piece.n)
            x = features(piece).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), lists], names=["doc_id", "quality", "x"])


def fit(good: np.ndarray, web: np.ndarray, prior: float, known: np.ndarray, quality: np.ndarray) -> Model:
    """Minimises prior * R+(good) + max(0, R-(web) - prior * R-(good)) with the logistic loss; ``known`` sets the curve."""
    width = web.shape[1]
    if not len(good) or not len(web):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, 0.0)
    mean, scale = web.mean(0), web.std(0) + 0.02
    unit = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = unit(good), unit(web)
    theta = np.zeros(width + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, STEPS + 1):
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        negative = soft(zu).mean() - prior * soft(zp).mean()
        gp, gu = -prior * (1 - sigmoid(zp)) / len(p), np.zeros(len(u))
        if negative >= 0:
            gp, gu = gp - prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        else:  # step back from what overfits
            gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
        grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum()) + DECAY * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = unit(known) @ theta[:-1] + theta[-1]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve over one value, held back by a weak prior
        q = sigmoid(slope * z + shift)
        w = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((q - quality) * z).sum() + 0.1 * (slope - 1), (q - quality).sum() + 0.1 * shift])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Model(mean, scale, theta[:-1], float(theta[-1]), max(0.0, float(slope)), float(shift))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): at most LABELLED and UNLABELLED documents, by the smallest hashes of their ids."""
    first = lambda df, n: df.orderBy("h", "doc_id").limit(n).drop("h")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = first(known.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")), LABELLED)
    web = first(docs.where("doc_id is not null").select("doc_id").distinct().select("doc_id", F.lit(None).cast("int").alias("quality"), F.xxhash64("doc_id", F.lit(1)).alias("h")), UNLABELLED)
    sample = known.unionByName(web)  # at most LABELLED + UNLABELLED rows of two numbers
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text").mapInArrow(_vectors, "doc_id long, quality int, x array<float>")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])  # a repeated id counts once
    x = np.array(rows.column("x").combine_chunks().flatten().to_numpy(), np.float64).reshape(len(rows), len(DENSE) + SHAPES)
    quality = rows.column("quality").to_numpy().astype(np.float64)
    marked = ~np.isnan(quality)
    prior = float(quality[marked].mean()) if marked.any() else 0.5
    return fit(x[quality == 1], x[~marked], min(max(prior, 0.02), 0.98), x[marked], quality[marked])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, held_out, text). Null texts count as empty; whole texts are read."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text")):
                part = batch.slice(piece.first, piece.n)
                p = model.score(features(piece))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores THRESHOLD or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text"), size=textbatch.PIECE_BYTES // 4):
                yield batch.slice(piece.first, piece.n).filter(pa.array(model.score(features(piece)) >= THRESHOLD))
            common.give_back()

    return docs.mapInArrow(keep, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """A model from the rows of ``docs`` (doc_id, text) outside fold 0 and their ``labels`` (doc_id, quality)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(common.fold(F.col("doc_id"), folds) != 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(common.fold(F.col("doc_id"), folds) != 0)
    return common.learned_on_driver(train(rows, marks))


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text), learned from rows outside fold 0 and their ``labels``.

    Repeated ids in ``labels`` count once, good if any row says so; labels other than 0 and 1 are not used, nor are null
    ids. An id with several texts is learned from one of them. Without labels of good texts all scores are 0.5. Null texts
    count as empty; whole texts of any length are read; other columns are not looked at. Repeated rows get equal scores;
    an empty table gives an empty table.
    """
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = split.withColumn("held_out", common.fold(F.col("doc_id"), folds) == 0)
    return score(split.select("doc_id", "held_out", "text"), learn(docs, labels, folds))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
