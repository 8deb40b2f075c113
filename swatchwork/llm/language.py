"""Language of every word by a linear-chain conditional random field, and of a text by its words' posteriors.

A word's features are its prefixes and suffixes of one to three bytes, its byte n-grams of two to four bytes, the whole
word, and its membership in a lexicon of each language. The weights of all features and of the transitions between
neighbouring words are learned together, by gradient steps on the log likelihood of code-switched sequences that are
put together from texts of known language. Prediction is forward-backward over the whole text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

#: Bounds of the training sample: languages, texts of each, words taken from one text, runs in which they stand, and bytes of a word.
LANGUAGES, SAMPLE_TEXTS, SAMPLE_WORDS, RUNS, WORD_BYTES = 500, 300, 150, 5, 64
FEATURE_BITS, SEQUENCE, EPOCHS, BATCH, RATE, DECAY = 15, 32, 6, 48, 0.25, 1e-5
LEXICON_LEAST = 3
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_AFFIX, _GRAM = (1, 2, 3), (2, 3, 4)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, log potentials
    start: np.ndarray
    lexicon: np.ndarray  # sorted hashes of known words
    member: np.ndarray  # lexicon x labels
    lexicon_weight: np.ndarray  # labels x labels


@cache
def _letters() -> np.ndarray:
    """Which code points are letters by their Unicode class."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _in_letter(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are part of a letter."""
    if not len(data) or data.max() < 128:
        return _ASCII_LETTER[data]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = (data & 0xC0) != 0x80
    if len(points) != begin.sum():  # broken UTF-8: what is not ASCII counts as letters
        return _ASCII_LETTER[data] | (data >= 128)
    return _letters()[points][np.cumsum(begin) - 1]


def _words(piece: textbatch.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a letter: first letter to last letter of every word, so that marks at the edges say nothing."""
    s, e, row = piece.cuts()
    letter = _in_letter(piece.data)
    at = np.flatnonzero(letter)
    if not len(at):
        return s[:0], e[:0], row[:0]
    lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
    has = hi > lo
    return at[lo[has]], at[hi[has] - 1] + 1, row[has]


def _feature(h: np.ndarray, kind: int) -> np.ndarray:
    return (textbatch.mixed(h + np.uint64(kind * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _emissions(piece: textbatch.Piece, s: np.ndarray, e: np.ndarray, model: Model) -> np.ndarray:
    """Log potentials of each word and label."""
    w = model.weights
    size = e - s
    total = w[_feature(piece.hashes(s, e), 1)].copy()
    for k in _AFFIX:
        long = np.flatnonzero(size >= k)
        total[long] += w[_feature(piece.hashes(s[long], s[long] + k), 10 + k)]
        total[long] += w[_feature(piece.hashes(e[long] - k, e[long]), 20 + k)]
    for k in _GRAM:
        long = np.flatnonzero(size >= k)
        if not len(long):
            continue
        many = size[long] - k + 1
        ends = np.cumsum(many)
        begin = np.repeat(s[long] - (ends - many), many) + np.arange(ends[-1])
        total[long] += np.add.reduceat(w[_feature(piece.hashes(begin, begin + k), 30 + k)], ends - many) / many[:, None]
    return total + _in_lexicon(piece.hashes(s, e), model.lexicon, model.member) @ model.lexicon_weight


def _in_lexicon(h: np.ndarray, lexicon: np.ndarray, member: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros((len(h), member.shape[1]))
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return member[at] * (lexicon[at] == h)[:, None]


def posteriors(emission: np.ndarray, row: np.ndarray, model: Model, block: int = 256) -> np.ndarray:
    """Forward-backward for many chains at once: the words of all rows stand in one line, a new row begins anew.

    The line is cut into blocks of equal length. Products of transition matrices over all blocks side by side give each
    block's way through; a scan over blocks gives the messages at their edges, and a last pass fills them.
    """
    n, labels = emission.shape
    if not n:
        return emission
    block = max(8, min(block, int(np.sqrt(n)) + 1))
    blocks = -(-n // block)
    pad = blocks * block
    e = np.ones((pad, labels))
    e[:n] = np.exp(emission - emission.max(1, keepdims=True))
    fresh = np.ones(pad, bool)
    fresh[1:n] = row[1:] != row[:-1]
    move, start = np.exp(model.moves), np.exp(model.start)
    e, fresh = e.reshape(blocks, block, labels), fresh.reshape(blocks, block)
    unit = lambda m, axis: m / np.maximum(m.sum(axis, keepdims=True), 1e-300)

    def step(left: np.ndarray, t: int) -> np.ndarray:
        """Messages times the matrix of place t; at a chain's first word what came before only hands on its mass."""
        out = left @ move
        new = fresh[:, t]
        out[new] = left[new].sum(-1, keepdims=True) * start
        return out * (e[:, t, None, :] if left.ndim == 3 else e[:, t])

    way = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for t in range(block):
        way = step(way, t)
        way /= np.maximum(way.sum((1, 2), keepdims=True), 1e-300)
    ahead, behind = np.full((blocks, labels), 1 / labels), np.full((blocks, labels), 1 / labels)
    for b in range(1, blocks):
        v = ahead[b - 1] @ way[b - 1]
        ahead[b] = v / max(v.sum(), 1e-300)
    for b in range(blocks - 2, -1, -1):
        v = way[b + 1] @ behind[b + 1]
        behind[b] = v / max(v.sum(), 1e-300)
    forward = np.empty_like(e)
    v = ahead
    for t in range(block):
        forward[:, t] = v = unit(step(v, t), 1)
    v = behind
    for t in range(block - 1, -1, -1):
        forward[:, t] *= v
        arriving = v * e[:, t]
        new = fresh[:, t]
        v = arriving @ move.T
        v[new] = (arriving[new] @ start)[:, None]
        v = unit(v, 1)
    return unit(forward.reshape(pad, labels)[:n], 1)


def train(texts: pd.DataFrame) -> Model:
    """A model from rows (text, lang). Rows and words are taken in the order given, so the same rows give the same model."""
    labels = sorted(texts["lang"].unique())
    index = {x: k for k, x in enumerate(labels)}
    many = len(labels)
    none = Model(labels, np.zeros((1 << FEATURE_BITS, many)), np.zeros((many, many)), np.zeros(many), np.zeros(0, np.uint64), np.zeros((0, many)), np.zeros((many, many)))
    if not many:
        return none
    piece = next(textbatch.pieces(pa.array(texts["text"].tolist(), pa.string()), True, 1 << 40))
    s, e, row = _words(piece)
    if not len(s):
        return none
    truth = texts["lang"].map(index).to_numpy()[row]
    whole = piece.hashes(s, e)

    # the lexicon: words that a language has more often than chance, each with its share in every language
    lexicon, back = np.unique(whole, return_inverse=True)
    counts = np.zeros((len(lexicon), many))
    np.add.at(counts, (back, truth), 1)
    often = counts.sum(1) >= LEXICON_LEAST
    member = counts / counts.sum(1, keepdims=True)
    lexicon, member = lexicon[often], member[often]

    # features of every word, as one list with the word each belongs to and its share
    ids, owner, part = [_feature(whole, 1)], [np.arange(len(s))], [np.ones(len(s))]
    size = e - s
    for kind, k in [(10, k) for k in _AFFIX] + [(20, k) for k in _AFFIX]:
        long = np.flatnonzero(size >= k)
        at = (s[long], s[long] + k) if kind == 10 else (e[long] - k, e[long])
        ids.append(_feature(piece.hashes(*at), kind + k)), owner.append(long), part.append(np.ones(len(long)))
    for k in _GRAM:
        long = np.flatnonzero(size >= k)
        n = size[long] - k + 1
        ends = np.cumsum(n)
        begin = np.repeat(s[long] - (ends - n), n) + np.arange(n.sum())
        ids.append(_feature(piece.hashes(begin, begin + k), 30 + k)), owner.append(np.repeat(long, n)), part.append(np.repeat(1 / n, n))
    ids, owner, part = map(np.concatenate, (ids, owner, part))
    order = np.argsort(owner, kind="stable")
    ids, owner, part = ids[order], owner[order], part[order]
    begins = np.searchsorted(owner, np.arange(len(s) + 1))

    # sequences: runs of one text each, one to three runs of different texts after one another
    rng = np.random.default_rng(7)
    rows, first = np.unique(row, return_index=True)
    last = np.append(first[1:], len(row))

    def sequence() -> np.ndarray:
        cut = np.sort(rng.integers(0, SEQUENCE + 1, rng.integers(0, 3)))
        out = []
        for n in np.diff([0, *cut, SEQUENCE]):
            k = rng.integers(len(rows))
            at = rng.integers(first[k], max(first[k] + 1, last[k] - n + 1))
            out.append(np.arange(at, min(at + n, last[k])))
        return np.concatenate(out)

    w, moves, start, lw = none.weights.copy(), np.eye(many) * 2.0, np.zeros(many), np.eye(many)
    squares = [np.full_like(x, 1e-2) for x in (w, moves, start, lw)]
    steps = max(1, min(400, EPOCHS * len(s) // (BATCH * SEQUENCE)))
    for _ in range(steps):
        chains = [sequence() for _ in range(BATCH)]
        word = np.concatenate(chains)
        chain = np.repeat(np.arange(BATCH), [len(c) for c in chains])
        span = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in word])
        own = np.repeat(np.arange(len(word)), begins[word + 1] - begins[word])
        inside = _in_lexicon(whole[word], lexicon, member)
        emission = np.zeros((len(word), many))
        for k in range(many):
            emission[:, k] = np.bincount(own, w[ids[span], k] * part[span], len(word))
        emission += inside @ lw
        model = Model(labels, w, moves, start, lexicon, member, lw)
        p = posteriors(emission, chain, model)
        goal = np.eye(many)[truth[word]]
        error = goal - p
        begin = np.append(True, chain[1:] != chain[:-1])
        inner = np.flatnonzero(~begin)
        # expected moves: the pair posterior, from the two words' evidence without their own link counted twice
        pair = _pairs(emission, chain, model)[inner]
        grad_moves = goal[inner - 1].T @ goal[inner] - pair.sum(0)
        grads = [np.zeros_like(w), grad_moves, error[begin].sum(0), inside.T @ error]
        for k in range(many):
            grads[0][:, k] = np.bincount(ids[span], error[own, k] * part[span], len(w))
        for value, grad, square in zip((w, moves, start, lw), grads, squares, strict=True):
            grad = grad / BATCH - DECAY * value
            square += grad * grad
            value += RATE * grad / np.sqrt(square)
    return Model(labels, w.astype(np.float32), moves, start, lexicon, member, lw)


def _pairs(emission: np.ndarray, chain: np.ndarray, model: Model) -> np.ndarray:
    """Posterior of (label before, label) for each word; rows of a chain's first word mean nothing. Short chains only."""
    e = np.exp(emission - emission.max(1, keepdims=True))
    move, start = np.exp(model.moves), np.exp(model.start)
    n, labels = e.shape
    begin = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    size = np.diff(np.append(begin, n))
    forward, backward = np.zeros_like(e), np.ones_like(e)
    forward[begin] = start * e[begin]
    forward[begin] /= forward[begin].sum(1, keepdims=True)
    for t in range(1, size.max()):
        at = begin[size > t] + t
        v = (forward[at - 1] @ move) * e[at]
        forward[at] = v / v.sum(1, keepdims=True)
    for t in range(size.max() - 1, 0, -1):
        at = begin[size > t] + t
        v = (backward[at] * e[at]) @ move.T
        backward[at - 1] = v / v.sum(1, keepdims=True)
    out = np.zeros((n, labels, labels))
    out[1:] = forward[:-1, :, None] * move * (e * backward)[1:, None, :]
    return out / np.maximum(out.sum((1, 2), keepdims=True), 1e-300)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most SAMPLE_WORDS words of each text, in RUNS runs from places all over it that a hash of the text chooses."""
    for batch in batches:
        out = []
        for piece in textbatch.pieces(batch.column("text"), lower=True):
            s, e, row = _words(piece)
            edge = np.searchsorted(row, np.arange(piece.n + 1))
            name = textbatch.mixed(piece.hashes(piece.starts[:-1], piece.starts[1:]))
            size = SAMPLE_WORDS // RUNS
            for k in range(piece.n):
                words = edge[k + 1] - edge[k]
                at = np.arange(words)
                if words > SAMPLE_WORDS:
                    part = words // RUNS
                    shift = (textbatch.mixed(name[k] + np.arange(RUNS, dtype=np.uint64)) % np.uint64(part - size + 1)).astype(np.int64)
                    at = (np.arange(RUNS) * part + shift)[:, None] + np.arange(size)
                at = at.ravel() + edge[k]
                out.append(b" ".join(piece.data[s[i] : e[i]].tobytes() for i in at if e[i] - s[i] <= WORD_BYTES).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "h")), pa.array(out, pa.string())], names=["doc_id", "lang", "h", "text"])


def training_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> pd.DataFrame:
    """Excerpts of at most ``texts`` documents of each language, by the smallest hashes of their ids."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    # a bound on the hash lets through about twice as many documents of each language as are kept: one pass, and no sort of them all
    share = F.least(F.lit(1.0), F.lit(2.0 * texts) / F.count("*"))
    bounds = known.groupBy("lang").agg(F.count("*").alias("n"), share.alias("share")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", "share")
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    picked = known.join(F.broadcast(bounds), "lang").where(place <= F.col("share")).select("doc_id", "lang", F.shiftrightunsigned("h", 1).alias("h"), "text")
    picked = picked.mapInArrow(_excerpts, "doc_id long, lang string, h long, text string")
    rows = picked.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).toPandas()  # a repeated id counts once
    return rows.sort_values(["lang", "h", "doc_id"], ignore_index=True).groupby("lang").head(texts)[["text", "lang"]].reset_index(drop=True)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, mixture map<string,double>, spans array<struct<begin:int,end:int,lang:string>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _judged(piece: textbatch.Piece, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: each language's share of the mass, the best one's number (that after the last: none), its share, and the words; for each word its row and label."""
    s, e, row = _words(piece)
    label = np.zeros(len(row), np.int64)
    share, best, score = np.zeros((piece.n, len(model.labels))), np.full(piece.n, len(model.labels)), np.zeros(piece.n)
    words = np.bincount(row, minlength=piece.n)
    if len(model.labels) and len(s):
        _, first, back = np.unique(piece.hashes(s, e), return_index=True, return_inverse=True)
        p = posteriors(_emissions(piece, s[first], e[first], model)[back], row, model)
        some, label = words > 0, p.argmax(1)
        for k in range(len(model.labels)):
            share[:, k] = np.bincount(row, p[:, k], piece.n)
        share[some] /= words[some, None]
        best[some], score[some] = share[some].argmax(1), np.minimum(share[some].max(1), 1.0)
    return share, best, score, words, row, label


def _runs(row: np.ndarray, label: np.ndarray, words: np.ndarray, names: list[str]) -> pa.Array:
    """For each text the runs of words with one label: (begin, end, lang), counting the text's words with a letter from 0."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
    first = np.flatnonzero(fresh) if names else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row)) if len(first) else first
    zero = (np.cumsum(words) - words)[row[first]]
    runs = pa.StructArray.from_arrays([pa.array((first - zero).astype(np.int32)), pa.array((last - zero).astype(np.int32)), pa.array(np.array([*names, ""], object)[label[first]].tolist(), pa.string())], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(words) + 1)).astype(np.int32)), runs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, held_out, text): the language with most posterior mass over all words.

    ``score`` is its share of the mass, ``mixture`` has the shares of all languages, ``spans`` the runs of words that are
    most likely of one language. A null text, and one without a letter (by Unicode class), is ``und`` with score 0; so is
    every text if the model has learned no language. Ties go to the language that comes first. Whole texts of any length
    are read, other columns are not looked at; repeated rows give repeated results; an empty table gives an empty table.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                share, best, score, words, row, own = _judged(piece, model)
                part = batch.slice(piece.first, piece.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(score),
                        pa.array(words.astype(np.int64)),
                        pa.array([list(zip(model.labels, r, strict=True)) for r in share.tolist()], pa.map_(pa.string(), pa.float64())),
                        _runs(row, own, words, model.labels),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_words", "mixture", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(label, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a score of ``least`` or more; odd rows as in ``identify``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text"), lower=True, size=textbatch.PIECE_BYTES // 4):
                _, best, score, *_ = _judged(piece, model)
                yield batch.slice(piece.first, piece.n).filter(pa.array((best < len(model.labels)) & (score >= least)))
            common.give_back()

    return docs.mapInArrow(keep, docs.schema)


def learn(docs: DataFrame, folds: int = 5) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) outside fold 0."""
    return common.learned_on_driver(train(training_sample(docs.where(common.fold(F.col("doc_id"), folds) != 0))))


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows outside fold 0 that have a language, then labels every row; see ``identify`` for odd rows."""
    split = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    return identify(split, learn(docs, folds))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.table(spark, sf_dir, "documents")).drop("spans")
