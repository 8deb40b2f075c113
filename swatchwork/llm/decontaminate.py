"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Every text is read twice. The first reading counts in how many texts each word n-gram of the benchmark's items stands. An
item's seeds are its n-grams that are rare in the corpus, against the item's own median, so phrases of the language bring
no pairs while an item that was copied a million times keeps all of its seeds. The second reading finds the seeds: hits of
one item that are no farther apart than its own length are one passage, which is cut out with what is missing of the item
on both sides and some room, so a passage is about as long as its item, whatever the text's length. A local alignment of
words then says how much of the item the passage holds, with words changed, dropped or put in between.

The benchmark is taken in blocks of a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

SEED_WORDS = 3
#: A seed stands in at most so many times as many passages as the median n-gram of its item (and RARE_LEAST always counts as rare).
RARE, RARE_LEAST = 4, 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's best possible score, and least number of aligned equal words.
LEAST_SCORE, LEAST_WORDS = 0.5, 8
#: Words of the benchmark that are looked up in one pass over the documents, about.
BLOCK_WORDS = 1 << 20
#: Words that are kept on each side of a passage, besides a quarter of the item's length.
ROOM = 12
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True


def _words(piece: textbatch.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits, in lower case, and the row of each."""
    ink = _INK[piece.data]
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    edge = piece.starts[1:-1]
    edge = edge[(edge > 0) & (edge < len(ink))]
    begin[edge] = ink[edge]
    stop[edge - 1] = ink[edge - 1]
    s = np.flatnonzero(begin)
    return textbatch.mixed(piece.hashes(s, np.flatnonzero(stop) + 1)), piece.row_of(s)


def _grams(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SEED_WORDS words in n rows and their first words; a row of fewer words is one run, which no longer row can hold."""
    key, at = textbatch.ngrams(word, row, SEED_WORDS)
    count = np.bincount(row, minlength=n)
    few = np.flatnonzero((count > 0) & (count < SEED_WORDS))
    if len(few):
        first = np.searchsorted(row, few)
        short = word[first] + count[few].astype(np.uint64)
        for k in range(1, SEED_WORDS - 1):
            more = count[few] > k
            short[more] = textbatch.mixed(short[more]) + word[first[more] + k]
        key, at = np.concatenate([key, textbatch.mixed(~short)]), np.concatenate([at, first])
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
    return textbatch.mixed(key).view(np.int64), at


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbatch.pieces(batch.column("text"), lower=True):
            word, row = _words(piece)
            gram, at = _grams(word, row, piece.n)
            cut = lambda row, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(piece.n + 1)).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(piece.first, piece.n), cut(row, word.view(np.int64)), cut(row[at], gram)], names=["item_id", "item", "grams"])


class _Lookup:
    """Which of many hashes are in a sorted list: a bit map drops nearly all others first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(16, int(np.ceil(np.log2(max(2, len(known))))) + 5)
        self.mask = np.int64((1 << bits) - 1)
        self.map = np.zeros(1 << bits, bool)
        self.map[known & self.mask] = True

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their places in the list."""
        maybe = np.flatnonzero(self.map[keys & self.mask])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.known, keys[maybe]), len(self.known) - 1)
        hit = self.known[at] == keys[maybe]
        return maybe[hit], at[hit]


def _counts(known: np.ndarray):
    """(gram, texts): in how many texts of a partition each known n-gram stands."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = _Lookup(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                word, row = _words(piece)
                gram, at = _grams(word, row, piece.n)
                hit, place = lookup(gram)
                own = np.unique(row[at[hit]] * len(known) + place)
                total += np.bincount(own % len(known), minlength=len(known))
            common.give_back()
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(total[some])], names=["gram", "texts"])

    return counts


class _Seeds:
    """The seeds of a block's items: sorted n-grams, and the items and places where each stands."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray, length: np.ndarray):
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.begin = np.append(first, len(gram))
        self.item, self.place, self.length = item[order], place[order], length  # length: of each item


def _passages(seeds: _Seeds):
    """(doc_id, item, start, passage): the windows of a text in which seeds of an item stand."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(seeds.gram)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                word, row = _words(piece)
                gram, at = _grams(word, row, piece.n)
                hit, g = lookup(gram)
                if not len(hit):
                    continue
                at = at[hit]
                many = seeds.begin[g + 1] - seeds.begin[g]
                ends = np.cumsum(many)
                owner = np.repeat(seeds.begin[g] - (ends - many), many) + np.arange(ends[-1])
                at, item, place = np.repeat(at, many), seeds.item[owner], seeds.place[owner]
                order = np.lexsort((at, item, row[at]))
                at, item, place = at[order], item[order], place[order]
                length = seeds.length[item]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (row[at[1:]] != row[at[:-1]]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[1:] + ROOM)
                first = np.flatnonzero(fresh)
                room, text = ROOM + length[first] // 4, row[at[first]]
                begin = np.searchsorted(row, text)
                lo = np.maximum(np.minimum.reduceat(at - place, first) - room, begin)
                hi = np.minimum(np.maximum.reduceat(at + length - place, first) + room, np.searchsorted(row, text, "right"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[piece.first + text], pa.int64()), pa.array(item[first].astype(np.int64)), pa.array(lo - begin), pa.array([word[a:b].view(np.int64) for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int64()))],
                    names=["doc_id", "item", "start", "passage"],
                )
            common.give_back()

    return passages


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman on words: best local score, its number of equal words, and the span of the passage that it covers.

    A row of the table is filled at once: a gap in the item costs a constant a word, so the best way to come from the left
    is a running maximum. Equal words and the start travel along with the scores.
    """
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    score, start, equal = np.zeros(n + 1, np.int64), np.arange(n + 1), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, 0)
    for w in item:
        same = passage == w
        cross = score[:-1] + np.where(same, MATCH, MISMATCH)
        down = score[1:] + GAP
        by_cross = cross >= down
        new, at, eq = np.zeros(n + 1, np.int64), np.arange(n + 1), np.zeros(n + 1, np.int64)
        value = np.maximum(np.where(by_cross, cross, down), 0)
        alive = value > 0
        new[1:] = value
        at[1:] = np.where(alive, np.where(by_cross, start[:-1], start[1:]), at[1:])
        eq[1:] = np.where(alive, np.where(by_cross, equal[:-1] + same, equal[1:]), 0)
        run = np.maximum.accumulate(new + steps)
        source = np.maximum.accumulate(np.where(new + steps == run, np.arange(n + 1), 0))
        score, start, equal = run - steps, at[source], eq[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(equal[top]), int(start[top]), top)
    return best


def _aligned(least_score: float, least_words: int):
    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[tuple[bytes, bytes], tuple] = {}
            out = []
            for r in batch.itertuples(index=False):
                item, passage = np.asarray(r.item), np.asarray(r.passage)
                key = (item.tobytes(), passage.tobytes())
                if key not in known:
                    known[key] = align(item, passage)
                score, equal, lo, hi = known[key]
                if score >= least_score * MATCH * len(item) and equal >= min(least_words, len(item)):
                    out.append((r.doc_id, r.item_id, score / (MATCH * len(item)), equal / len(item), r.start + lo, r.start + hi))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "coverage", "start_word", "end_word"])

    return aligned


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("item_id is not null")
    return items.distinct().mapInArrow(_item_words, "item_id long, item array<long>, grams array<long>").where(F.size("grams") > 0)


FOUND = "doc_id long, item_id long, score double, coverage double, start_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, coverage, start_word, end_word): each document that holds an item of ``benchmark`` (item_id, text), with its best place.

    ``score`` is the alignment's share of the item's best possible score, ``coverage`` the share of the item's words that
    stand equal in it; the two word numbers bound the passage, counting runs of letters and digits from 0. Case, marks and
    white space do not count. An item of fewer than SEED_WORDS words says nothing inside a text; it is held by a text that
    is nothing else. Null and empty texts, items without a word, and null ids give no rows. Rows that share a doc_id or an
    item_id count as one, with their best passage; ties take the first place. Whole texts of any length are read. Other
    columns are not looked at. An empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("doc_id is not null")
    items = common.stored(_items(benchmark))
    words = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-words // block_words))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = found.union(_block(texts, block, _aligned(least_score, least_words)))
    best = F.max(F.struct("score", "coverage", (-F.col("start_word")).alias("minus"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.coverage", (-F.col("best.minus")).alias("start_word"), "best.end_word")


def _block(texts: DataFrame, items: DataFrame, aligned) -> DataFrame:
    rows = items.toArrow()  # about block_words words at most
    if not len(rows):
        return texts.sparkSession.createDataFrame([], FOUND)
    grams = rows.column("grams").combine_chunks()
    gram, many = grams.flatten().to_numpy(), np.diff(grams.offsets.to_numpy())
    owner = np.repeat(np.arange(len(rows)), many)
    place = np.arange(len(gram)) - np.repeat(np.cumsum(many) - many, many)
    known, back = np.unique(gram, return_inverse=True)
    told = texts.mapInArrow(_counts(known), "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts")).toArrow()  # a row for each n-gram of the block
    count = np.zeros(len(known), np.int64)
    count[np.searchsorted(known, told.column("gram").to_numpy())] = told.column("texts").to_numpy()
    seen = pd.DataFrame({"owner": owner, "texts": count[back]})
    seen = seen[seen["texts"] > 0]
    median = seen.groupby("owner")["texts"].transform("median")
    rare = seen.index[seen["texts"] <= np.maximum(RARE_LEAST, RARE * median)].to_numpy()
    if not len(rare):
        return texts.sparkSession.createDataFrame([], FOUND)
    length = np.diff(rows.column("item").combine_chunks().offsets.to_numpy())
    passages = texts.mapInArrow(_passages(_Seeds(gram[rare], owner[rare], place[rare], length)), "doc_id long, item long, start long, passage array<long>")
    numbered = rows.select(["item_id"]).append_column("item_words", rows.column("item")).append_column("item", pa.array(np.arange(len(rows))))
    known_items = texts.sparkSession.createDataFrame(numbered)
    pairs = passages.join(known_items, "item").select("doc_id", "item_id", "start", "passage", F.col("item_words").alias("item"))
    return pairs.mapInPandas(aligned, FOUND)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
