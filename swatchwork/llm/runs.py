"""Periodic runs of words: maximal stretches that repeat their first words again and again.

Harmonic grid: a run of period p and at least 2p words covers two neighbouring multiples of p, so for every p the words at
jp and (j+1)p are compared for all j, n/1 + n/2 + n/3 + ... places in all. At each, the longest common extension forward
comes from a suffix array with its common prefixes and range minima, and the one backward from those of the reversed
words; if both together reach p, they bound a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

#: A run has at least this many words, and at least twice its period.
LEAST_WORDS = 12
#: Places of the grid that are looked at together.
CHUNK = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Extensions:
    """Longest common extensions of suffixes that lie in one text.

    ``word`` has an integer for each word, different in different texts; ``stop`` the index after the last word of its text.
    The suffix array comes by prefix doubling, which sorts only what is not yet told apart. Two neighbours that a round of
    2h words tells apart share between h and 2h words; the ranks of earlier rounds say how many. Memory: 4 bytes for each
    word and round, and rounds are the logarithm of the longest repeat.
    """

    def __init__(self, word: np.ndarray, stop: np.ndarray):
        n = len(word)
        order = np.argsort(word, kind="stable")
        slots = np.arange(n)
        head = np.ones(n, bool)
        head[1:] = word[order[1:]] != word[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
        lcp = np.zeros(n, np.int32)  # of a slot's suffix and the one before it
        lone = head & np.append(head[1:], True)
        slots, rounds, h = slots[~lone], [rank.copy()], 1
        while len(slots):
            at = order[slots]
            group, after = rank[at], at + h
            key = group.astype(np.int64) * (n + 1) + np.where(after < stop[at], rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            split = np.flatnonzero(new[1:] & (group[1:] == group[:-1])) + 1
            a, b, end = at[split - 1] + h, at[split] + h, stop[at[split]]
            shared = np.full(len(split), h, np.int32)
            for k in range(len(rounds) - 2, -1, -1):
                same = (np.maximum(a, b) < end) & (rounds[k][np.minimum(a, n - 1)] == rounds[k][np.minimum(b, n - 1)])
                step = same.astype(np.int32) << k
                a, b, shared = a + step, b + step, shared + step
            lcp[slots[split]] = shared
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            slots = slots[~(new & np.append(new[1:], True))]
            rounds.append(rank.copy())
            h *= 2
        self.rank, self.least = rank, [lcp]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and at j share, for i and j different and in one text."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in range(len(self.least), int(level.max(initial=0)) + 1):  # minima of 2**k neighbours
            below = self.least[-1]
            self.least.append(np.minimum(below[: -(1 << (k - 1))], below[1 << (k - 1) :]))
        out = np.zeros(len(x), np.int32)
        for k in np.unique(level):
            which = level == k
            table = self.least[k]
            out[which] = np.minimum(table[low[which]], table[high[which] - (1 << int(k)) + 1])
        return out


def _grid(starts: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p at which the words i and i + p are the same, i being a multiple of p from its text's start."""
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)), n // 2)
    if not len(text):
        return
    first = np.cumsum(n // 2) - n // 2
    p = np.arange(len(text)) - first[text] + 1
    count = (n[text] - 1) // p
    before = np.concatenate([[0], np.cumsum(count)])
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(before, before[low] + CHUNK, "right")) - 1)
        which = np.repeat(np.arange(low, high), count[low:high])
        period = p[which]
        i = starts[text[which]] + (np.arange(len(which)) - (before[which] - before[low])) * period
        same = word[i] == word[i + period]
        yield i[same], period[same]
        low = high


def find(starts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run; ``starts`` cuts ``word`` into texts. In order of start, then period."""
    none = np.zeros(0, np.int64)
    spots = list(_grid(starts, word))
    i, p = (np.concatenate(x) if spots else none for x in (list(zip(*spots, strict=True)) or [[none], [none]]))
    if not len(i):
        return none, none, none
    n = len(word)
    lengths = np.diff(starts)
    begin, stop = np.repeat(starts[:-1], lengths), np.repeat(starts[1:], lengths)
    forward = Extensions(word, stop).common(i, i + p)
    backward = np.zeros(len(i), np.int64)
    back = np.flatnonzero(i > begin[i])
    back = back[word[i[back] - 1] == word[i[back] + p[back] - 1]]
    if len(back):
        turned = Extensions(word[::-1], n - begin[::-1])
        backward[back] = turned.common(n - i[back], n - i[back] - p[back])
    held = forward + backward >= np.maximum(p, LEAST_WORDS - p)
    start, end, p = (i - backward)[held], (i + p + forward)[held], p[held]
    # one run may be met at many places, and at multiples of its period
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]]:
    """For each piece of the column: its first row and number of rows, where each row's words begin, the row of each run, the runs, and the collapsed texts as bytes with their cuts."""
    for piece in textbatch.pieces(column):
        s, e, row = piece.cuts()
        size = np.bincount(row, minlength=piece.n)
        starts = np.concatenate([[0], np.cumsum(size)])
        known = textbatch.mixed(piece.hashes(s, e) + np.uint64(1)) + textbatch.mixed(np.arange(1, piece.n + 1, dtype=np.uint64))[row]
        _, word = np.unique(known, return_inverse=True)
        start, end, period = find(starts, word)
        steps = np.zeros(len(s) + 1, np.int64)
        np.add.at(steps, start + period, 1)
        np.add.at(steps, end, -1)
        kept = np.cumsum(steps[:-1]) == 0
        # kept words with one blank after each but the last of a row
        ks, ke, krow = s[kept], e[kept], row[kept]
        more = np.zeros(len(ks), bool)
        more[:-1] = krow[1:] == krow[:-1]
        data = piece.data.copy()
        data[ke[more]] = 32
        inside = np.zeros(len(data) + 1, np.int8)
        inside[ks] += 1
        inside[ke + more] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        cuts = np.concatenate([[0], np.cumsum(inside)])[piece.starts]
        yield piece.first, piece.n, starts, np.searchsorted(starts, start, "right") - 1, (start, end, period), data[inside], cuts


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for first, n, starts, of, (start, end, period), data, cuts in _texts(batch.column("text")):
            runs = pa.StructArray.from_arrays([pa.array(start - starts[of]), pa.array(end - start), pa.array(period)], fields=list(kind))
            ids = batch.column("doc_id").slice(first, n).cast(pa.int64())
            texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(starts)), listed, texts], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each row of ``docs`` (doc_id, text), in one pass without a shuffle.

    ``runs`` has the start, length and smallest period of every run, in words, by start and then period; a run has at least
    LEAST_WORDS words and twice its period, and no word beside it carries the period on. ``collapsed`` joins by one blank
    the words that are in no run or in the first period of all that they are in.

    Null and empty texts have no words, no runs and an empty collapsed text. A text of any length is taken whole; working
    memory is some 60 bytes a word times the logarithm of its longest repeat. Repeated rows give repeated results, a null
    doc_id stays null, an empty table gives an empty table; other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_list, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """What the row contract asks of ``periodic_runs``: number of runs, the longest (ties: smallest start, then period) and two digests."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    rows = rows.withColumns({"start": -F.col("best.back"), "length": F.col("best.length"), "period": -F.col("best.short")})
    return rows.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one text of ten is made to repeat, as the row contract says; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    own = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.array_remove(F.split(own, common.SPACES), "")).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    made = F.array_join(F.transform("words", lambda x, i: F.when(i < a, x).otherwise(F.get("words", a + (i - a) % p))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_runs(common.table(spark, sf_dir, "documents"))))
