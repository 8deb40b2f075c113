"""Language-model scores of whole texts, from counts of the whole corpus.

The model is of order three with back-off: P(w | u v) = f(uvw) + b(uv) * (f(vw) + b(v) * P(w)), where f are discounted
shares, c(uvw) / (c(uv) + K3) and c(vw) / (c(v) + K2), b the mass that is left for the shorter context, K3 / (c(uv) + K3)
and K2 / (c(v) + K2), and P(w) = (c(w) + 1) / (N + V + 1). Shares and back-off weights are quantised in an Elias-Fano trie
that is cut into shards of bounded size by the hash of its roots, the last words of contexts.

One aggregate counts the words of all training texts. Then texts are read in blocks. A block sends each shard its distinct
entries (root, word before, word) with the counts that its training texts give, in one compact row. Roots go as 64-bit hashes and
the other two as 32 bits beside their root: of n words at one root n * n / 2**33 pairs are expected to fall together, less
than one below 90,000 words and some hundred of the million that a root has at most. A shard sums what all blocks sent, builds its trie as a mapped
file, and answers every block in the block's own order; a block's answers meet its texts, which by then are rows of
numbers. An answer has two quantised numbers for each entry, the share of orders three and two and what is left for the
word alone. Entries thus move once for each block and not for each place they stand at, and a block sends nothing to a shard
that it has no entry for, so there are never more messages than entries.

A word that is so frequent that its entries would outgrow a shard is cut into several roots: its contexts by the word
before, what follows it by the word after. The list of these words is at most N / HOT long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch
from swatchwork.llm.trie import BITS, Trie, codes, decoded, packed, unpacked

#: Words of a block, bytes of text for each shard, and places from which on a word has several roots.
BLOCK_WORDS, SHARD_BYTES, HOT = 2_000_000, 12 << 20, 1_000_000
#: Entries of several blocks that a shard looks up together.
AT_ONCE = 1_000_000
#: K2 and K3: how many places of a context weigh as much as what the shorter context says.
STRENGTH = (256.0, 16.0)
_START, _BEGIN, _END, _NONE = (np.uint64(x) for x in (0x13198A2E03707344, 0x243F6A8885A308D3, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


def _small(*arrays: np.ndarray) -> bytes:
    """Arrays in little space: bytes of one weight of an array's numbers stand together."""
    data = packed(*(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).ravel() if x.itemsize > 1 else x for x in arrays), np.array([ord(x.dtype.kind) * 256 + x.itemsize for x in arrays], np.int64))
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _large(data: bytes) -> list[np.ndarray]:
    *arrays, kinds = unpacked(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    kinds = [np.dtype(f"{chr(k // 256)}{k % 256}") for k in kinds]
    return [np.ascontiguousarray(x.reshape(k.itemsize, -1).T).view(k).ravel() if k.itemsize > 1 else x.view(k) for x, k in zip(arrays, kinds, strict=True)]


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences."""
    return np.diff(x, prepend=x.dtype.type(0))


class _Hot:
    """Frequent words and their counts, and how many roots each has."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hot: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.slots = (1 + self.counts // hot).astype(np.uint64)

    def find(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def root(self, hot: np.ndarray, other: np.ndarray, side: int) -> np.ndarray:
        """The root of a frequent word (a place in the list) for a word before it (side 1) or after it (side 2)."""
        slot = textbatch.mixed(other + np.uint64(side)) % self.slots[hot]
        return textbatch.mixed(self.words[hot] + (slot * np.uint64(4) + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15))

    def _all(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        slots = self.slots.astype(np.int64)
        own = np.repeat(np.arange(len(self.words)), slots)
        slot = (np.arange(len(own)) - np.repeat(np.cumsum(slots) - slots, slots)).astype(np.uint64)
        return textbatch.mixed(self.words[own] + (slot * np.uint64(4) + np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15)), own

    def contexts(self) -> np.ndarray:
        """Roots of the contexts of frequent words."""
        return self._all(1)[0]

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Roots of what follows a frequent word, sorted, and the word's count: such a root sees only a part of it."""
        roots, own = self._all(2)
        order = np.argsort(roots)
        return roots[order], self.counts[own][order]


class _Block:
    """Some texts: their tokens (words, then an end) as places in a sorted list of words, and their distinct entries."""

    def __init__(self, words: np.ndarray, token: np.ndarray, held: np.ndarray, sizes: np.ndarray, hot: _Hot):
        """``words`` are sorted hashes that hold the marks of a text's start, begin and end."""
        self.words, self.token, many = words, token.astype(np.int64), len(words)
        first = np.cumsum(sizes + 1) - sizes - 1
        start, begin, none = (np.searchsorted(words, x) for x in (_START, _BEGIN, _NONE))
        before, last = np.empty_like(self.token), np.empty_like(self.token)
        last[1:], before[2:] = self.token[:-1], self.token[:-2]
        last[first] = begin
        second = first[sizes > 0] + 1
        before[first], before[second] = start, begin
        del first, second
        context, self.context = np.unique(last * many + before, return_inverse=True)
        del before, last
        entry, self.entry = np.unique(self.context * many + self.token, return_inverse=True)
        del self.context, self.token
        self.counts = np.bincount(self.entry[np.repeat(~held, sizes + 1)], minlength=len(entry))
        self.word, own = entry % many, context[entry // many]
        self.last, self.before = own // many, own % many
        self.root = words[self.last]
        self.pair = np.zeros(0, np.int64)  # for each entry of a frequent word the entry of the pair alone
        frequent = hot.find(words)[self.last]
        some = np.flatnonzero(frequent >= 0)
        self.frequent = frequent
        if len(some):
            self.root = self.root.copy()
            self.root[some] = hot.root(frequent[some], words[self.before[some]], 1)
            key, back = np.unique(self.last[some] * many + self.word[some], return_inverse=True)
            pair_root = hot.root(hot.find(words[key // many]), words[key % many], 2)
            self.pair = np.full(len(entry), -1)
            self.pair[some] = len(entry) + back
            self.root = np.concatenate([self.root, pair_root])
            self.before = np.concatenate([self.before, np.full(len(key), none)])
            self.word = np.concatenate([self.word, key % many])
            self.counts = np.concatenate([self.counts, np.bincount(back, self.counts[some], len(key)).astype(np.int64)])
        # entries of one root stand in the order of the words before and of the words already
        self.order = np.argsort(self.root, kind="stable") if len(some) else np.arange(len(entry))

    def questions(self, shards: int) -> Iterator[tuple[int, bytes]]:
        root, before, word, counts = (x[self.order] for x in (self.root, self.before, self.word, self.counts))
        shard = (((root >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(shard, np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(edge)):
            own = slice(edge[k], edge[k + 1])
            n = edge[k + 1] - edge[k]
            fresh = np.ones(n, bool)
            fresh[1:] = root[own][1:] != root[own][:-1]
            begin = np.flatnonzero(fresh)
            part = (self.words >> np.uint64(64 - BITS)).astype(np.uint32)
            context = np.ones(n, bool)
            context[1:] = fresh[1:] | (before[own][1:] != before[own][:-1])
            at = np.flatnonzero(context)
            yield int(k), _small(_steps(root[own][begin]), np.diff(np.append(begin, n)).astype(np.uint32), part[before[own][at]], np.diff(np.append(at, n)).astype(np.uint32), part[word[own]], counts[own].astype(np.uint32))


def _entries(data: bytes) -> tuple[np.ndarray, ...]:
    """(roots, entries of each, before, word, count) of a question."""
    root, many, before, uses, word, counts = _large(data)
    return np.cumsum(root, dtype=np.uint64), many, np.repeat(before.astype(np.uint64), uses), word.astype(np.uint64), counts


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple]:
    """(ids, null, held, sizes, words, token) of some texts at a time."""

    def ready(parts: list[tuple]) -> tuple:
        ids, null, held, hashes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, at = np.unique(np.concatenate([hashes, [_START, _BEGIN, _END, _NONE]]), return_inverse=True)
        token = np.empty(len(hashes) + len(sizes), np.uint32)
        inner = np.ones(len(token), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        token[inner], token[~inner] = at[:-4], at[-2]
        return ids, null, held, sizes.astype(np.int64), words, token

    parts: list[tuple] = []
    for batch in batches:
        ids = batch.column("doc_id")
        null, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        for piece in textbatch.pieces(batch.column("text"), lower=True):
            s, e, row = piece.cuts()
            here = slice(piece.first, piece.first + piece.n)
            parts.append((number[here], null[here], held[here], textbatch.mixed(piece.hashes(s, e) + np.uint64(1)), np.bincount(row, minlength=piece.n)))
            if sum(len(x[3]) + len(x[4]) for x in parts) >= block_words:
                yield ready(parts)
                parts = []
    if parts:
        yield ready(parts)


def _name(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, token: np.ndarray) -> int:
    """A block's name, from what is in it."""
    name = textbatch.mixed(np.cumsum(textbatch.mixed(ids.view(np.uint64) + np.uint64(9)) + sizes.astype(np.uint64)))[-1]
    place = textbatch.mixed(words)[token] * (np.arange(len(token), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return int(np.array([name ^ place.sum(dtype=np.uint64)], np.uint64).view(np.int64)[0])


def _counted(block_words: int):
    """(word, n): places of each word, and of the end, in the training texts of a block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held, sizes, words, token in _blocks(batches, block_words):
            n = np.bincount(token[np.repeat(~held, sizes + 1)], minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(n[some])], names=["word", "n"])

    return counted


def _ask(shards: int, block_words: int, hot: _Hot):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, held, sizes, words, token in _blocks(batches, block_words):
            name = _name(ids, sizes, words, token)
            for k, question in _Block(words, token, held, sizes, hot).questions(shards):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name], pa.int64()), pa.array([question], pa.binary())], names=["shard", "block", "data"])

    return ask


def _tell(block_words: int):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, null, held, sizes, words, token in _blocks(batches, block_words):
            # frequent words get small numbers
            often = np.bincount(token, minlength=len(words)).astype(np.uint32)
            place = np.empty(len(words), np.uint32)
            place[np.argsort(-often.astype(np.int64), kind="stable")] = np.arange(len(words))
            data = _small(ids, null, held, sizes, _steps(words), often, place[token])
            yield pa.RecordBatch.from_arrays([pa.array([_name(ids, sizes, words, token)], pa.int64()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], names=["block", "shard", "data"])

    return tell


def _answer(hot: _Hot):
    hot_roots, hot_totals = hot.totals()

    def answer(table: pa.Table) -> pa.Table:
        """Sums what the blocks sent to one shard, builds its trie and answers each block: roots' totals, and two codes for each entry."""
        data = [x.as_buffer() for x in table.column("data")]
        roots = np.unique(np.concatenate([np.cumsum(_large(x)[0], dtype=np.uint64) for x in data]))
        parts: list[tuple] = []

        def summed() -> tuple:
            context, word, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
            context, place = np.unique(context, return_inverse=True)
            key = (place.astype(np.uint64) << np.uint64(BITS)) | word
            del place, word
            order = np.argsort(key)
            key, sums = key[order], sums[order]
            del order
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            key, sums = key[at], np.add.reduceat(sums, at) if len(at) else sums
            return context[key >> np.uint64(BITS)], key & np.uint64((1 << BITS) - 1), sums

        for one in data:
            root, many, before, word, counts = _entries(one)
            seen = np.flatnonzero(counts)
            own = np.repeat(np.searchsorted(roots, root), many)[seen].astype(np.uint64)
            parts.append(((own << np.uint64(BITS)) | before[seen], word[seen], counts[seen].astype(np.int64)))
            if sum(len(x[1]) for x in parts[1:]) > 2 * len(parts[0][1]) + 1_000_000:  # sums now and then keep memory near what they need
                parts = [summed()]
        context, word, sums = summed()
        del parts
        root, before = (context >> np.uint64(BITS)).astype(np.int64), context & np.uint64((1 << BITS) - 1)
        totals = np.bincount(root, sums, len(roots)).astype(np.int64)
        cut = np.zeros(len(roots), bool)
        if len(hot_roots):
            at = np.minimum(np.searchsorted(hot_roots, roots), len(hot_roots) - 1)
            cut = hot_roots[at] == roots
            totals = np.where(cut, hot_totals[at], totals)
        trie = Trie.open(Trie.build(roots, root, before, word, sums, totals, STRENGTH))
        del context, root, before, word, sums
        parts_of = np.union1d(hot_roots, hot.contexts())  # roots of frequent words: what follows the word alone is told apart
        out, some = [], []

        def told() -> Iterator[bytes]:
            """Answers to some questions: what they have in common is looked up once."""
            root, many, before, word = (np.concatenate(x) for x in zip(*some, strict=True))
            triple, follow, weight = trie.probabilities(np.repeat(root, many), before, word)
            alone = np.repeat(np.isin(root, hot_roots), many)
            whole = np.repeat(~np.isin(root, parts_of), many)
            share = codes(np.where(alone, follow, triple + np.where(whole, weight * follow, 0.0)))
            weight = codes(weight)
            distinct, back = np.unique(root, return_inverse=True)
            total, at, upto = trie.total(distinct)[back], 0, 0
            for of, uses, *_ in some:
                n = int(uses.sum())
                yield _small(total[at : at + len(of)], uses, share[upto : upto + n], weight[upto : upto + n])
                at, upto = at + len(of), upto + n

        for one in data:
            some.append(_entries(one)[:4])
            if sum(len(x[3]) for x in some) >= AT_ONCE:
                out += told()
                some = []
        if some:
            out += told()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array(out, pa.binary())})

    return answer


def _score(train: int, distinct: int, ends: int, hot: _Hot):
    def score(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("data"), strict=True), key=lambda r: r[0])
        told, answers = [r[1] for r in rows if r[0] < 0], [_large(r[1].as_buffer()) for r in rows if r[0] >= 0]
        if not told or len(told) > 1 and len({x.as_buffer().to_pybytes() for x in told}) > 1:
            raise ValueError("the documents were not the same rows when they were read again; write them to a table first")
        answers = answers[:: len(told)]
        ids, null, held, sizes, words, often, token = _large(told[0].as_buffer())
        words, token, null, held = np.cumsum(words, dtype=np.uint64), np.argsort(-often.astype(np.int64), kind="stable")[token], null.astype(bool), held.astype(bool)
        block = _Block(words, token, held, sizes, hot)
        told_codes = [np.empty(len(block.order), np.uint16) for _ in range(2)]
        roots = np.empty(len(block.order), np.int64)
        many = np.concatenate([x[1] for x in answers])
        if many.sum() != len(block.order):
            raise ValueError("the documents were not the same rows when they were read again; write them to a table first")
        for k in range(2):
            told_codes[k][block.order] = np.concatenate([x[2 + k] for x in answers])
        roots[block.order] = np.repeat(np.concatenate([x[0] for x in answers]), many)
        # how often each word stands in training texts: as often as it is followed, but for the end
        n = len(block.last)
        count = np.zeros(len(words), np.int64)
        count[block.last] = roots[:n]
        frequent = np.flatnonzero(block.frequent >= 0)
        count[block.last[frequent]] = hot.counts[block.frequent[frequent]]
        count[np.searchsorted(words, _END)] = ends
        shares, weight = (decoded(x) for x in told_codes)
        chance, weight = shares[:n].copy(), weight[:n]
        if len(frequent):
            chance[frequent] += weight[frequent] * shares[block.pair[frequent]]
        share = (count + 1) / (train + distinct + 1)
        last = block.last
        context = count[last].astype(np.float64)
        context[last == np.searchsorted(words, _BEGIN)] = ends
        chance += weight * STRENGTH[0] / (context + STRENGTH[0]) * share[block.word[:n]]
        row = np.repeat(np.arange(len(sizes)), sizes + 1)
        total = lambda x: np.bincount(row, x, len(sizes))
        known = total(count[token] > 0).astype(np.int64)
        out = pa.table(
            {
                "doc_id": pa.array(ids, mask=null),
                "held_out": pa.array(held),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(sizes), train, np.int64)),
                "base_score": pa.array(total(np.log10(share)[token])),
                "score": pa.array(total(np.log10(chance)[block.entry])),
            }
        )
        return pa.concat_tables([out] * len(told))

    return score


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, held_out, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS, hot: int = HOT) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), learned from those where ``held_out`` is false.

    Words are lower-cased in A-Z; each text has one end token more, so null and empty texts have one token. Scores are
    log10. Without training texts every token has the same share. Repeated rows get equal scores; whole texts of any length
    are read; an empty table gives an empty table; other columns are not looked at. ``docs`` is read several times and must
    give the same rows in the same partitions, as a stored table does; otherwise the job fails.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = rows.mapInArrow(_counted(block_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    end = int(_END.view(np.int64))
    often = F.collect_list(F.when((F.col("n") >= hot) & (F.col("word") != end), F.struct("word", "n")))  # N / hot rows at most
    r = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == end, F.col("n"))), often).first()
    known = _Hot(np.array([x[0] for x in r[3]], np.int64).view(np.uint64), np.array([x[1] for x in r[3]], np.int64), hot)
    shards = max(4, -(-size // shard_bytes))
    questions = rows.mapInArrow(_ask(shards, block_words, known), "shard int, block long, data binary")
    answers = questions.groupBy("shard").applyInArrow(_answer(known), "block long, shard int, data binary")
    told = rows.mapInArrow(_tell(block_words), "block long, shard int, data binary")
    return told.unionByName(answers).groupBy("block").applyInArrow(_score(r[0] or 0, r[1], r[2] or 0, known), SCHEMA)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"), common.fold(F.col("doc_id"), 7) == 2)
