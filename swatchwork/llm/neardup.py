"""Near-duplicates by bottom-k sketches from one hash function.

A text's sketch is its k smallest shingle hashes. Texts with equal sets are one class, and one text stands for each.
Inverted lists of the retained values say how many of a sketch's values other sketches hold; texts with too few of them
are done. The others' values, from rare to common, are cut to a prefix: two sketches that overlap enough share one of
its values, by the pigeonhole principle. The sketch of a pair's union estimates the resemblance and drops pairs that are
far off; what is left is compared on full sets.

Nothing grows with the square of a group. All members of a list are first compared with its hub, the member whose values
are the most common, and linked ones join one component. Only lists with several components go on. Their texts are listed
once more by the rarest values of their whole sets: a text of which the others hold too little is done. Of two texts of a
list at least one is not linked with the hub. What both share with the hub may be enough for a link, as where one is a
part of the other; else they share values that the hub has not, and only texts that share one of these meet.

Full sets are compared in a stream: the first text of a pair is read once for a bounded share of its partners, who pass
by one after another, so that no row has two sets and no group is held in memory.

With ``sketch=None`` every value is retained, and the same steps are exact. With k values, two texts with a resemblance
of 0.8 have a chance of under one in ten million to share fewer than half of their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch
from swatchwork.llm.components import connected_components

SKETCH = 64
SHINGLE_WORDS, PERCENT = 5, 80
#: Partners for whom the first text of a pair is read once.
PARTNERS = 256


def _shingles(piece: textbatch.Piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and their rows."""
    s, e, row = piece.cuts()
    word = textbatch.mixed(piece.hashes(s, e) + np.uint64(1))
    del s, e
    key, at = textbatch.ngrams(word, row, words)
    key, owner = textbatch.mixed(key), row[at]
    count = np.bincount(row, minlength=piece.n)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.searchsorted(row, few)
        short = word[first].copy()
        for k in range(1, words):
            more = count[few] > k
            short[more] = textbatch.mixed(short[more] * np.uint64(0x9E3779B97F4A7C15) + word[first[more] + k])
        short = textbatch.mixed(short ^ count[few].astype(np.uint64))
        key, owner = np.concatenate([key, short]), np.concatenate([owner, few])
    key = key.view(np.int64)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[first], owner[first]


def _digests(key: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """Two sums that stand for the set of each row."""
    sums = (np.concatenate([[np.uint64(0)], np.cumsum(textbatch.mixed(key.view(np.uint64) + np.uint64(salt)))]) for salt in (3, 5))
    return [(x[edge[1:]] - x[edge[:-1]]).view(np.int64) for x in sums]


def _digest(words: int, sketch: int | None):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                key, owner = _shingles(piece, words)
                size = np.bincount(owner, minlength=piece.n)
                edge = np.concatenate([[0], np.cumsum(size)])
                sets = _digests(key, edge)
                if sketch:
                    key = key[np.arange(len(key)) - edge[owner] < sketch]
                    edge = np.concatenate([[0], np.cumsum(np.minimum(size, sketch))])
                lists = pa.LargeListArray.from_arrays(pa.array(edge), pa.array(key)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(piece.first, piece.n), pa.array(size.astype(np.int64)), *map(pa.array, sets), lists], names=["doc_id", "n_shingles", "key", "check", "sketch"])
            common.give_back()

    return digest


def _values(words: int):
    """(key, value): all shingles of the texts, a row each."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("key").to_numpy()
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                value, owner = _shingles(piece, words)
                key = _digests(value, np.searchsorted(owner, np.arange(piece.n + 1)))[0]
                mine = (key == want[piece.first : piece.first + piece.n])[owner]
                yield pa.RecordBatch.from_arrays([pa.array(key[owner[mine]]), pa.array(value[mine])], names=["key", "value"])
            common.give_back()

    return values


def _overlaps(words: int):
    """From rows sorted by (b, part), b's own text first: what every other text shares with it."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, np.zeros(0, np.int64)
        for batch in batches:
            b, part, key, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "part", "key", "member"))
            for piece in textbatch.pieces(batch.column("text"), lower=True):
                value, owner = _shingles(piece, words)
                edge = np.searchsorted(owner, np.arange(piece.n + 1))
                own = _digests(value, edge)[0]
                out = []
                for k in range(piece.n):
                    at, mine = piece.first + k, value[edge[k] : edge[k + 1]]
                    if own[k] != key[at]:  # another text of the same id
                        continue
                    if not member[at]:
                        now, hub = (b[at], part[at]), mine.copy()
                    elif now == (b[at], part[at]):
                        place = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                        out.append((key[at], b[at], len(mine), len(hub), int((hub[place] == mine).sum())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], names=["a", "b", "size_a", "size_b", "shared"])
            common.give_back()

    return overlaps


def _possible(size_a: Column, size_b: Column, shared: Column) -> Column:
    """Whether so many shared shingles are enough for a link."""
    return 100 * shared >= PERCENT * (size_a + size_b - shared)


class _Texts:
    """The texts, and the class keys of those that stand for a class."""

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int):
        self.texts, self.classes, self.words = texts, classes, words
        self.nodes = classes.select("key", "node")

    def _with_text(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (key, ...) with the text of each key; only texts that are asked for move."""
        rows = common.small(common.stored(rows.join(self.nodes, "key")))
        return self.texts.join(rows, F.col("doc_id") == F.col("node")).select(*columns, "text")

    def values(self, keys: DataFrame) -> DataFrame:
        return self._with_text(keys, "key").mapInArrow(_values(self.words), "key long, value long")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(a, b, size_a, size_b, shared) of the full sets of each pair (a, b)."""
        groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        members = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("key"), F.lit(True).alias("member"))
        hubs = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("key"), F.lit(False).alias("member"))
        rows = self._with_text(members.unionByName(hubs), "b", "part", "key", "member").repartition("b", "part").sortWithinPartitions("b", "part", "member")
        return common.stored(rows.mapInArrow(_overlaps(self.words), "a long, b long, size_a long, size_b long, shared long").distinct())


def _listed(classes: DataFrame, sketch: int | None) -> DataFrame:
    """(key, size, rank, prefix) of the texts of whose sketch others hold as much as a linked pair shares: the rarest of these values."""
    values = classes.select("key", "size", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("texts")).where("texts > 1")
    rows = values.join(often, "value").groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("texts", "value"))).alias("held"))
    exact = F.ceil(F.col("size") * PERCENT / 100)  # a whole set, as the other one's is
    needed = exact if sketch is None else F.when(F.col("size") * 100 <= sketch * PERCENT, exact).otherwise(sketch // 2)
    cut = (F.size("held") - needed + 1).cast("int")
    rank = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["texts"])
    rows = rows.select("key", "size", rank.alias("rank"), "held", cut.alias("cut")).where("cut > 0")
    return rows.select("key", "size", "rank", F.transform(F.slice("held", 1, F.col("cut")), lambda x: x["value"]).alias("prefix"))


def _estimated(pairs: DataFrame, classes: DataFrame, sketch: int | None) -> DataFrame:
    """The pairs (a, b) whose sizes and whose union's sketch allow for a link."""
    side = lambda name, x, size: classes.select(F.col("key").alias(name), F.col("sketch").alias(x), F.col("size").alias(size))
    both = pairs.join(side("a", "x", "n"), "a").join(side("b", "y", "m"), "b").where(100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))
    union = F.array_sort(F.array_union("x", "y"))
    if sketch is None:
        return both.where(_possible(F.col("n"), F.col("m"), F.size(F.array_intersect("x", "y")))).select("a", "b")
    union = F.slice(union, 1, sketch)
    shared = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    return both.where((F.size(union) < sketch) | (shared >= sketch // 2)).select("a", "b")


def _split(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """``entries`` (key, value, ...) of the lists that have members of more than one component, with ``part``."""
    placed = entries.join(parts.select(F.col("node").alias("key"), F.col("component")), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")
    several = placed.groupBy("value").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most").select("value")
    return placed.join(several, "value", "left_semi")


def _left(rows: DataFrame, parts: DataFrame, texts: _Texts) -> DataFrame:
    """(key, size, held, rank, prefix) of the texts of lists with several components: ``held`` are the values of their whole sets that others that are left hold, from rare to common, ``prefix`` the rarest of them."""
    entries = common.stored(_split(rows.select("key", "size", F.explode("prefix").alias("value")), parts))
    values = common.stored(texts.values(entries.select("key").distinct()))
    often = values.groupBy("value").agg(F.count("*").alias("texts")).where("texts > 1")
    held = values.join(often, "value").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("texts", "value"))).alias("lists"))
    left = held.join(entries.groupBy("key").agg(F.first("size").alias("size")), "key")
    cut = (F.size("lists") - F.ceil(F.col("size") * PERCENT / 100) + 1).cast("int")
    rank = F.aggregate("lists", F.lit(0).cast("long"), lambda a, x: a + x["texts"]) / F.col("size")
    left = left.select("key", "size", F.transform("lists", lambda x: x["value"]).alias("held"), rank.alias("rank"), cut.alias("cut")).where("cut > 0")
    return left.select("key", "size", "held", "rank", F.slice("held", 1, F.col("cut")).alias("prefix"))


def _hubs(entries: DataFrame) -> DataFrame:
    """(value, hub): of each list of several texts the one whose values are the most common."""
    hubs = entries.groupBy("value").agg(F.max(F.struct("rank", "key")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    return common.stored(hubs.select("value", F.col("hub.key").alias("hub")))


def _star(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    return entries.join(hubs, "value").where("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()


def _pairs(rows: DataFrame, most: Column) -> DataFrame:
    """Pairs (a, b) of rows (value, key, part, size, ...) of one value and different parts that, sharing at most ``most``, have room for a link."""
    other = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    apart = (F.col("value") == F.col("b_value")) & (F.col("part") < F.col("b_part"))
    return rows.join(other, apart & _possible(F.col("size"), F.col("b_size"), most)).select(F.col("key").alias("a"), F.col("b_key").alias("b")).distinct()


def _met(left: DataFrame, hubs: DataFrame, shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's texts in different components that, by what both share with the hub and hold besides, have room for a link."""
    entries = _split(left.select("key", "size", F.explode("prefix").alias("value")).join(hubs, "value").where("key != hub"), parts)
    with_hub = shared.select(F.col("a").alias("key"), F.col("b").alias("hub"), "shared")
    one = common.stored(entries.join(with_hub, ["key", "hub"]).select("value", "hub", "key", "part", "size", "shared"))
    # with a partner of so many shingles at least, the shared ones that a link needs: no text has to look for smaller ones than its lists have
    needed = F.ceil(PERCENT * (F.col("size") + F.greatest(F.col("least"), F.ceil(F.col("size") * PERCENT / 100))) / (100 + PERCENT))
    # what both share with the hub is enough
    least = one.groupBy("value").agg(F.min("size").alias("least"))
    within = one.join(least, "value").where(F.col("shared") >= needed).select("value", "key", "part", "size", "shared")
    several = within.groupBy("value").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first != last").select("value")
    within = common.stored(within.join(several, "value", "left_semi"))
    # they share values besides the hub's; these stand in lists of their own, by hub
    least = one.groupBy("hub").agg(F.min("size").alias("least"))
    rows = one.select("hub", "key", "part", "size", "shared").distinct().join(least, "hub")
    rows = rows.join(left.select("key", "held"), "key").join(left.select(F.col("key").alias("hub"), F.col("held").alias("hub_held")), "hub")
    rows = rows.select("hub", "key", "part", "size", "shared", F.array_except("held", "hub_held").alias("own"), needed.alias("needed")).withColumn("n", F.size("own"))
    cut = F.col("n") - F.greatest(F.col("needed") - F.col("shared"), F.lit(1)) + 1
    rows = rows.where(cut > 0).select("key", "part", "size", "shared", "n", F.explode(F.transform(F.slice("own", 1, cut.cast("int")), lambda x: F.struct("hub", x.alias("own")))).alias("value"))
    several = rows.groupBy("value").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first != last").select("value")
    besides = common.stored(rows.join(several, "value", "left_semi"))
    both = F.least("shared", "b_shared")
    return _pairs(within, both).union(_pairs(besides, both + F.least("n", "b_n"))).distinct()


def _links(classes: DataFrame, texts: _Texts, sketch: int | None) -> DataFrame:
    """Links (a, b) between class keys that hold each component together."""
    links = lambda df: df.where(_possible(F.col("size_a"), F.col("size_b"), F.col("shared"))).select("a", "b")
    # lists of sketch values: every text with the hubs of its lists
    rows = common.stored(_listed(classes, sketch))
    entries = rows.select("key", "rank", F.explode("prefix").alias("value"))
    near = texts.overlaps(common.stored(_estimated(_star(entries, _hubs(entries)), classes, sketch)))
    # what is left, by the rarest values of whole sets: with the hubs of these lists, then with each other
    left = common.stored(_left(rows, connected_components(links(near)), texts))
    entries = left.select("key", "rank", F.explode("prefix").alias("value"))
    hubs = _hubs(entries)
    shared = common.stored(near.unionByName(texts.overlaps(common.stored(_star(entries, hubs).join(near, ["a", "b"], "left_anti")))))
    met = _met(left, hubs, shared, connected_components(links(shared)))
    return links(shared.unionByName(texts.overlaps(common.stored(_estimated(met, classes, sketch)))))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, sketch: int | None = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text; others are not looked at).

    Words are lower-cased in A-Z; a text of fewer than ``words`` words is one shingle. Null and empty texts, and texts
    without a word, have 0 shingles, are linked with nothing and kept. Whole texts of any length count. Rows with one
    doc_id count as one document; exact copies share a component. A null doc_id is linked with nothing, has a null
    component_id and is kept. An empty table gives an empty table. ``sketch`` is the number of retained values, or None
    for all of them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = common.stored(texts.mapInArrow(_digest(words, sketch), "doc_id long, n_shingles long, key long, check long, sketch array<long>"))
    full = digests.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("key", "check").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    classes = common.stored(classes)
    links = _links(classes, _Texts(texts, classes, words), sketch)
    # an id with several texts joins their classes
    several = full.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("doc_id", "a")
    links = links.union(full.join(several, "doc_id").select("a", F.col("key").alias("b")))
    parts = classes.select("key", "node", "copies").join(connected_components(links).withColumnRenamed("node", "key"), "key", "left")
    # classes of one text that nothing is linked with need no look-up
    parts = common.stored(parts.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "key")))
    least = parts.groupBy("component").agg(F.min("node").alias("component_id"))
    found = parts.select("key", "component").join(least, "component").select("key", F.col("component_id").alias("found"))
    out = digests.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4)
