"""Vectors with missing parts: normalising, nearest neighbours, percentiles, outliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatchwork.operators.usage import top


def normalise(value: Column, low: float, high: float) -> Column:
    """Into 0 to 1 between two bounds, clamped; null stays null."""
    # greatest and least pass over nulls
    return F.when(value.isNotNull(), F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference over the features that both have; null if there are none."""
    d = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda x: x.isNotNull())
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(d), F.lit(0))


#: Queries and rows that are compared at once, so that their differences stay in a core's cache.
_QUERIES, _ROWS = 64, 1024
_MILLION = 1e6
#: Places of what is infinite and of what is no number, behind all others.
_INFINITE, _NO_NUMBER = 1e300, 1e301


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of ``width`` (0 where nothing is), and where something is."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    flat = column.flatten()
    there, values = np.asarray(flat.is_valid()), flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    place = np.arange(len(flat)) - ends[row]
    keep = place < width
    out, has = np.zeros((len(column), width)), np.zeros((len(column), width), bool)
    out[row[keep], place[keep]], has[row[keep], place[keep]] = values[keep], there[keep]
    return out, has


def _apart(q: np.ndarray, q_has: np.ndarray, x: np.ndarray, x_has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distance`` of every q to every x, summed in the same order, and whether both have a feature."""
    total, step = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    whole = q_has.all() and x_has.all()
    for j in range(q.shape[1]):
        np.subtract(q[:, j, None], x[None, :, j], out=step)
        np.abs(step, out=step)
        total += step if whole else np.where(q_has[:, j, None] & x_has[None, :, j], step, 0.0)
    n = np.full(total.shape, float(q.shape[1])) if whole else q_has.astype(float) @ x_has.T.astype(float)
    return np.divide(total, n, out=np.zeros_like(total), where=n > 0), n > 0


def _millionths(d: np.ndarray) -> np.ndarray:
    """Distances in whole millionths, halves up by their decimal digits, as ``round`` does."""
    x = d * _MILLION
    out = np.floor(x + 0.5)
    for k in np.flatnonzero(np.isfinite(x) & (np.abs(x - np.floor(x) - 0.5) < 1e-4)):
        out[k] = float(Decimal(repr(float(d[k]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(d), _NO_NUMBER, np.where(np.isinf(d), _INFINITE, out))


def _keep(far: np.ndarray, near: np.ndarray, query: np.ndarray, r: np.ndarray, who: np.ndarray) -> None:
    """Takes rows ``who`` at ``r`` millionths of the queries at places ``query`` into the nearest ones known, if they are."""
    k = far.shape[1]
    hit = np.unique(query)
    query, r, who = np.concatenate([query, np.repeat(hit, k)]), np.concatenate([r, far[hit].ravel()]), np.concatenate([who, near[hit].ravel()])
    order = np.lexsort((who, r, query))
    query, r, who = query[order], r[order], who[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    first = rank < k
    far[query[first], rank[first]], near[query[first], rank[first]] = r[first], who[first]


def _found(ids: np.ndarray, far: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    m, n = np.nonzero(far < np.inf)
    r = far[m, n]
    value = np.where(r == _NO_NUMBER, np.nan, np.where(r == _INFINITE, np.inf, r / _MILLION))
    return pa.RecordBatch.from_arrays([pa.array(ids[m], pa.int64()), pa.array(near[m, n], pa.int64()), pa.array(value, pa.float64())], names=["query_id", "id", "distance"])


def _best(ids: np.ndarray, q: np.ndarray, q_has: np.ndarray, k: int):
    """The k nearest rows of a partition for each query, by millionths, then by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            own = batch.column("id").to_numpy(zero_copy_only=False)
            x, x_has = _matrix(batch.column("vector"), q.shape[1])
            for lo in range(0, len(own), _ROWS):
                for at in range(0, len(ids), _QUERIES):
                    rows, these = slice(lo, lo + _ROWS), slice(at, at + _QUERIES)
                    d, met = _apart(q[these], q_has[these], x[rows], x_has[rows])
                    last = far[these, -1:]
                    # within a millionth of the last one, or no number while a place is free
                    m, n = np.nonzero(met & ((d * _MILLION <= last + 1) | (~np.isfinite(d) & (last >= _INFINITE))))
                    r, who, query = _millionths(d[m, n]), own[lo + n], at + m
                    better = (who != ids[query]) & ((r < far[query, -1]) | ((r == far[query, -1]) & (who < near[query, -1])))
                    _keep(far, near, query[better], r[better], who[better])
        yield _found(ids, far, near)

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, block: int = 20_000) -> DataFrame:
    """The k nearest rows of ``corpus`` (id long, vector) for each of a stated set of ``queries`` (id, vector), itself left out.

    The corpus stays where it is; queries go to it in blocks of bounded size, are compared by matrices, and each
    partition's best meet in a top-k. All pairs are compared, so that work grows with the product of both.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    found = None
    corpus = corpus.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).where("id is not null and vector is not null")
        part = part.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
        lists = pa.concat_arrays(part.column("vector").chunks) if part.num_rows else pa.array([], pa.list_(pa.float64()))
        q, q_has = _matrix(lists, max(np.asarray(lists.value_lengths()), default=0))
        pairs = corpus.mapInArrow(_best(part.column("id").to_numpy(), q, q_has, k), "query_id long, id long, distance double")
        found = pairs if found is None else found.union(pairs)
    return top(found, ["query_id"], k, F.asc("distance"), F.asc("id"))


#: Rows that meet at once, and those of them whose steps stay in a core's cache.
_TILE, _STRIP = 1024, 64
#: Whole steps that the features of a row add up to at most, so that two such sums fit into 16 bits.
_STEPS = 32767
#: Pairs that are measured at once.
_PAIRS = 1 << 14


@dataclass
class _Block:
    """Rows of a block, first those that have every feature as a finite number, and the nearest ones known of each."""

    ids: np.ndarray
    x: np.ndarray
    has: np.ndarray
    k: int
    whole: int = field(init=False)
    far: np.ndarray = field(init=False)
    near: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        part = ~(self.has.all(axis=1) & np.isfinite(self.x).all(axis=1))
        order = np.argsort(part, kind="stable")
        self.ids, self.x, self.has, self.whole = self.ids[order], self.x[order], self.has[order], len(part) - int(part.sum())
        self.far, self.near = np.full((len(part), self.k), np.inf), np.zeros((len(part), self.k), np.int64)

    def scaled(self, low: float, step: float, most: int) -> None:
        """Features in whole steps (a row for each feature), their sum, and what was rounded off at most, in steps."""
        x = (self.x[: self.whole] - low) / step
        q = np.clip(np.rint(x), 0, most)
        self.steps, self.sum = np.ascontiguousarray(q.T.astype(np.uint16)), q.sum(axis=1)
        self.off = np.abs(x - q).sum(axis=1) * (1 + 1e-9) + 1e-6


def _scale(blocks: list[_Block]) -> tuple[float, float, int] | None:
    """The lowest value, the step and the number of steps that all blocks are scaled by; None if their features are too many or too far apart."""
    x = np.concatenate([b.x[: b.whole].ravel() for b in blocks])
    most = _STEPS // max(1, blocks[0].x.shape[1])
    if not len(x) or most < 8:
        return None
    low, high = np.percentile(x, [0.05, 99.95])  # what lies outside is rounded off more
    if high == low:
        low, high = x.min(), x.max()
    with np.errstate(over="ignore"):
        step = (high - low) / most or 1.0
        return (low, step, most) if np.isfinite(np.abs(x - low).max() / step * x.size) else None


def _larger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the larger steps of every row of a with every row of b: |x - y| is 2 max(x, y) - x - y."""
    b = np.ascontiguousarray(b)
    out = np.zeros((a.shape[1], b.shape[1]), np.uint16)
    step = np.empty((_STRIP, b.shape[1]), np.uint16)
    for lo in range(0, len(out), _STRIP):
        total = out[lo : lo + _STRIP]
        for x, y in zip(a[:, lo : lo + _STRIP, None], b, strict=True):
            np.add(total, np.maximum(x, y, out=step[: len(total)]), out=total)
    return out


def _limits(a: _Block, rows: slice, b: _Block, these: slice, larger: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts of rows of a and of b; ``larger`` does not pass their sum where one of b can be among the k nearest ones of one of a: by the k-th one known or, where none is, by the k-th of these at their farthest."""
    last = (a.far[rows, -1] + 1) / unit
    new = np.flatnonzero(np.isinf(last))
    if len(new) and larger.shape[1] >= a.k:
        most = 2.0 * larger[new] - (b.sum[these] - b.off[these])
        most[a.ids[rows][new, None] == b.ids[these]] = np.inf
        last[new] = np.partition(most, a.k - 1, axis=1)[:, a.k - 1] - a.sum[rows][new] + a.off[rows][new] + 1 / unit
    u = np.ceil((last * (1 + 1e-9) + a.off[rows] + a.sum[rows]) / 2 + 1).clip(0, _STEPS)
    v = np.ceil((b.off[these] + b.sum[these]) / 2).clip(0, _STEPS)
    return u.astype(np.uint16), v.astype(np.uint16)


def _measured(a: _Block, m: np.ndarray, b: _Block, n: np.ndarray) -> np.ndarray:
    """``distance`` of pairs of whole rows, summed in the same order."""
    out = np.zeros(len(m))
    for lo in range(0, len(m), _PAIRS):
        step = np.ascontiguousarray(np.abs(a.x[m[lo : lo + _PAIRS]] - b.x[n[lo : lo + _PAIRS]]).T)
        for x in step:
            out[lo : lo + _PAIRS] += x
    return out / a.x.shape[1]


def _meet(a: _Block, b: _Block) -> None:
    """Every pair of a row of a and one of b, or of two rows of a if b is a, for the nearest ones of both."""
    scale = _scale([a, b])
    for block in (a, b) if scale else ():
        block.scaled(*scale)
    for lo in range(0, len(a.ids), _TILE):
        for at in range(lo if a is b else 0, len(b.ids), _TILE):
            rows, these, both = slice(lo, min(lo + _TILE, len(a.ids))), slice(at, min(at + _TILE, len(b.ids))), a is not b or lo != at
            if scale and rows.stop <= a.whole and these.stop <= b.whole:
                larger = _larger(a.steps[:, rows], b.steps[:, these])
                unit = scale[1] * _MILLION / a.x.shape[1]
                u, v = _limits(a, rows, b, these, larger, unit)
                limit = u[:, None] + v
                if both:
                    u, v = _limits(b, these, a, rows, larger.T, unit)
                    np.maximum(limit, v[:, None] + u, out=limit)
                m, n = np.divmod(np.flatnonzero(larger <= limit), larger.shape[1])
                m, n = m + lo, n + at
                m, n = (x[a.ids[m] != b.ids[n]] for x in (m, n))
                _take(a, m, b, n, _measured(a, m, b, n), both)
                continue
            for on in range(lo, rows.stop, _QUERIES):
                some = slice(on, min(on + _QUERIES, rows.stop))
                d, met = _apart(a.x[some], a.has[some], b.x[these], b.has[these])
                last = np.maximum(a.far[some, -1:], b.far[these, -1]) if both else a.far[some, -1:]
                m, n = np.nonzero(met & ((d * _MILLION <= last + 1) | (~np.isfinite(d) & (last >= _INFINITE))) & (a.ids[some, None] != b.ids[these]))
                _take(a, m + on, b, n + at, d[m, n], both)


def _take(a: _Block, m: np.ndarray, b: _Block, n: np.ndarray, d: np.ndarray, both: bool) -> None:
    r = _millionths(d)
    for x, query, y, other in ((a, m, b, n), (b, n, a, m))[: 1 + both]:
        who = y.ids[other]
        better = (r < x.far[query, -1]) | ((r == x.far[query, -1]) & (who < x.near[query, -1]))
        _keep(x.far, x.near, query[better], r[better], who[better])


def _cell(k: int) -> Callable[[pa.Table], pa.Table]:
    """The k nearest rows of another block for each row of a cell's two blocks, or of its own where the cell has one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = pa.concat_arrays(table.column("vector").chunks)
        x, has = _matrix(lists, max(np.asarray(lists.value_lengths()), default=0))
        ids, first = table.column("id").to_numpy(), table.column("first").to_numpy()
        blocks = [_Block(ids[at], x[at], has[at], k) for at in (first, ~first) if at.any()]
        one = table.column("a")[0] == table.column("b")[0]
        if one or len(blocks) == 2:
            _meet(blocks[0], blocks[-1])
        return pa.Table.from_batches([_found(b.ids, b.far, b.near) for b in blocks])

    return run


def neighbours(vectors: DataFrame, k: int = 5, size: int = 8192) -> DataFrame:
    """The k nearest others of every row of ``vectors`` (id, vector).

    Rows are dealt into blocks of about ``size`` by what they hold, eight at least. Each two blocks, and each with itself,
    meet in a cell, in which no more than two blocks are held; the best of a row's cells meet in a top-k. Every two
    rows meet once, in whole steps first, and are measured where those leave it open whether they are near; so results are
    exact, and work grows with the square of the rows, what is moved with rows times blocks.
    """
    blocks = max(8, -(-vectors.count() // size))
    rows = vectors.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = rows.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("first"), "id", "vector")
    pairs = cells.groupBy("a", "b").applyInArrow(_cell(k), "query_id long, id long, distance double")
    return top(pairs, ["query_id"], k, F.asc("distance"), F.asc("id"))


def long_form(vectors: DataFrame) -> DataFrame:
    """(id, feature, value) of what is there."""
    return vectors.select("id", F.posexplode("vector").alias("feature", "value")).where("value is not null")


def percentiles(vectors: DataFrame) -> DataFrame:
    """Mid-rank of each value among all of its feature: (smaller ones + half of the equal ones) / all, by sums over distinct values."""
    rows = long_form(vectors)
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("equal"))
    line = Window.partitionBy("feature").orderBy("value")
    below = F.sum("equal").over(line.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("n", F.sum("equal").over(Window.partitionBy("feature")))
    place = F.round((F.col("below") + F.col("equal") / 2) / F.col("n"), 6)
    return rows.join(counts.select("feature", "value", place.alias("percentile")), ["feature", "value"]).select("id", "feature", "percentile")


def outliers(ranks: DataFrame, n: int = 5) -> DataFrame:
    """The n features of each row that are farthest from the middle."""
    rows = ranks.withColumn("off", F.round(F.abs(F.col("percentile") - 0.5), 6))
    band = F.when(F.col("percentile") >= 0.9, "very high").when(F.col("percentile") >= 0.7, "high").when(F.col("percentile") >= 0.3, "typical").when(F.col("percentile") >= 0.1, "low").otherwise("very low")
    return top(rows.withColumn("band", band), ["id"], n, F.desc("off"), F.asc("feature"))
