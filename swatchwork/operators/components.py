"""Components of pages: variants by the likeness of their styles, and the anatomy of each kind by variant, state and size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Cosine from which two styles are one variant.
ALIKE = 0.95
CANDIDATE = "page_id long, ord long, kind string, structural_hash string, style_vector array<double>, variant_hint string, size_hint string, disabled boolean, css string, text string, slots array<string>"


KEYS = ["page_id", "kind", "structural_hash"]


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; the first row's do."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in KEYS:
        one, next_ = batch.column(name)[:-1], batch.column(name)[1:]
        new[1:] |= pc.if_else(pc.or_(pc.is_null(one), pc.is_null(next_)), pc.xor(pc.is_null(one), pc.is_null(next_)), pc.fill_null(pc.not_equal(one, next_), False)).to_numpy(zero_copy_only=False)
    return new


def _styles(lists: pa.ListArray) -> np.ndarray:
    """A row of numbers for each list; a part that is missing counts as 0, as it adds nothing to a product."""
    long = lists.value_lengths().to_numpy()
    edge = np.cumsum(long) - long
    styles = np.zeros((len(lists), int(long.max(initial=0))))
    at = np.repeat(np.arange(len(lists)), long)
    styles[at, np.arange(len(at)) - edge[at]] = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
    return styles


def _clusters(batch: pa.RecordBatch, alike: float) -> pa.RecordBatch:
    """The variants of whole groups, whose rows stand together and in order: all groups take their next example in one round."""
    group = np.cumsum(_starts(batch))
    styles = _styles(batch.column("v"))
    size = np.sqrt((styles**2).sum(1))
    unit = np.divide(styles, size[:, None], out=np.zeros_like(styles), where=size[:, None] > 0)
    number, members = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
    free, turn = np.arange(len(group)), 0
    while len(free):  # what no earlier example has taken; the first of a group is its next example
        leads = np.ones(len(free), bool)
        leads[1:] = group[free[1:]] != group[free[:-1]]
        own = free[leads][np.cumsum(leads) - 1]
        like = np.where((size[own] == 0) & (size[free] == 0), 1.0, np.einsum("ij,ij->i", unit[own], unit[free]))
        hit = leads | (np.round(like, 9) >= alike)
        number[free[leads]] = turn
        members += np.bincount(own[hit], minlength=len(group))
        free, turn = free[~hit], turn + 1
    first = np.flatnonzero(members)
    rows = batch.take(pa.array(first))
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in KEYS), pa.array(number[first]), rows.column("ord"), pa.array(members[first])], names=[*KEYS, "variant", "example_ord", "members"])


def _fold(alike: float):
    """From rows sorted by keys and order; a group may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(_starts(batch))[-1])
            if held and (last or _starts(pa.concat_batches([held[-1][-1:], batch[:1]]))[1]):
                yield _clusters(pa.concat_batches([*held, batch[:last]]), alike)
                held = [batch[last:]]
            elif last:
                yield _clusters(batch[:last], alike)
                held = [batch[last:]]
            else:
                held.append(batch)
        if held:
            yield _clusters(pa.concat_batches(held), alike)

    return run


def variants(candidates: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(page_id, kind, structural_hash, variant, example_ord, members): greedy clusters of the candidates of one page, kind and structure.

    In document order each joins the first variant whose example has a cosine of ``alike`` or more (nine decimals), or
    becomes an example; styles of zeros are like each other. A group is what one page has of one structure. A null style
    counts as one of zeros, null kinds and structures are groups of their own.
    """
    rows = candidates.select(*KEYS, F.col("ord").cast("long").alias("ord"), F.coalesce("style_vector", F.array().cast("array<double>")).alias("v"))
    # rows pass by in order, so that no group is gathered in the aggregate
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "ord", "v")
    schema = S.StructType([*(rows.schema[c] for c in KEYS), *S.StructType.fromDDL("variant int, example_ord long, members long").fields])
    return rows.mapInArrow(_fold(alike), schema)


def anatomies(candidates: DataFrame) -> DataFrame:
    """One row for each kind that a page has twice or more: instances, slots, its most frequent slot shape, variants and props.

    ``variants`` is an array of (name, count, default and disabled with count and css of the first, sizes with count and
    css of the first, sample texts), the most frequent first, then as they first stand; sizes as they first stand. A shape
    is the roles of the slots in order; the most frequent counts, the first of equals. ``slots`` says what the first
    instance of a button, card or input has. A null kind is "other", a null hint "default", null slots are none.
    """
    rows = candidates.select(
        "page_id", "ord", F.coalesce(F.nullif("kind", F.lit("")), F.lit("other")).alias("kind"), F.nullif("variant_hint", F.lit("")).alias("variant_hint"), F.nullif("size_hint", F.lit("")).alias("size_hint"), F.coalesce("disabled", F.lit(False)).alias("disabled"), "css", "text",
        F.coalesce("slots", F.array().cast("array<string>")).alias("slots"),
    )
    rows = rows.withColumn("variant", F.coalesce("variant_hint", F.lit("default"))).withColumn("size", F.coalesce("size_hint", F.lit("default")))
    of = ["page_id", "kind"]
    first = lambda value, when=None: F.min(F.when(when, F.struct("ord", value)) if when is not None else F.struct("ord", value))
    sizes = rows.groupBy(*of, "variant", "size").agg(F.count("*").alias("n"), first(F.col("css").alias("css")).alias("f"))
    sizes = sizes.groupBy(*of, "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("f.ord", "size", "n", "f.css"))), lambda x: F.struct(x["size"].alias("name"), x["n"].alias("count"), x["css"].alias("css"))).alias("sizes"))
    css = F.col("css").alias("css")
    each = rows.groupBy(*of, "variant").agg(
        F.count("*").alias("count"), F.min("ord").alias("first"), F.count(F.when(F.col("disabled"), 1)).alias("off"), first(css, ~F.col("disabled"))["css"].alias("on_css"), first(css, F.col("disabled"))["css"].alias("off_css"),
        F.filter(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), 1, 5), lambda x: x["text"]), lambda x: x != "").alias("samples"),
    )
    state = lambda n, shown: F.struct(n.alias("count"), F.col(shown).alias("css"))
    one = F.struct((-F.col("count")).alias("less"), "first", F.struct(F.col("variant").alias("name"), "count", F.struct(state(F.col("count") - F.col("off"), "on_css").alias("default"), state(F.col("off"), "off_css").alias("disabled")).alias("states"), "sizes", F.col("samples").alias("sample_text")).alias("v"))
    found = each.join(sizes, [*of, "variant"]).groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).alias("variants"))
    shape = F.concat_ws(">", "slots")
    shapes = rows.groupBy(*of, shape.alias("shape")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).groupBy(*of).agg(F.max(F.struct("n", (-F.col("first")).alias("back"), "shape"))["shape"].alias("slot_shape"))
    hints = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("first", c))), lambda x: x[c])
    props = [rows.where(f"{c} is not null").groupBy(*of, c).agg(F.min("ord").alias("first")).groupBy(*of).agg(hints(c).alias(f"{c}s")) for c in ("variant_hint", "size_hint")]
    whole = rows.groupBy(*of).agg(F.count("*").alias("instances"), first(F.col("slots").alias("slots"))["slots"].alias("own"), F.bool_or("disabled").alias("disabled")).where("instances >= 2")
    has = lambda role: F.array_contains("own", role)
    slots = (
        F.when(F.col("kind") == "button", F.create_map(F.lit("label"), F.lit(True), F.lit("icon"), has("icon"), F.lit("badge"), has("badge")))
        .when(F.col("kind") == "card", F.create_map(F.lit("heading"), has("heading"), F.lit("description"), has("text"), F.lit("media"), has("icon"), F.lit("footer"), F.size("own") > 3))
        .when(F.col("kind") == "input", F.create_map(F.lit("leading"), has("icon"), F.lit("trailing"), F.lit(False)))
        .otherwise(F.create_map().cast("map<string,boolean>"))
    )
    none = F.array().cast("array<string>")
    whole = whole.join(found, of).join(shapes, of).join(props[0], of, "left").join(props[1], of, "left")
    return whole.select(*of, "instances", slots.alias("slots"), "slot_shape", "variants", F.struct(F.coalesce(F.array_remove("variant_hints", "default"), none).alias("variant"), F.coalesce("size_hints", none).alias("size"), "disabled").alias("props"))
