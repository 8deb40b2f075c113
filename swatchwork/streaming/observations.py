"""Observations of motion, merged by page: what plays at load comes first, then what scrolling and then what hovering starts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swatchwork.operators.usage import first_per_key

#: Observations of a page at most, a limit of the merged list.
LIMIT = 200
#: The turn of each trigger; any other comes with hovering.
TURNS = {"load": 0, "scroll": 1}
COLUMNS = "page_id long, ord long, trigger string, selector string, name string, duration double, properties string, instance_id long"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _turn() -> Column:
    return F.coalesce(*(F.when(F.col("trigger") == name, turn) for name, turn in TURNS.items()), F.lit(2))


def _named(observations: DataFrame) -> DataFrame:
    return observations.select(*(F.coalesce("trigger", F.lit("")).alias(c) if c == "trigger" else c for c in _NAMES))


def merged(observations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Observations (see COLUMNS) with their rank: one of each trigger, selector, name, duration and properties of a page.

    A scroll observation goes if its instance was seen at load, as it still plays then; one without an instance stays. The
    first of equal ones counts, in the order of turns and then of ``ord``. A page keeps the first ``limit``. A null trigger counts as an empty one.
    """
    rows = _named(observations)
    loaded = rows.where("trigger = 'load' and instance_id is not null").select("page_id", "instance_id").distinct().withColumn("trigger", F.lit("scroll"))
    rows = rows.join(loaded, ["page_id", "instance_id", "trigger"], "left_anti").withColumn("turn", _turn())
    key = ["page_id", "trigger", "selector", "name", "duration", "properties"]
    rows = first_per_key(rows, key, F.asc("turn"), F.asc("ord"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("turn", "ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "rank", *_NAMES[1:])


STATE = "ords array<long>, triggers array<string>, selectors array<string>, names array<string>, durations array<double>, properties array<string>, instances array<long>, version long"
_KEPT = ("ord", "trigger", "selector", "name", "duration", "properties", "instance_id")


def _merge(limit: int):
    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Folds new rows into what is known of the page and tells its whole list again. One row is kept of each key and instance, the earliest."""
        *lists, version = state.get if state.exists else (*([] for _ in _KEPT), 0)
        known: dict[tuple, tuple] = {}

        def add(row: tuple) -> None:
            # a scroll row may have to give way to an equal one of another instance, so that instances are kept apart
            own = (*row[1:6], row[6] if row[1] == "scroll" else None)
            if own not in known or row[0] < known[own][0]:
                known[own] = row

        loads = set()
        for row in zip(*lists, strict=True):
            if row[1] is None:
                loads.add(row[6])
            else:
                add(tuple(row))
        for batch in batches:
            for row in batch[list(_KEPT)].astype(object).where(batch[list(_KEPT)].notna(), None).itertuples(index=False):
                row = (int(row[0]), *row[1:4], None if row[4] is None else float(row[4]), row[5], None if row[6] is None else int(row[6]))
                if row[1] == "load" and row[6] is not None:
                    loads.add(row[6])
                add(row)
        # instances seen at load are kept as rows of their own: an observation always has a trigger
        marks = [(0, None, None, None, None, None, k) for k in sorted(loads)]
        state.update((*(list(c) for c in zip(*known.values(), *marks, strict=True)), version + 1))
        left = sorted((r for r in known.values() if not (r[1] == "scroll" and r[6] in loads)), key=lambda r: (TURNS.get(r[1], 2), r[0]))
        out, seen = [], set()
        for r in left:
            if r[1:6] not in seen and len(out) < limit:
                seen.add(r[1:6])
                out.append((key[0], version + 1, len(out) + 1, *r))
        # a page from which nothing is left tells so, or an older list would stand
        yield pd.DataFrame(out or [(key[0], version + 1, 0, *(None for _ in _KEPT))], columns=["page_id", "version", "rank", *_KEPT])

    return merge


def merged_stream(observations: DataFrame, late: str = "1 hour", limit: int = LIMIT) -> DataFrame:
    """The same for a stream of observations (COLUMNS, and observation_id and ts): each time that a page changes, its whole list again, with a version.

    Observations delivered again with the same id within the watermark are dropped before they reach the state; later ones
    change nothing, as the fold keeps the earliest row of a key. Rows may come in any order and however late: a scroll row
    waits in the state, since the load row that rules it out may follow. State: one row for each key of a page, and the
    instances seen at load.
    """
    rows = observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["page_id", "observation_id"])
    told = "page_id long, version long, rank int, ord long, trigger string, selector string, name string, duration double, properties string, instance_id long"
    return _named(rows).groupBy("page_id").applyInPandasWithState(_merge(limit), told, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(told: DataFrame) -> DataFrame:
    """The last list of each page out of all that ``merged_stream`` has told."""
    last = told.groupBy("page_id").agg(F.max("version").alias("version"))
    return told.join(last, ["page_id", "version"]).where("rank > 0").select("page_id", "rank", *_NAMES[1:])
