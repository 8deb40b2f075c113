"""The state of extraction runs, folded from their events: in one go over a table, or as a stream with state for each run.

Both give the same row. Frames that come late never turn the picture back; paths of swatches count once, the first value
stands; a start forgets what was before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from swatchwork.functions import csstext as T

#: Swatches and dimensions that a run shows at most.
SWATCHES, DIMENSIONS = 28, 12
#: type: start, idle, cache, permalink, stage, frame, token, summary, files, error. name: stage or token type; seq: of a frame.
EVENTS = "run long, place long, type string, name string, path string, value string, seq long"
RESULT = """run long, status string, cached boolean, hash string, stage string, stages string, frame_seq long, frame string, frames long,
    swatches string, font string, dimensions string, summary string, files string, error string"""
_FIELDS = [x.split()[0] for x in EVENTS.split(", ")]


def _number(text: Column) -> Column:
    return T.number(text)


def reduced(events: DataFrame) -> DataFrame:
    """One row for each run of ``events`` (EVENTS, in the order of place), see RESULT, by windows and sums alone.

    The number of a frame is a fold that windows can tell: a frame without a number goes one beyond the last, so that the
    last number is the largest of (own number, plus the frames without one after it). Lists are joined by commas.
    """
    rows = events.select(*_FIELDS)
    whole = Window.partitionBy("run")
    line = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begun", F.coalesce(F.max(F.when(F.col("type") == "start", F.col("place"))).over(whole), F.lit(-1)))
    rows = rows.where(F.col("place") >= F.col("begun"))
    is_ = lambda *names: F.col("type").isin(*names)
    # frames: each but those that turn back; without a number they count on
    unnumbered = F.sum(F.when(is_("frame") & F.col("seq").isNull(), 1).otherwise(0)).over(line)
    rows = rows.withColumn("unnumbered", unnumbered)
    rows = rows.withColumn("shown", F.col("unnumbered") + F.greatest(F.lit(-1), F.coalesce(F.max(F.when(is_("frame"), F.col("seq") - F.col("unnumbered"))).over(line), F.lit(-1))))
    newer = is_("frame") & (F.col("seq").isNull() | (F.col("seq") == F.col("shown")))
    token = is_("token") & F.col("value").isNotNull()
    swatch = token & (F.col("name") == "color") & F.col("value").startswith("#")
    dimension = token & (F.col("name") == "dimension") & _number(F.col("value")).isNotNull()
    rows = rows.withColumn("kind", F.when(swatch, "swatch").when(dimension, "dimension").when(is_("stage"), "stage"))
    same = F.when(F.col("kind") == "stage", F.col("name")).otherwise(F.col("path"))
    first = F.row_number().over(Window.partitionBy("run", "kind", same).orderBy("place"))
    rows = rows.withColumn("counts", F.col("kind").isNotNull() & ((F.col("kind") == "dimension") | (first == 1)))
    turn = F.sum(F.col("counts").cast("int")).over(Window.partitionBy("run", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("counts", F.col("counts") & F.when(F.col("kind") == "swatch", turn <= SWATCHES).when(F.col("kind") == "dimension", turn <= DIMENSIONS).otherwise(True))
    last = lambda which, value: F.max_by(value, F.when(which, F.col("place")))
    listed = lambda kind, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("counts") & (F.col("kind") == kind), F.struct("place", value.alias("x"))))), lambda x: x["x"]), ",")
    said = F.concat_ws("=", F.coalesce("path", F.lit("")), "value")
    state = F.when(is_("start"), "streaming").when(is_("idle"), "idle").when(is_("files"), "done").when(is_("error"), "error")
    return rows.groupBy("run").agg(
        F.coalesce(last(state.isNotNull(), state), F.lit("idle")).alias("status"),
        F.coalesce(F.bool_or(is_("cache")), F.lit(False)).alias("cached"),
        last(is_("permalink") & (F.col("value") != ""), F.col("value")).alias("hash"),
        last(is_("stage"), F.col("name")).alias("stage"),
        listed("stage", F.coalesce("name", F.lit(""))).alias("stages"),
        last(newer, F.col("shown")).alias("frame_seq"),
        last(newer, F.coalesce("value", F.lit(""))).alias("frame"),
        F.sum(F.when(is_("frame"), 1).otherwise(0)).alias("frames"),
        listed("swatch", said).alias("swatches"),
        F.min_by("value", F.when(token & (F.col("name") == "fontFamily") & (F.col("value") != ""), F.col("place"))).alias("font"),
        listed("dimension", said).alias("dimensions"),
        last(is_("summary"), F.col("value")).alias("summary"),
        last(is_("files"), F.col("value")).alias("files"),
        last(is_("error"), F.coalesce("value", F.lit("Extraction failed"))).alias("error"),
    )


FRESH = {"status": "idle", "cached": False, "hash": None, "stage": None, "stages": [], "frame_seq": None, "frame": None, "frames": 0, "swatches": [], "paths": [], "font": None, "dimensions": [], "summary": None, "files": None, "error": None, "place": -1}


def _leading_number(text: str) -> bool:
    import re

    return bool(re.match(r"[-+]?(?:\d+\.?\d*|\.\d+)", text.strip()))


def folded(state: dict[str, Any], e: dict[str, Any]) -> dict[str, Any]:
    """The state after one event; an event not after the last one folded is a repeated delivery and changes nothing."""
    if e["place"] <= state["place"]:
        return state
    kind, value, path = e["type"], e["value"], e["path"]
    if kind == "start":
        return FRESH | {"stages": [], "swatches": [], "paths": [], "dimensions": [], "status": "streaming", "place": e["place"]}
    state = state | {"place": e["place"]}
    if kind == "idle":
        state["status"] = "idle"
    elif kind == "cache":
        state["cached"] = True
    elif kind == "permalink":
        state["hash"] = value or state["hash"]
    elif kind == "stage":
        state["stage"] = e["name"]
        if (e["name"] or "") not in state["stages"]:
            state["stages"] = [*state["stages"], e["name"] or ""]
    elif kind == "frame":
        now = -1 if state["frame_seq"] is None else state["frame_seq"]
        seq = now + 1 if e["seq"] is None else e["seq"]
        if seq >= now:
            state["frame_seq"], state["frame"] = seq, value or ""
        state["frames"] += 1
    elif kind == "token" and value is not None:
        if e["name"] == "color" and value.startswith("#"):
            if len(state["swatches"]) < SWATCHES and path not in state["paths"]:
                state["paths"] = [*state["paths"], path]
                state["swatches"] = [*state["swatches"], f"{path or ''}={value}"]
        elif e["name"] == "fontFamily":
            state["font"] = state["font"] or value or None
        elif e["name"] == "dimension" and _leading_number(value) and len(state["dimensions"]) < DIMENSIONS:
            state["dimensions"] = [*state["dimensions"], f"{path or ''}={value}"]
    elif kind == "summary":
        state["summary"] = value
    elif kind == "files":
        state["files"], state["status"] = value, "done"
    elif kind == "error":
        state["error"], state["status"] = "Extraction failed" if value is None else value, "error"
    return state


def _row(run: int, state: dict[str, Any]) -> Row:
    lists = {k: ",".join(state[k]) for k in ("stages", "swatches", "dimensions")}
    return Row(run=run, **{k: v for k, v in (state | lists).items() if k not in ("paths", "place")}, place=state["place"])


class _Reducer(StatefulProcessor):
    """Keeps the state of a run as one value with a time to live."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("run", "state string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = self.kept.get() if self.kept.exists() else None
        state = json.loads(before[0]) if before else dict(FRESH)
        for e in sorted((r.asDict() for r in rows), key=lambda x: x["place"]):
            state = folded(state, e)
        self.kept.update((json.dumps(state),))
        yield _row(key[0], state)

    def close(self) -> None:
        pass


def reduced_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The same for a stream: each time that a run gets events, its row again, with the place of the last event folded.

    Events of a run may be delivered again, but must not overtake each other from one batch to the next. A run that gets
    nothing for ``ttl_ms`` is forgotten (None: never). The session must use the RocksDB state store; see ``with_rocksdb``.
    """
    schema = StructType.fromDDL(RESULT + ", place long")
    return events.select(*_FIELDS).groupBy("run").transformWithState(statefulProcessor=_Reducer(ttl_ms), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def latest(told: DataFrame) -> DataFrame:
    """The last row of each run out of all that ``reduced_stream`` has told."""
    return told.groupBy("run").agg(F.max_by(F.struct(*told.columns), "place").alias("r")).select("r.*").drop("place")


class with_rocksdb:  # noqa: N801
    """Streams that begin inside keep their state in RocksDB; the session's setting is put back after."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_: object) -> None:
        self.spark.conf.unset(self.NAME) if self.before is None else self.spark.conf.set(self.NAME, self.before)
