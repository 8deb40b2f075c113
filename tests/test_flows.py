"""Streams give what the tables give: rows late, repeated and in any order, and a restart in the middle."""

import random

import pytest

from swatchwork.streaming import observations, runs, watch

OBSERVED = observations.COLUMNS + ", observation_id long, ts timestamp"
r = random.Random(7)


def seen(n, pages=6):
    import datetime

    begin = datetime.datetime(2024, 1, 1)
    for k in range(n):
        yield (r.randrange(pages), k, r.choice(["load", "scroll", "scroll", "hover", "focus", None]), f".s{r.randrange(4)}", r.choice(["fade", "spin", None]), r.choice([None, 0.5, 1.0]), r.choice(["opacity", "top", None]), r.choice([None, *range(12)]), k, begin + datetime.timedelta(minutes=k))


def by_hand(rows, limit):
    out = {}
    for page in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == page), key=lambda x: ({"load": 0, "scroll": 1}.get(x[2], 2), x[1]))
        loads = {x[7] for x in own if x[2] == "load"} - {None}
        kept, keys = [], set()
        for x in own:
            if x[2] == "scroll" and x[7] in loads or x[2:7] in keys or len(kept) >= limit:
                continue
            keys.add(x[2:7])
            kept.append(x)
        out |= {(page, k + 1): (x[1], x[2] or "", *x[3:8]) for k, x in enumerate(kept)}
    return out


@pytest.mark.parametrize("limit", [200, 9])
def test_observations(spark, tmp_path, limit):
    rows = [*seen(400)]
    told = lambda frame: {(x.page_id, x.rank): tuple(x)[2:] for x in frame.collect()}
    frame = spark.createDataFrame(rows, OBSERVED)
    want = by_hand(rows, limit)
    assert told(observations.merged(frame, limit)) == want and len(want) > 40
    parts = sorted(rows, key=lambda _: r.random())  # in any order
    for k in range(4):
        again = r.sample(parts[: k * 100], 30) if k else []  # some are delivered again
        spark.createDataFrame(parts[k * 100 : k * 100 + 100] + again, OBSERVED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # the watermark lies a year back, as late rows count here
    out = watch.told(observations.merged_stream(stream, "365 days", limit), "o", f"{tmp_path}/out")
    assert told(observations.latest(out)) == want


def events(n, some=5):
    for k in range(n):
        kind = r.choice(["start"] + ["frame"] * 12 + ["token"] * 20 + ["stage"] * 4 + ["cache", "permalink", "summary", "files", "error", "idle", "odd"]) if k > 60 else r.choice(["frame", "token", "stage"])
        name = r.choice(["color", "color", "dimension", "fontFamily", "other"]) if kind == "token" else r.choice(["a", "b", "c", None])
        value = r.choice(["#fff", "#00f", "12px", "1.5rem", "auto", "", None, "Inter"])
        yield (r.randrange(some), k, kind, name, r.choice(["p1", "p2", "p3", None, f"q{k}"]), value, r.choice([None, -3, 0, *range(20)]))


def state_of(rows):
    out = {}
    for x in sorted(rows, key=lambda x: x[1]):
        out[x[0]] = runs.folded(out.get(x[0], dict(runs.FRESH)), dict(zip(runs._FIELDS, x, strict=True)))
    return {k: tuple(runs._row(k, v))[:-1] for k, v in out.items()}


@pytest.fixture(scope="module")
def happened():
    return [*events(1500), *((9, 10_000 + k, "token", "color", f"c{k}", "#abc", None) for k in range(40)), *((9, 20_000 + k, "token", "dimension", "d", f"{k}px", None) for k in range(20))]


def test_states(spark, happened):
    frame = spark.createDataFrame(happened, runs.EVENTS).repartition(5)
    got = {x.run: tuple(x) for x in runs.reduced(frame).collect()}
    assert got == state_of(happened)
    assert got[9][9].count(",") == runs.SWATCHES - 1 and got[9][11].count(",") == runs.DIMENSIONS - 1
    assert runs.reduced(frame.limit(0)).count() == 0


def test_facts():
    def told(*given):
        state = dict(runs.FRESH)
        for k, e in enumerate(given):
            state = runs.folded(state, {"place": k, "name": None, "path": None, "value": None, "seq": None} | e)
        return state

    frame = lambda seq, value: {"type": "frame", "seq": seq, "value": value}
    state = told({"type": "start"}, frame(3, "c"), frame(1, "a"), frame(3, "d"), frame(None, "e"), frame(2, "b"))
    assert (state["frame_seq"], state["frame"], state["frames"], state["status"]) == (4, "e", 5, "streaming")
    state = told({"type": "token", "name": "color", "path": "x", "value": "#111"}, {"type": "token", "name": "color", "path": "x", "value": "#222"}, {"type": "token", "name": "color", "path": "y", "value": "red"}, {"type": "error"})
    assert state["swatches"] == ["x=#111"] and state["status"] == "error" and state["error"] == "Extraction failed"
    assert told({"type": "files", "value": "f"}, {"type": "start"})["files"] is None


def test_restart_in_the_middle(spark, tmp_path, happened):
    rows = sorted(happened, key=lambda x: x[1])
    schema = spark.createDataFrame(rows[:1], runs.EVENTS).schema
    cuts = [0, 300, 700, 701, 1200, len(rows)]
    parts = [rows[a:b] + (rows[max(0, a - 50) : a] if a else []) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # the last ones are delivered again

    def add(part):
        spark.createDataFrame(part, runs.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        with runs.with_rocksdb(spark):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            return runs.latest(watch.told(runs.reduced_stream(stream), "r", f"{tmp_path}/out"))

    add(parts[0])
    add(parts[1])
    first = {x.run: tuple(x) for x in run().collect()}
    assert first == state_of(rows[:700])
    for part in parts[2:]:
        add(part)
    assert {x.run: tuple(x) for x in run().collect()} == state_of(rows) != first
    assert "RocksDB" not in (spark.conf.get(runs.with_rocksdb.NAME, "") or "")


def test_forgotten_runs(spark, tmp_path):
    """A run that gets nothing for its time to live begins anew."""
    import os
    import time

    def add(place, kind):
        frame = spark.createDataFrame([(1, place, kind, "s", None, None, None)], runs.EVENTS)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return frame.schema

    def told(n):
        for _ in range(90):
            parts = [x for x in os.listdir(f"{tmp_path}/out") if x.startswith("batch")] if os.path.isdir(f"{tmp_path}/out") else []
            rows = [x for p in sorted(parts, key=lambda x: int(x.split("=")[1])) if os.path.exists(f"{tmp_path}/out/{p}/_SUCCESS") for x in spark.read.parquet(f"{tmp_path}/out/{p}").collect()]
            if len(rows) >= n:
                return rows
            time.sleep(0.5)
        raise AssertionError("nothing told")

    schema = add(1, "cache")
    with runs.with_rocksdb(spark):
        stream = runs.reduced_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=2000)
        query = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(processingTime="1 second").start()
        try:
            assert told(1)[0].cached
            time.sleep(4)
            add(2, "stage")
            last = told(2)[-1]
            assert last.stage == "s" and not last.cached
        finally:
            query.stop()
