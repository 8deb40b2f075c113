"""Short palettes out of many colours: weighted clusters in CIELAB, and tonal ramps in OKLCH."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from swatchwork.functions import colors as C
from swatchwork.functions import csstext as T

#: Rounds at most, and the sum of squared movements below which the centres stand still.
ROUNDS, STILL = 60, 0.5
#: Lightness of each step of a ramp, where chroma peaks and how it falls off, and its least share.
STEPS = {"50": 0.971, "100": 0.936, "200": 0.885, "300": 0.808, "400": 0.704, "500": 0.606, "600": 0.531, "700": 0.455, "800": 0.396, "900": 0.343, "950": 0.238}
PEAK, FALL, LEAST_CHROMA = 0.62, 1.6, 0.12


def _far(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The heaviest point, then k - 1 times the one whose distance to all chosen, times the logarithm of its weight, is largest; the first of equals."""
    bias = np.log1p(weight)
    chosen = [int(np.argmax(weight))]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(np.argmax(near * bias)))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _settled(points: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each point after the last round, and the centres; the first of equally near centres counts, an empty cluster's stays."""
    centres = _far(points, weight, k)
    for _ in range(ROUNDS):
        own = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), 1)
        total = np.bincount(own, weight, k)
        sums = np.stack([np.bincount(own, points[:, c] * weight, k) for c in range(3)], 1)
        moved = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres)
        step = ((moved - centres) ** 2).sum()
        centres = moved
        if step < STILL:
            break
    return own, centres


def _compress(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at, line in enumerate(batch.column("line")):
                rows = line.values
                points = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in ("l", "a", "b")], 1)
                weight = rows.field("uses").to_numpy().astype(np.float64)
                own, centres = _settled(points, weight, k) if len(points) > k else (np.arange(len(points)), points)
                off = np.round(((points - centres[own]) ** 2).sum(1), 9)  # two of equal weight are equally far but for rounding
                found = []
                for cluster in np.unique(own):
                    members = np.flatnonzero(own == cluster)
                    found.append((members[np.argmin(off[members])], weight[members].sum(), members))
                if len(points) > k:
                    found.sort(key=lambda x: -x[1])
                out += [(at, rank + 1, int(medoid), int(uses), [int(m) for m in members], rows) for rank, (medoid, uses, members) in enumerate(found)]
            name = lambda x, m: x[5].field("hex")[m].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int32()), pa.array([name(x, x[2]) for x in out], pa.string()), pa.array([x[3] for x in out], pa.int64()), pa.array([len(x[4]) for x in out], pa.int32()), pa.array([[name(x, m) for m in x[4]] for x in out], pa.list_(pa.string()))],
                names=["page_id", "rank", "hex", "uses", "members", "hexes"],
            )

    return run


def compressed_palettes(usage: DataFrame, k: int = 12) -> DataFrame:
    """At most k colours for each page of (page_id, hex, uses, place): (page_id, rank, hex, uses, members, hexes).

    Weighted k-means in CIELAB over a page's distinct colours, in the order of ``place``: seeds are far and heavy, a round
    hands every colour to its nearest centre, and after ROUNDS or once all stand still each cluster is shown by its real
    colour nearest to the centre. Clusters go by uses, the first made first. A page of k colours or fewer keeps them all,
    in order. A weight below 1 counts as 1; texts that are no colour are left out. Only distinct colours of a page meet
    in one task, as their number has a bound and that of elements none.
    """
    rows = usage.select("page_id", "hex", F.greatest(F.coalesce(F.col("uses").cast("long"), F.lit(1)), F.lit(1)).alias("uses"), "place").groupBy("page_id", "hex").agg(F.sum("uses").alias("uses"), F.min("place").alias("place"))
    lines = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "hex", "uses"))).alias("line"))
    # read here, once for each of a page's colours, and not before the counts
    read = F.transform("line", lambda x: F.struct(x["hex"].alias("hex"), x["uses"].alias("uses"), T.bound(C.parse_color(x["hex"]), C.to_fine_lab).alias("lab")))
    flat = F.transform(F.filter(read, lambda x: x["lab"].isNotNull()), lambda x: F.struct(x["hex"].alias("hex"), x["uses"].alias("uses"), *(x["lab"][c].alias(c) for c in "lab")))
    lines = lines.select("page_id", flat.alias("line"))
    schema = S.StructType([lines.schema["page_id"], *S.StructType.fromDDL("rank int, hex string, uses long, members int, hexes array<string>").fields])
    return lines.mapInArrow(_compress(k), schema)


def _chroma(chroma: Column, lightness: float) -> Column:
    return F.greatest(F.lit(0.0), chroma * max(LEAST_CHROMA, 1 - (abs(lightness - PEAK) / PEAK) ** FALL))


def tonal_ramps(colors: DataFrame) -> DataFrame:
    """(base, anchor, hue, chroma, step, hex): a ramp of eleven steps of lightness for each distinct colour of (hex).

    The step whose lightness is nearest to the colour's (the first of equals) is its anchor and keeps its exact hex; the
    others have its hue, and a chroma that falls off towards both ends. What lies outside sRGB is cut to it by channel.
    Texts that are no colour give no rows.
    """
    own = colors.select(C.to_hex(C.parse_color(F.col("hex"))).alias("base")).where("base is not null").distinct()
    lch = own.select("base", T.bound(C.parse_color(F.col("base")), C.to_oklch).alias("c"))
    anchor = F.array_min(F.array(*(F.struct(F.abs(F.lit(light) - F.col("c.l")).alias("off"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, light) in enumerate(STEPS.items()))))
    steps = F.explode(F.array(*(F.struct(F.lit(name).alias("step"), F.lit(light).alias("light"), _chroma(F.col("c.c"), light).alias("chroma")) for name, light in STEPS.items()))).alias("s")
    rows = lch.withColumn("anchor", anchor["name"]).select("base", "anchor", "c", steps)
    made = C.from_oklch(F.struct(F.col("s.light").alias("l"), F.col("s.chroma").alias("c"), F.col("c.h").alias("h")))
    return rows.select("base", "anchor", T.half_up(F.col("c.h")).cast("int").alias("hue"), (T.half_up(F.col("c.c") * 1000) / 1000).alias("chroma"), "s.step", F.when(F.col("s.step") == F.col("anchor"), F.col("base")).otherwise(C.to_hex(made)).alias("hex"))
