"""Candidate pairs of events with their similarities: blocks of nodes, and one matrix product for every two of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.similarity import EARTH_KM
from eventloom.runtime import cut

#: Nodes in a block, about: two blocks give 65,536 pairs, so that even a few thousand nodes keep many tasks busy.
TILE = 256


def block(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists as a matrix of doubles; a null list, or one of another length than most, is a row of NaN."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    if not len(lengths):
        return np.zeros((0, 0))
    width = int(np.bincount(lengths).argmax())
    out = np.full((len(lengths), width), np.nan)
    out[lengths == width] = np.asarray(lists.filter(pa.array(lengths == width)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    return out


def _pairs(a: pa.Table, b: pa.Table, same: bool, most_days: float | None) -> pa.Table:
    ids, times, days, lat, lon = ([np.asarray(t[c].to_numpy()) for t in (a, b)] for c in ("seq_id", "t", "day", "lat", "lon"))
    x, y = block(a["what_vec"]), block(b["what_vec"])
    apart = np.abs(days[0][:, None] - days[1][None, :])
    wanted = np.ones(apart.shape, dtype=bool) if most_days is None else apart <= most_days
    if same:
        wanted &= ids[0][:, None] < ids[1][None, :]
    i, j = np.nonzero(wanted)
    alike = (x @ y.T)[i, j] if x.shape[1] == y.shape[1] else np.full(len(i), np.nan)
    rad = [np.radians(v.astype(np.float64)) for v in (*lat, *lon)]
    h = np.sin((rad[1][j] - rad[0][i]) / 2) ** 2 + np.cos(rad[0])[i] * np.cos(rad[1])[j] * np.sin((rad[3][j] - rad[2][i]) / 2) ** 2
    km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    first = (times[0][i] < times[1][j]) | ((times[0][i] == times[1][j]) & (ids[0][i] > ids[1][j]))
    p, q = ids[0][i], ids[1][j]
    unknown = np.isnan(km)
    columns = [pa.array(np.where(first, p, q), pa.int64()), pa.array(np.where(first, q, p), pa.int64()), pa.array(alike, mask=np.isnan(alike)), pa.array(np.where(unknown, 0, km).astype(np.int64), mask=unknown), pa.array(apart[i, j].astype(np.int64))]
    return pa.table(columns, names=["u", "v", "what_sim", "km", "days"])


def event_pairs(nodes: DataFrame, most_days: float | None = None) -> DataFrame:
    """(u, v, what_sim, km, days) once for every two nodes at most most_days calendar days apart, v being the later one (of equal times the one with the smaller number).

    nodes: seq_id, what_vec array<double>, when timestamp, lat, lon; nodes without a time meet none. Nodes fall into stretches of most_days days, which
    meet only themselves and the next, and a stretch into as many hashed tiles of about TILE nodes as it needs: a task takes two tiles, each
    pair of them once, whatever the size of a stretch.
    """
    most_days = most_days if most_days is not None and most_days < 1e6 else None
    base = nodes.where(F.col("when").isNotNull()).select("seq_id", "what_vec", F.unix_micros(F.col("when").cast("timestamp")).alias("t"), F.datediff(F.to_date("when"), F.lit("1970-01-01").cast("date")).alias("day"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    base = base.withColumn("stretch", F.floor(F.col("day") / (int(most_days) + 1)) if most_days is not None else F.lit(0).cast("long"))
    sizes = cut(base.groupBy("stretch").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("own")))
    near = sizes.join(sizes.select((F.col("stretch") - 1).alias("stretch"), F.col("own").alias("after")), "stretch", "left").join(sizes.select((F.col("stretch") + 1).alias("stretch"), F.col("own").alias("before")), "stretch", "left")
    base = base.join(near, "stretch").withColumn("tile", F.pmod(F.xxhash64("seq_id"), F.col("own")))
    # A pair of tiles: (stretch, tile) of the first, how many stretches later the second is, and its tile.
    to = lambda low, high, later: F.when(high >= low, F.transform(F.sequence(low, high), lambda k: F.struct(F.lit(later).alias("later"), k.alias("k")))).otherwise(F.array().cast("array<struct<later:int,k:bigint>>"))
    zero, last = F.lit(0).cast("long"), lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")) - 1
    columns = ["seq_id", "what_vec", "t", "day", "lat", "lon"]
    left = base.select(*columns, "stretch", "tile", F.explode(F.concat(to(F.col("tile"), last("own"), 0), to(zero, last("after"), 1))).alias("p")).select(*columns, "stretch", "tile", F.col("p.later").alias("later"), F.col("p.k").alias("with"))
    right = base.select(*[F.col(c).alias(c) for c in columns], F.col("stretch").alias("at"), F.col("tile").alias("with"), F.explode(F.concat(to(zero, F.col("tile"), 0), to(zero, last("before"), 1))).alias("p"))
    right = right.select(*columns, (F.col("at") - F.col("p.later")).alias("stretch"), F.col("p.k").alias("tile"), F.col("p.later").alias("later"), "with")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        _, tile, later, other = (k.as_py() for k in key)
        return _pairs(a, b, later == 0 and tile == other, most_days)

    key = ["stretch", "tile", "later", "with"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "u long, v long, what_sim double, km long, days long")
