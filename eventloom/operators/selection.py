"""Edges above exact thresholds in two passes over all pairs of nodes.

Bins are set on a bounded sample of pairs; they decide how much is sent, never what comes out. The first pass counts each node's weights by bins. These
counts are of all pairs, so they say in which bins the node's quantiles lie, in which its median distance from its median can lie, and which weight an edge has
at least. The second pass sends the weights in these bins and the pairs that may be edges, and a task of a band of nodes settles both. Nodes with
more than MANY weights in their bins (many equal ones, or weights that the sample has not shown) get their thresholds from tiles.thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import tiles as t
from eventloom.operators.tiles import Side, Tiles, strips

#: Nodes whose pairs set the bins; bins of equal shares of their weights, and more for the largest; cells that find a bin; weights of a node that are sent at most; nodes that one task settles.
SAMPLE, EVEN, TAIL, CELLS, MANY, BAND = 2048, 256, 128, 1 << 16, 8192, 256
#: A weight past all bins, and how far a bound is moved so that rounding cannot pass it.
PAST, SLACK = 1e300, 1e-12
#: Methods whose thresholds are made of quantiles: of which shares, by their number.
SHARES = {"iqr": lambda n: (0.25, 0.75), "percentile": lambda n: (n / 100.0,), "mad": lambda n: (0.5,)}


@dataclass(frozen=True)
class Bins:
    """Bins of positive weights: bin k holds those from low[k] to below high[k]. Cells are the leading bits of doubles, which positive ones are in the order of; edges lie between cells."""

    edges: np.ndarray
    shift: int
    first: int
    cell: np.ndarray

    @staticmethod
    def of(weights: np.ndarray) -> Bins:
        """Bins of about equal shares of a sample, and finer ones for its largest fiftieth."""
        shares = np.concatenate((np.arange(1, EVEN) / EVEN, 1 - 0.02 * (1 - np.arange(1, TAIL) / TAIL)))
        edges = np.quantile(weights, shares, method="lower") if len(weights) else np.ones(1)
        bits = np.unique(np.ascontiguousarray(edges, dtype=np.float64).view(np.int64))
        shift = 0
        while (int(bits[-1]) >> shift) - (int(bits[0]) >> shift) > CELLS - 3:
            shift += 1
        cells = np.unique(bits >> shift)
        first = int(cells[0]) - 1
        known = np.searchsorted(cells, np.arange(first, int(cells[-1]) + 1), side="right").astype(np.int16)
        return Bins((cells << shift).view(np.float64), shift, first, known)

    @property
    def n(self) -> int:
        return len(self.edges) + 1

    @property
    def low(self) -> np.ndarray:
        return np.concatenate(([0.0], self.edges))

    @property
    def high(self) -> np.ndarray:
        return np.concatenate((self.edges, [PAST]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        place = x.view(np.int64) >> self.shift
        place -= self.first
        return self.cell[np.clip(place, 0, len(self.cell) - 1, out=place)]


def _sampled_bins(tiles: Tiles) -> Bins:
    some = tiles.base.orderBy(F.xxhash64(F.lit(11), "seq_id"), "seq_id").limit(SAMPLE).toArrow()
    side = Side(some)
    return Bins.of(np.concatenate([np.zeros(0), *(s.weight for s in strips(side, side, True, tiles.w))]))


def _counted(tiles: Tiles, bins: Bins) -> DataFrame:
    """(u, band, counts binary): each node's weights by bins, a row for every tile that it meets."""
    w, schema = tiles.w, "u long, band long, counts binary"

    def work(a: Side, b: Side, same: bool) -> pa.Table:
        counts = np.zeros((len(a), bins.n), dtype=np.uint16)  # a tile has fewer nodes than that holds
        for s in strips(a, b, same, w):
            if len(s.i):
                first, last = int(s.i[0]), int(s.i[-1]) + 1
                place = (s.i - first) * bins.n
                place += bins(s.weight)
                counts[first:last] += np.bincount(place, minlength=(last - first) * bins.n).astype(np.uint16).reshape(-1, bins.n)
        some = counts.any(axis=1)
        return t._table(schema, [(a.ids[some], a.k[some] // BAND, t._blobs(counts[some], np.arange(1, some.sum() + 1) * bins.n))])

    return tiles.each(work, schema)


def _ranks(n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks next to a quantile's place among n values, and how far it is from the first to the second."""
    place = share * (n - 1)
    return np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64), place - np.floor(place)


def _between(x0: np.ndarray, x1: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.where(x0 == x1, x0, (1.0 - part) * x0 + part * x1)


_STATE = "u long, band long, n long, many boolean, wanted binary, skipped array<long>, inside long, least double, threshold double"


def _narrowed(u: np.ndarray, counts: np.ndarray, bins: Bins, method: str, k: float, most: int | None) -> dict:
    """What the second pass needs of nodes u with these counts by bins.

    wanted: bins whose weights are sent; skipped: for each share, weights in lower bins that are not; inside: weights that are not sent and nearer to the median than
    its rank's; least: what an edge weighs at least.
    """
    low, high = bins.low, bins.high
    upto = np.concatenate((np.zeros((len(u), 1), dtype=np.int64), counts.cumsum(axis=1)), axis=1)
    n, rows, column = upto[:, -1], np.arange(len(u)), np.arange(bins.n)
    wanted, starts, lows, highs = np.zeros(counts.shape, dtype=bool), [], [], []
    for share in SHARES[method](k):
        r0, r1, _ = _ranks(n, share)
        b0, b1 = ((upto[:, 1:] <= r[:, None]).sum(axis=1) for r in (r0, r1))
        wanted |= (column >= b0[:, None]) & (column <= b1[:, None])
        starts.append(b0)
        lows.append(low[b0])
        highs.append(high[b1])
    inside, many = np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=bool)
    if method == "mad":
        r0, r1, _ = _ranks(n, 0.5)
        m0, m1 = lows[0], highs[0]

        def surely(d: np.ndarray) -> np.ndarray:
            """Weights at most d from the median, wherever in its bins it is."""
            return upto[rows, np.searchsorted(high, m0 + d, side="right")] - upto[rows, np.searchsorted(low, m1 - d, side="left")]

        def possibly(d: np.ndarray) -> np.ndarray:
            return upto[rows, np.searchsorted(low, m1 + d, side="right")] - upto[rows, np.searchsorted(high, m0 - d, side="left")]

        end = np.full(len(u), bins.edges[-1])
        many = (surely(end) <= r1) | (m1 >= PAST)
        d0, over, under, d1 = np.zeros(len(u)), end.copy(), np.zeros(len(u)), end.copy()
        for _ in range(50):
            mid = (d0 + over) / 2
            near = possibly(mid) <= r0  # the rank's distance is greater
            d0, over = np.where(near, mid, d0), np.where(near, over, mid)
            mid = (under + d1) / 2
            far = surely(mid) > r1  # and this one's is no greater
            under, d1 = np.where(far, under, mid), np.where(far, mid, d1)
        slack = SLACK * (np.abs(m1) + d1)
        left, right = (m0 - d1 - slack, m1 - d0 + slack), (m0 + d0 - slack, m1 + d1 + slack)
        for a, b in (left, right):
            wanted |= (high >= a[:, None]) & (low <= b[:, None])
        inside = np.where((low > left[1][:, None]) & (high < right[0][:, None]) & ~wanted, counts, 0).sum(axis=1)
        terms = m0, np.minimum(k * d0, k * d1) / 0.6745
    elif method == "iqr":
        terms = np.minimum((1 + k) * lows[1], (1 + k) * highs[1]), -np.maximum(k * highs[0], k * lows[0])
    else:
        terms = lows[0], 0 * lows[0]
    many |= np.where(wanted, counts, 0).sum(axis=1) > MANY
    all_ = many & (n <= MANY)
    wanted[all_], inside[all_], many[all_] = True, 0, False
    least = np.where(all_, 0.0, sum(terms) - SLACK * sum(np.abs(x) for x in terms))
    if most is not None:
        enough = (n[:, None] - upto[:, :-1] >= most).sum(axis=1) - 1  # the last bin from which on there are as many
        least = np.where(enough >= 0, np.maximum(least, low[np.maximum(enough, 0)]), least)
    over_ = np.concatenate((np.zeros((len(u), 1), dtype=np.int64), np.where(wanted, 0, counts).cumsum(axis=1)), axis=1)
    skipped = np.stack([over_[rows, b0] for b0 in starts], axis=1)
    return {"n": n, "many": many, "wanted": wanted, "skipped": skipped, "inside": inside, "least": least}


def _state(counted: DataFrame, bins: Bins, method: str, k: float, most: int | None) -> DataFrame:
    def narrow(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["u"].to_numpy(), kind="stable")
        u, at = np.unique(rows["u"].to_numpy()[order], return_index=True)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), dtype=np.uint16).reshape(-1, bins.n)
        counts = np.add.reduceat(counts[order].astype(np.int64), at, axis=0)
        some = counts.sum(axis=1) > 0
        u, counts = u[some], counts[some]
        s = _narrowed(u, counts, bins, method, k, most)
        q, bits = s["skipped"].shape[1], np.packbits(s["wanted"], axis=1)
        skipped = pa.FixedSizeListArray.from_arrays(pa.array(s["skipped"].ravel(), pa.int64()), q).cast(pa.list_(pa.int64()))
        wanted = t._blobs(bits, np.arange(1, len(u) + 1) * bits.shape[1])
        columns = [pa.array(u, pa.int64()), pa.array(np.full(len(u), key[0].as_py()), pa.int64()), pa.array(s["n"], pa.int64()), pa.array(s["many"]), wanted, skipped, pa.array(s["inside"], pa.int64()), pa.array(s["least"]), pa.nulls(len(u), pa.float64())]
        return pa.table(columns, names=[c.split()[0] for c in _STATE.split(", ")])

    return counted.groupBy("band").applyInArrow(narrow, _STATE)


def _first(node: np.ndarray, weight: np.ndarray, v: np.ndarray, most: int | None) -> np.ndarray:
    """Places of the `most` largest weights of each node, of equal ones those of the larger v; by node, the largest first."""
    order = np.lexsort((-v, -weight, node))
    at = t._starts(node[order])
    return order[np.arange(len(order)) - np.repeat(at, np.diff(at, append=len(order))) < (most or 0)]


_PAIR = ("v", "weight", "what", "where", "when")
_FOUND = "u long, band long, xs binary, " + ", ".join(f"{c} binary" for c in _PAIR)


def _found(tiles: Tiles, bins: Bins, state: DataFrame, most: int | None) -> DataFrame:
    """A row for each node and tile that has some: the weights in the node's wanted bins, and (most) the pairs that may be among its best edges."""
    w = tiles.w

    def work(a: Side, b: Side, same: bool) -> pa.Table:
        bits = -(-bins.n // 8)
        known = a.rows["wanted"].combine_chunks()
        wanted, has = np.zeros((len(a), bits * 8), dtype=bool), np.asarray(known.is_valid())
        wanted[has] = np.unpackbits(np.frombuffer(b"".join(known.drop_null().to_pylist()), dtype=np.uint8).reshape(-1, bits), axis=1).astype(bool)
        least, sent, best = a.own("least"), [(np.zeros(0, np.int64), np.zeros(0))], [(np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * 4)]
        for s in strips(a, b, same, w):
            place = s.i * wanted.shape[1]
            place += bins(s.weight)
            hit = np.flatnonzero(wanted.ravel()[place])
            sent.append((s.i[hit], s.weight[hit]))
            if most is not None and len(may := np.flatnonzero(s.weight >= least[s.i])):
                may = may[_first(s.i[may], s.weight[may], b.ids[s.j[may]], most)]
                top = s.of(may)
                best.append((top.i, b.ids[top.j], top.weight, top.what, top.where, top.when))
        (i, x), (at, *pair) = ([np.concatenate(c) for c in zip(*columns, strict=True)] for columns in (sent, best))
        order, some = np.argsort(i, kind="stable"), _first(at, pair[1], pair[0], most)
        i, x, at, pair = i[order], x[order], at[some], [c[some] for c in pair]
        rows = np.unique(np.concatenate((i, at)))
        ends = [np.searchsorted(c, rows, side="right") for c in (i, at)]
        return t._table(_FOUND, [(a.ids[rows], a.k[rows] // BAND, t._blobs(x, ends[0]), *(t._blobs(c, ends[1]) for c in pair))])

    return tiles.each(work, _FOUND, state.select("u", "band", "wanted", "least"))


def _settled(state: pa.Table, found: pa.Table, method: str, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (ascending) and their thresholds."""
    state = state.take(pa.array(np.argsort(state["u"].to_numpy())))
    u, n, inside = (state[c].to_numpy() for c in ("u", "n", "inside"))
    skipped = np.array(state["skipped"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(u), -1)
    known = state["threshold"].to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.frombuffer(b"".join(found["xs"].to_pylist()), dtype=np.float64)
    node = np.repeat(np.searchsorted(u, found["u"].to_numpy()), [len(b) // 8 for b in found["xs"].to_pylist()]) if len(found) else np.zeros(0, dtype=np.int64)

    def at_ranks(x: np.ndarray, before: np.ndarray, share: float) -> np.ndarray:
        """The quantile of each node's values, `before` of which are smaller and not among x."""
        order = np.argsort(x, kind="stable")
        order = order[np.argsort(node[order].astype(np.int32), kind="stable")]
        first = np.searchsorted(node[order], np.arange(len(u)))
        r0, r1, part = _ranks(n, share)
        ends = [x[order][np.clip(first + r - before, 0, max(len(x) - 1, 0))] if len(x) else np.full(len(u), np.nan) for r in (r0, r1)]
        return _between(*ends, part)

    got = [at_ranks(x, skipped[:, e], share) for e, share in enumerate(SHARES[method](k))]
    if method == "mad":
        limit = got[0] + k * at_ranks(np.abs(x - got[0][node]), inside, 0.5) / 0.6745
    elif method == "iqr":
        limit = got[1] + k * (got[1] - got[0])
    else:
        limit = got[0]
    return u, np.where(np.isnan(known), limit, known)


def best_edges(tiles: Tiles, method: str, k: float, most: int | None = None) -> DataFrame:
    """(u, v, weight, what_sim, where_sim, when_sim): pairs of positive weight at or above the threshold of u's weights by a method of SHARES, the `most` best of each u, ties to the larger v."""
    bins = _sampled_bins(tiles)
    state = t.cut(_state(_counted(tiles, bins), bins, method, k, most))
    many = state.where("many").select("u")
    if not many.isEmpty():
        exact = t.thresholds(tiles, {method: k}, only=many).select("u", F.col(method).alias("exact"))
        none = F.lit(bytes(-(-bins.n // 8)))
        state = t.cut(state.drop("threshold").join(exact, "u", "left").select(
            "u", "band", "n", "many", F.when(F.col("many"), none).otherwise(F.col("wanted")).alias("wanted"), "skipped", "inside",
            F.when(F.col("many"), F.greatest("least", "exact")).otherwise(F.col("least")).alias("least"), F.col("exact").alias("threshold"),
        ))
    found = _found(tiles, bins, state, most)
    bands = state.groupBy("band").cogroup(found.groupBy("band"))
    if most is None:
        def limits(own: pa.Table, got: pa.Table) -> pa.Table:
            u, limit = _settled(own, got, method, k)
            return pa.table([pa.array(u, pa.int64()), pa.array(limit)], names=["u", "threshold"])

        return t.edges_above(tiles, t.cut(bands.applyInArrow(limits, "u long, threshold double")))

    def edges(own: pa.Table, got: pa.Table) -> pa.Table:
        u, limit = _settled(own, got, method, k)
        node = np.repeat(np.searchsorted(u, got["u"].to_numpy()), [len(b) // 8 for b in got["v"].to_pylist()]) if len(got) else np.zeros(0, dtype=np.int64)
        v, weight, *rest = (np.frombuffer(b"".join(got[c].to_pylist()), dtype=np.int64 if c == "v" else np.float64) for c in _PAIR)
        keep = np.flatnonzero(weight >= limit[node])
        keep = keep[_first(node[keep], weight[keep], v[keep], most)]
        return t._table(t._EDGES, [(u[node[keep]], v[keep], weight[keep], *(c[keep] for c in rest))])

    return bands.applyInArrow(edges, t._EDGES)
