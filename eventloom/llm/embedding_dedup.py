"""Near-duplicate embeddings through an inverted multi-index.

Vectors of length 1 are cut into two halves, each with a codebook of its own; the pairs of codes form a grid of cells. Each vector traverses the
grid by multiple sequences: both codebooks sorted by their least distance from it, the cheapest sum of the two next, until the sums exceed the
reach that the target recall asks for. Neighbouring cells of one row are stored as a tile, a vector is sent once to each tile that it visits,
and what a tile holds is then compared exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, drop
from .simhash import spanning_links
from .skew import join_salted
from .vectors import cosine, matrix, sampled, unit, usable

#: Vectors that the codebooks are fitted on at most; vectors wanted in a cell; codes of a half, as long as a row of cells then fits a task; bytes of a task's vectors of a tile.
SAMPLE, CELL, CODES, BYTES = 16384, 256, 20, 16 << 20
#: Tasks wanted at least; cosines that a task holds at once.
TASKS, COSINES = 24, 1 << 21


def block_rows(width: int) -> int:
    """Vectors of a tile that one task takes: as many as BYTES hold as doubles."""
    return max(1, BYTES // (8 * max(1, width)))


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs (i, j) by rising first[i] + second[j], both sorted, until the sum exceeds reach: a pair is offered once its two predecessors are out."""
    out: list[tuple[int, int]] = []
    nexts = [(first[0] + second[0], 0, 0)] if len(first) and len(second) else []
    while nexts and nexts[0][0] <= reach:
        _, i, j = heapq.heappop(nexts)
        out.append((i, j))
        if j == 0 and i + 1 < len(first):  # each row of pairs is entered once its first pair is next in turn
            heapq.heappush(nexts, (first[i + 1] + second[0], i + 1, 0))
        if j + 1 < len(second):
            heapq.heappush(nexts, (first[i] + second[j + 1], i, j + 1))
    return out


@dataclass(frozen=True)
class Grid:
    """first, second: codebooks of the halves; reach: squared distance up to which cells are visited; cells: neighbouring cells of a row in a tile."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    cells: int = 1

    def _gaps(self, half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest code, and its squared distance to the border between that code's cell and each other's."""
        squares = (book * book).sum(axis=1)
        apart = np.sqrt(np.maximum(squares[:, None] - 2 * book @ book.T + squares[None, :], 1e-30))  # codes x codes
        away = (half * half).sum(axis=1)[:, None] - 2 * half @ book.T + squares[None, :]
        own = away.argmin(axis=1)
        gap = np.maximum(away - away[np.arange(len(own)), own][:, None], 0) / (2 * apart[own])
        gap[np.arange(len(own)), own] = 0
        return own, gap * gap

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, gaps of the first halves, gaps of the second halves) of unit vectors."""
        cut_at = self.first.shape[1]
        (a, ga), (b, gb) = self._gaps(x[:, :cut_at], self.first), self._gaps(x[:, cut_at:], self.second)
        return a * len(self.second) + b, ga, gb

    def tile(self, cell: np.ndarray) -> np.ndarray:
        return cell // len(self.second) * (-(-len(self.second) // self.cells)) + cell % len(self.second) // self.cells

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own tile, row, visited tile): the tiles of the cells that a row's traversal meets, its own and later ones; a pair in two tiles meets in the later one."""
        cell, ga, gb = self.locate(x)
        home, rows, tiles = self.tile(cell), [], []
        for r in range(len(x)):
            a, b = np.argsort(ga[r], kind="stable"), np.argsort(gb[r], kind="stable")
            met = np.array(multi_sequence(ga[r][a].tolist(), gb[r][b].tolist(), self.reach), dtype=np.int64).reshape(-1, 2)
            to = np.unique(self.tile(a[met[:, 0]] * len(self.second) + b[met[:, 1]]))
            to = to[to >= home[r]]
            rows.append(np.full(len(to), r))
            tiles.append(to)
        return home, np.concatenate([np.zeros(0, dtype=np.int64), *rows]), np.concatenate([np.zeros(0, dtype=np.int64), *tiles])


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = ((book * book).sum(axis=1)[None, :] - 2 * x @ book.T).argmin(axis=1)
        for c in range(k):
            if (mine := own == c).any():
                book[c] = x[mine].mean(axis=0)
    return book


def _sorted_book(book: np.ndarray) -> np.ndarray:
    """Codes by their place along the direction in which they differ most, so that neighbours in the order are near each other."""
    if len(book) < 3 or not book.shape[1]:
        return book
    _, _, directions = np.linalg.svd(book - book.mean(axis=0), full_matrices=False)
    return book[np.argsort(book @ directions[0], kind="stable")]


def fit_grid(x: np.ndarray, rows: int, least: float, target: float = 1.0, seed: int = 3) -> Grid:
    """Fit on unit vectors x, a sample of `rows` ones.

    With a target recall of 1 the reach is the squared distance of a pair with cosine `least`: the summed squared gaps to borders between two
    vectors never exceed their squared distance, so no pair is missed, whatever directions the vectors differ in. A lower target takes the
    smallest reach within which that share of near pairs meets, of those in a half of the sample that the codebooks are not fitted on (the full
    reach, if they are under 100).
    """
    rng = np.random.default_rng(seed)
    held = x[:0]
    if target < 1:
        x = x[rng.permutation(len(x))]
        x, held = x[: -(-len(x) // 2)], x[-(-len(x) // 2) :]
    # Each vector is sent to a share of the tiles: more codes than CODES would mean more tiles, and more copies of all vectors, the more vectors there are.
    block = block_rows(x.shape[1])
    k = max(1, min(1024, round(math.sqrt(rows / CELL)), max(CODES, -(-rows // block)), len(x)))
    half = max(1, x.shape[1] // 2)
    first = _sorted_book(_codebook(x[:, :half], k, rng))
    second = _sorted_book(_codebook(x[:, half:], k, rng)) if x.shape[1] > half else np.zeros((1, 0))
    grid = Grid(first, second, 2 - 2 * least + 1e-9, max(1, min(len(second), round(block / max(1.0, rows / (len(first) * len(second)))))))
    if target >= 1:
        return grid
    needed = []
    cell, _, _ = grid.locate(held)
    for i in range(0, len(held), 512):
        _, ga, gb = grid.locate(held[i : i + 512])
        a, b = np.nonzero(held[i : i + 512] @ held.T >= least)
        once = (cell[b] > cell[a + i]) | ((cell[b] == cell[a + i]) & (b > a + i))
        a, b = a[once], b[once]
        needed.append(ga[a, cell[b] // len(second)] + gb[a, cell[b] % len(second)])
    needed = np.sort(np.concatenate([np.zeros(0), *needed]))
    if len(needed) < 100:
        return grid
    return Grid(first, second, float(min(grid.reach, needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)] + 1e-12)), grid.cells)


def _compare(visitors: pa.Table, residents: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(visitor row, resident row, cosine) of the pairs at `least` or above; of two that live in the tile, the smaller id is the visitor."""
    x, y = matrix(visitors["vec"]), matrix(residents["vec"])
    p, r = np.asarray(visitors["id"]), np.asarray(residents["id"])
    away = np.asarray(visitors["home"]) != np.asarray(visitors["tile"])
    ux, uy = unit(x), unit(y)
    step = max(1, min(512, COSINES // max(1, len(y))))
    for i in range(0, len(x), step):
        a, b = np.nonzero(ux[i : i + step] @ uy.T >= least - 1e-9)
        a = a + i
        mine = (p[a] != r[b]) & (away[a] | (p[a] < r[b]))
        a, b = a[mine], b[mine]
        if not len(a):
            continue
        exact = cosine(x[a], y[b])
        yield a[exact >= least], b[exact >= least], exact[exact >= least]


def near_vectors(rows: DataFrame, least: float = 0.95, target: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 3) -> DataFrame:
    """One row per row of rows: id_col, n_links (others at cosine `least` or above that were found), component_id (smallest id reachable), kept (id = component_id).

    target is the share of near pairs that the traversal is to meet; with 1 none is missed. Vectors that are null, zero, hold null or non-finite
    components, or have another length than most, link with nothing: 0 links, their own component. Equal vectors are one class: they link with each
    other and share all links, which are counted with the classes' sizes. A null id links with nothing and is not kept. Repeated ids count as rows.
    No pair below `least` ever links; other columns are not read, whatever their names; an empty table gives no rows.
    """
    marked = usable(rows, id_col, vec_col).withColumn("h", F.xxhash64("vec"))
    classes = cut(marked.where("ok").groupBy("h", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    total = classes.count()
    if total == 0:
        return marked.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sample = sampled(classes, "vec", SAMPLE, seed)
    grid, block = fit_grid(sample, total, least, target, seed), block_rows(sample.shape[1])
    # Vectors of floats are sent as floats: they are the same numbers.
    kind = "float" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    shipped = rows.sparkSession.sparkContext.broadcast(grid)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                home, row, tile = shipped.value.visits(unit(matrix(part.column(2))))
                ends = pa.array(np.searchsorted(row, np.arange(len(home) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.ListArray.from_arrays(ends, pa.array(tile))], names=["id", "n", "vec", "home", "tiles"])

    routed = cut(classes.select("id", "n", F.col("vec").cast(f"array<{kind}>").alias("vec")).mapInArrow(route, f"id long, n long, vec array<{kind}>, home long, tiles array<long>"))
    visits = routed.select(F.explode("tiles").alias("tile"), "home", "id", "n", "vec")
    homes = routed.select(F.col("home").alias("tile"), *(F.col(c).alias(c) for c in ("id", "n", "vec")))
    stays = homes.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    some = -(-TASKS // (len(grid.first) * -(-len(grid.second) // grid.cells)))  # few tiles: their visitors come in more groups
    calls = visits.groupBy("tile").agg(F.least(F.count(F.lit(1)), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(some))).alias("groups"))
    sizes = cut(stays.join(calls, "tile"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = visits.join(sizes, "tile").select("tile", every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("groups")).alias("group"), "home", "id", "n", "vec")
    right = homes.join(sizes, "tile").select("tile", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), every("groups").alias("group"), "id", "n", "vec")

    def verify(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(visitors) and len(residents):
            p, r, pn, rn = (np.asarray(t[c]) for c in ("id", "n") for t in (visitors, residents))
            links_p, links_r, up = np.zeros(len(p), dtype=np.int64), np.zeros(len(r), dtype=np.int64), {}
            for a, b, _ in _compare(visitors, residents, least):
                links_p += np.bincount(a, weights=rn[b], minlength=len(p)).astype(np.int64)
                links_r += np.bincount(b, weights=pn[a], minlength=len(r)).astype(np.int64)
                kept = np.array(spanning_links(np.stack([p[a], r[b]], axis=1), up), dtype=np.int64).reshape(-1, 2)
                out.append((kept[:, 0], kept[:, 1], np.zeros(len(kept), dtype=np.int64)))
            for own, links in ((p, links_p), (r, links_r)):
                some = links > 0
                out.append((own[some], own[some], links[some]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names=["a", "b", "links"])

    key = ["tile", "block", "group"]
    found = cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(verify, "a long, b long, links long"))
    links = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    about = classes.join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    about = cut(about.select(F.struct("h", "vec").alias("class"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    drop(routed, sizes, found)
    # Rows that take no part share no key: they are settled apart.
    own = marked.where("ok").select("id", F.struct("h", "vec").alias("class"), F.monotonically_increasing_id().alias("at"))
    linked = join_salted(own, about, "class", "n", "at").select("id", "n_links", "component_id")
    alone = marked.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
