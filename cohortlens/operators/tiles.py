"""Exact all-pairs cosine work as shuffled tile pairs.

Rows go to the nearest of a few pivots (cells) and cells are cut into tiles of bounded
size by a hash of the row id. By the triangle inequality on angles, two cells whose
pivots are further apart than both radii plus the threshold angle hold no similar pair
and are never compared. Each remaining pair of tiles is one group of one shuffle: a
matrix product inside a task of bounded size, whatever the data's skew. A kernel then
reduces the product before anything is emitted (best partners per row, counts, minima),
so dense groups of near copies never produce their quadratic set of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SIM_DIGITS = 9  # similarities are compared and reported at this precision
NORM_FLOOR = 1e-12  # fixed value
MAX_TILE_ROWS = 32768  # large, because a row travels once for every tile it meets
PAIRS_PER_CORE = 16
MIN_TILE_ROWS = 256
MAX_TILE_BYTES = 16 << 20
MAX_CELLS = 1024  # pivots are the only vectors that visit the driver
MAX_PIVOT_BYTES = 16 << 20
STRIP_CELLS = 1 << 22  # cells of a product held at a time


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.maximum(norms, NORM_FLOOR)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A float64 matrix from an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


@dataclass(frozen=True)
class Side:
    """One tile of a pair, rows ordered by id."""

    ids: np.ndarray
    units: np.ndarray
    load: np.ndarray


Kernel = Callable[[Side, Side, bool], Iterator[dict]]


@dataclass(frozen=True)
class Tiles:
    rows: DataFrame  # id, unit, load, tile
    pairs: DataFrame  # tile, partner pairs (a, b)
    pair_count: int

    def run(self, kernel: Kernel, schema: str) -> DataFrame:
        """Apply a kernel to every tile pair and union what it yields."""
        parallel = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = max(1, min(self.pair_count, 16 * parallel))
        sent = (
            self.rows.join(self.pairs, "tile")
            .select("id", "unit", "load", "tile", F.explode("partners").alias("_pair"))
            .select("id", "unit", "load", "tile", "_pair.a", "_pair.b")
            .repartition(spread, "a", "b")
        )
        types = {
            name: np.float64 if kind == "double" else np.int64
            for name, kind in (part.split() for part in schema.split(","))
        }

        def apply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            a, b = key[0].as_py(), key[1].as_py()
            tile = table["tile"].to_numpy()
            ids = table["id"].to_numpy()
            load = table["load"].to_numpy()
            units = matrix_of(table["unit"])

            def side(t: int) -> Side:
                mine = np.flatnonzero(tile == t)
                mine = mine[np.argsort(ids[mine], kind="stable")]
                return Side(ids[mine], units[mine], load[mine])

            left = side(a)
            right = left if a == b else side(b)
            parts = list(kernel(left, right, a == b)) if len(left.ids) and len(right.ids) else []
            columns = {
                n: np.concatenate([p[n] for p in parts]) if parts else np.array([])
                for n in types
            }
            return pa.table(
                {n: pa.array(v.astype(types[n])) for n, v in columns.items()}
            )

        return sent.groupBy("a", "b").applyInArrow(apply, schema)


def build_tiles(df: DataFrame, threshold: float, load: Column | None = None, apart: bool = False) -> Tiles | None:
    """Tiles over ``df`` (columns id, vec); ``load`` is one long carried with each row.

    With ``apart`` rows of load 0 and the others get tiles of their own, and only tiles of
    different kinds meet: for two tables of which one asks and the other answers.
    """
    spark = df.sparkSession
    data = df.select(
        F.col("id").cast("long").alias("id"),
        F.col("vec").cast("array<double>").alias("vec"),
        (load if load is not None else F.lit(0)).cast("long").alias("load"),
    ).filter(F.col("vec").isNotNull())
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size.n:
        return None
    parallel = spark.sparkContext.defaultParallelism
    by_bytes = MAX_TILE_BYTES // (8 * size.dim)
    even = math.ceil(size.n / math.ceil(math.sqrt(PAIRS_PER_CORE * parallel)))  # enough pairs to fill the cluster
    tile_rows = max(1, min(MAX_TILE_ROWS, by_bytes, max(MIN_TILE_ROWS, even)))
    cells = max(1, min(MAX_CELLS, MAX_PIVOT_BYTES // (8 * size.dim), round(math.sqrt(size.n / tile_rows))))
    picked = data.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec").collect()
    pivots = unit_rows(np.array([r.vec for r in picked], dtype=np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(matrix_of(batch.column("vec")))
            near = units @ pivots.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
            if apart:
                cell = 2 * cell + (batch.column("load").to_numpy() != 0)
            flat = pa.array(units.reshape(-1))
            offsets = pa.array(np.arange(0, units.size + 1, units.shape[1], dtype=np.int32))
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "load": batch.column("load"),
                    "unit": pa.ListArray.from_arrays(offsets, flat),
                    "cell": pa.array(cell.astype(np.int32)),
                    "angle": pa.array(angle),
                }
            )

    placed = stage(
        data.mapInArrow(assign, "id long, load long, unit array<double>, cell int, angle double")
    )
    stats = {
        r.cell: (r.n, r.radius)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    }
    if apart:
        pivots = np.repeat(pivots, 2, axis=0)
    chunks = [math.ceil(stats[c][0] / tile_rows) if c in stats else 0 for c in range(len(pivots))]
    radius = np.array([stats[c][1] if c in stats else 0.0 for c in range(len(pivots))])
    starts = [sum(chunks[:c]) for c in range(len(pivots))]
    # A margin covers rounding in the angles; a zero vector is no direction, so it gets no pruning.
    # Similarities are compared after rounding, so the least one that passes lies half a digit lower.
    least = threshold - 0.5 * 10.0**-SIM_DIGITS
    limit = math.acos(max(-1.0, min(1.0, least))) + 1e-6
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    near_cells = between - radius[:, None] - radius[None, :] <= limit
    near_cells |= threshold <= 0
    if apart:
        kind = np.arange(len(pivots)) % 2
        near_cells &= kind[:, None] != kind[None, :]
    cell_of = np.repeat(np.arange(len(pivots)), chunks)
    total = len(cell_of)

    start = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("cell") + 1)
    count = F.element_at(F.array(*[F.lit(max(1, c)) for c in chunks]), F.col("cell") + 1)
    rows = placed.select("id", "unit", "load", (start + F.pmod(F.xxhash64("id"), count)).cast("int").alias("tile"))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["id"]:
                others = np.flatnonzero(near_cells[cell_of[t], cell_of])
                listed = [{"a": int(min(t, o)), "b": int(max(t, o))} for o in others]
                yield pd.DataFrame({"tile": [int(t)], "partners": [listed]})

    pairs = spark.range(total).mapInPandas(partners, "tile int, partners array<struct<a:int,b:int>>")
    sizes = np.array(chunks, dtype=np.int64)
    ordered = int((near_cells * np.outer(sizes, sizes)).sum())
    count_pairs = (ordered + total) // 2  # every tile also meets itself
    return Tiles(rows, pairs, count_pairs)


def _products(left: Side, right: Side, same: bool, threshold: float):
    """Row offsets, strips of cosines and which of them are pairs, judged as after rounding.

    Rounding moves a value by half a digit at most, so only values that near the threshold are rounded here.
    """
    rows = max(1, STRIP_CELLS // max(1, len(right.ids)))
    digit = 10.0**-SIM_DIGITS
    for start in range(0, len(left.ids), rows):
        stop = min(start + rows, len(left.ids))
        sims = left.units[start:stop] @ right.units.T
        hits = sims >= threshold - digit
        if same:
            own = np.arange(start, stop)
            hits[own - start, own] = False
        i, j = np.nonzero(hits & (sims < threshold + digit))
        hits[i, j] = np.round(sims[i, j], SIM_DIGITS) >= threshold
        yield start, sims, hits


def top_pairs_kernel(threshold: float, limit: int | None) -> Kernel:
    """The best ``limit`` pairs of a tile pair as (l, r, sim); None keeps all of them."""

    def kernel(left: Side, right: Side, same: bool):
        for start, sims, hits in _products(left, right, same, threshold):
            i, j = np.nonzero(hits)
            if same:
                upper = i + start < j
                i, j = i[upper], j[upper]
            a, b, s = left.ids[i + start], right.ids[j], np.round(sims[i, j], SIM_DIGITS)
            l, r = np.minimum(a, b), np.maximum(a, b)
            if limit is not None and len(s) > limit:
                keep = np.lexsort((r, l, -s))[:limit]
                l, r, s = l[keep], r[keep], s[keep]
            yield {"l": l, "r": r, "sim": s}

    return kernel


def _picked(side: Side, rows: np.ndarray) -> Side:
    return side if rows.all() else Side(side.ids[rows], side.units[rows], side.load[rows])


def _both_ways(left: Side, right: Side, same: bool):
    yield left, right
    if not same:
        yield right, left


def nearest_kernel(threshold: float, k: int, only_marked: bool = False) -> Kernel:
    """Up to ``k`` best partners per row as (v, u, sim, v_load, u_load).

    Best means larger similarity, then smaller edge (l, r). With ``only_marked`` rows whose
    load is non-zero ask, the other rows answer, and ties go to the smaller partner.
    """

    def kernel(left: Side, right: Side, same: bool):
        for one, two in _both_ways(left, right, same):
            if only_marked:
                one, two = _picked(one, one.load != 0), _picked(two, two.load == 0)
            for start, sims, hits in _products(one, two, same and not only_marked, threshold):
                for row in np.flatnonzero(hits.any(axis=1)):
                    me = start + row
                    hit = np.flatnonzero(hits[row])
                    s = np.round(sims[row, hit], SIM_DIGITS)
                    if len(hit) > k:
                        floor = np.partition(s, len(s) - k)[len(s) - k]
                        hit, s = hit[s >= floor], s[s >= floor]
                    u = two.ids[hit]
                    v = one.ids[me]
                    if only_marked:
                        order = np.lexsort((u, -s))[:k]
                    else:
                        order = np.lexsort((np.maximum(u, v), np.minimum(u, v), -s))[:k]
                    n = len(order)
                    yield {
                        "v": np.full(n, v), "u": u[order], "sim": s[order],
                        "v_load": np.full(n, one.load[me]), "u_load": two.load[hit][order],
                    }

    return kernel


def degree_kernel(threshold: float) -> Kernel:
    """Per row: number of partners in the other tile and the best similarity."""

    def kernel(left: Side, right: Side, same: bool):
        there, top = np.zeros(len(right.ids), dtype=np.int64), np.full(len(right.ids), -np.inf)
        for start, sims, hits in _products(left, right, same, threshold):
            sims[~hits] = -np.inf
            degree = np.count_nonzero(hits, axis=1)
            some = degree > 0
            yield {
                "v": left.ids[start : start + len(sims)][some],
                "degree": degree[some], "best": np.round(sims.max(axis=1)[some], SIM_DIGITS),
            }
            if not same:
                there += np.count_nonzero(hits, axis=0)
                top = np.maximum(top, sims.max(axis=0))
        some = there > 0
        yield {"v": right.ids[some], "degree": there[some], "best": np.round(top[some], SIM_DIGITS)}

    return kernel
