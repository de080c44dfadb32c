"""Exact nearest neighbours by Euclidean distance.

Equal vectors become one point first, so copies cost nothing. Points go to the nearest of a
few pivots (cells), cells are cut by a hash of the id into tiles of bounded size. Each tile
first searches itself, which gives every point a radius that already holds k others. A
point then visits only those cells that can reach into its radius: the ring of distances
between a cell's points and its pivot, and the plane half-way between two pivots, bound the
distance from below. Distances inside a tile come from norms and one matrix product; the
few that count are computed again from the differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .tiles import MAX_CELLS, MAX_PIVOT_BYTES, MAX_TILE_BYTES, MIN_TILE_ROWS, matrix_of

DIGITS = 9  # distances are compared and reported at this precision
SLACK = 1e-6  # relative error allowed to distances from norms before they are computed again
MAX_TILE_ROWS = 4096
VISITORS = 16384  # points that visit a tile together
FOUND = "point long, other long, distance double"


def _best(ids: np.ndarray, points: np.ndarray, limits: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, other, distance) of the k nearest others of each point, within its limit."""
    norms = (others * others).sum(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(ids), 512):
        part = points[start : start + 512]
        own = (part * part).sum(axis=1)
        squares = own[:, None] + norms[None, :] - 2.0 * (part @ others.T)
        slack = SLACK * (own[:, None] + norms[None, :] + 1.0)
        squares[ids[start : start + 512, None] == other_ids[None, :]] = np.inf
        near = squares - slack <= (limits[start : start + 512] ** 2)[:, None]
        if len(other_ids) > k:
            near &= squares - slack <= np.partition(squares + slack, k - 1, axis=1)[:, k - 1 : k]
        near &= np.isfinite(squares)
        row, col = np.nonzero(near)
        exact = np.round(np.sqrt(((part[row] - others[col]) ** 2).sum(axis=1)), DIGITS)
        order = np.lexsort((other_ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append((ids[start : start + 512][row[keep]], other_ids[col[keep]], exact[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (points @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _point_neighbours(points: DataFrame, k: int) -> DataFrame:
    """FOUND for distinct points (point, vec): the k nearest others of each, ties by id."""
    spark = points.sparkSession
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.min(F.size("vec")).alias("least")).first()
    if not size.n:
        return spark.createDataFrame([], FOUND)
    if size.dim != size.least:
        raise ValueError("vectors of different length")
    wide = 8 * max(1, size.dim)
    even = math.ceil(size.n / math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))
    tile_rows = max(1, min(MAX_TILE_ROWS, MAX_TILE_BYTES // wide, max(MIN_TILE_ROWS, even)))
    cells = max(1, min(MAX_CELLS, MAX_PIVOT_BYTES // wide, round(math.sqrt(size.n / tile_rows))))
    picked = points.orderBy(F.xxhash64("point"), "point").limit(cells).select("vec").collect()
    pivots = np.array([r.vec for r in picked], dtype=np.float64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(matrix_of(batch.column("vec")), pivots)
                cell = away.argmin(axis=1)
                yield pa.record_batch([batch.column("point"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(away.min(axis=1))], names=["point", "vec", "cell", "reach"])

    placed = stage(points.mapInArrow(assign, "point long, vec array<double>, cell int, reach double"))
    rings = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).collect()}  # MAX_CELLS rows
    parts = [math.ceil(rings[c].n / tile_rows) if c in rings else 0 for c in range(len(pivots))]
    low = np.array([rings[c].low if c in rings else np.inf for c in range(len(pivots))])
    high = np.array([rings[c].high if c in rings else -np.inf for c in range(len(pivots))])
    part_count = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)
    tiled = placed.withColumn("part", F.pmod(F.xxhash64("point"), part_count).cast("int"))

    def inside(table: pa.Table) -> pa.Table:
        ids, vectors = table["point"].to_numpy(), matrix_of(table["vec"])
        point, other, distance = _best(ids, vectors, np.full(len(ids), np.inf), ids, vectors, k)
        return pa.table({"point": point, "other": other, "distance": distance})

    near = stage(tiled.groupBy("cell", "part").applyInArrow(inside, FOUND))
    radius = near.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("limit"))
    limits = tiled.join(radius, "point", "left").select("point", "vec", "cell", "part", F.when(F.col("n") >= k, F.col("limit")).otherwise(float("inf")).alias("limit"))

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _distances(matrix_of(batch.column("vec")), pivots)
            limit = batch.column("limit").to_numpy() * (1 + SLACK) + SLACK * (1 + away.max(axis=1))
            bound = np.maximum(np.maximum(away - high, low - away), (away - away.min(axis=1, keepdims=True)) / 2)
            rows, targets = np.nonzero(bound <= limit[:, None])
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(targets.astype(np.int32)))
            yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    visiting = stage(limits.mapInArrow(reachable, "point long, vec array<double>, cell int, part int, limit double, cells array<int>"))
    visits = visiting.select("point", "vec", "limit", F.col("cell").alias("home"), F.col("part").alias("home_part"), F.explode("cells").alias("cell"))
    counts = {r.cell: r.n for r in visiting.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_CELLS rows
    shares = F.element_at(F.array(*(F.lit(max(1, math.ceil(counts.get(c, 0) / VISITORS))) for c in range(len(pivots)))), F.col("cell") + 1)
    guests = visits.select("point", "vec", "limit", "cell", F.explode(F.sequence(F.lit(0), part_count - 1)).alias("part"), "home", "home_part", F.pmod(F.xxhash64("point"), shares).cast("int").alias("share"))
    guests = guests.filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))).drop("home", "home_part")
    hosts = tiled.select("point", "vec", F.lit(None).cast("double").alias("limit"), "cell", "part", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))

    def visit(table: pa.Table) -> pa.Table:
        limit = table["limit"].to_numpy()
        ids, vectors, host = table["point"].to_numpy(), matrix_of(table["vec"]), np.isnan(limit)
        point, other, distance = _best(ids[~host], vectors[~host], limit[~host], ids[host], vectors[host], k)
        return pa.table({"point": point, "other": other, "distance": distance})

    met = guests.unionByName(hosts).groupBy("cell", "part", "share").applyInArrow(visit, FOUND)
    order = Window.partitionBy("point").orderBy("distance", "other")
    return near.unionByName(met).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def nearest_neighbours(df: DataFrame, k: int) -> DataFrame:
    """(id, place, neighbour, distance): the k nearest other rows of each row of (id, vec).

    Ties go by id. A row without k others has fewer neighbours; rows with a null vector
    have none and are nobody's neighbour. ``id`` must be unique. Of equal vectors only the
    k + 1 least ids can be neighbours; one of them stands for all in the search.
    """
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter("vec IS NOT NULL")
    rows = stage(rows.withColumn("key", F.xxhash64("vec")))
    same = Window.partitionBy("key", "vec").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    points = stage(first.groupBy("key", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("point", F.col("ids")[0]))
    found = _point_neighbours(points.select("point", "vec"), k)
    members = points.select(F.col("point").alias("other"), F.slice("ids", 1, k).alias("ids"))
    listed = found.join(members, "other").select("point", F.explode(F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("neighbour")))).alias("near"))
    others = listed.groupBy("point").agg(F.slice(F.array_sort(F.collect_list("near")), 1, k).alias("others"))  # k points of k ids
    known = points.join(others, "point", "left").select("key", "vec", "ids", F.coalesce("others", F.array().cast("array<struct<distance:double,neighbour:bigint>>")).alias("others"))
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("neighbour")))
    merged = F.slice(F.array_sort(F.concat(own, "others")), 1, k)
    ranked = rows.join(known, ["key", "vec"]).select("id", F.posexplode(merged).alias("place", "near"))
    return ranked.select("id", (F.col("place") + 1).alias("place"), "near.neighbour", "near.distance")
