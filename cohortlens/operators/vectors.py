"""Vector search: normalising, similar pairs, query matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.documents import with_sections
from ..functions.text import snippet
from ..session import stage
from .tiles import (
    NORM_FLOOR, SIM_DIGITS, build_tiles, matrix_of, nearest_kernel, top_pairs_kernel, unit_rows,
)

# Defaults of the similarity reports.
STRICTNESS = {"Very similar": 0.92, "Similar": 0.87, "Somewhat similar": 0.80}
DEFAULT_STRICTNESS = "Very similar"
PAIR_LIMIT = 25
TOP_K = 3
MIN_SCORE = 0.50
MAX_QUERY_BYTES = 32 << 20  # largest query set handed to every task
IDENTITY_COLUMNS = ("project_name", "year", "cohort_id", "sector")


def normalize_vec(col: Column) -> Column:
    vec = col.cast("array<double>")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(vec, lambda x: x / F.greatest(norm, F.lit(NORM_FLOOR)))


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two already normalised vectors."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def pair_edges(df: DataFrame, threshold: float, limit: int | None) -> DataFrame:
    """(l, r, sim) with l < r, best first; every tile pair keeps no more than ``limit``."""
    tiles = build_tiles(df, threshold)
    if tiles is None:
        return df.sparkSession.createDataFrame([], "l long, r long, sim double")
    edges = tiles.run(top_pairs_kernel(threshold, limit), "l long, r long, sim double")
    return edges if limit is None else edges.orderBy(F.desc("sim"), "l", "r").limit(limit)


def similar_pairs(
    index: DataFrame, threshold: float = STRICTNESS[DEFAULT_STRICTNESS], limit: int = PAIR_LIMIT
) -> DataFrame:
    """The most similar pairs with both sides' attributes, best first.

    The pair search sees ids and vectors only; texts join the at most ``limit`` results.
    """
    edges = stage(pair_edges(index.select(F.col("row_index").alias("id"), "vec"), threshold, limit))
    ends = edges.select(F.explode(F.array("l", "r")).alias("row_index")).distinct()
    kept = index.join(ends, "row_index", "left_semi")
    kept = with_sections(kept, "text", problem="Problem", solution="Solution")
    described = stage(
        kept.select("row_index", *IDENTITY_COLUMNS, snippet(F.col("text")).alias("snippet"), "problem", "solution")
    )

    def side(prefix: str, key: str) -> DataFrame:
        return described.select(
            F.col("row_index").alias(key),
            *[F.col(c).alias(f"{prefix}_{c}") for c in described.columns if c != "row_index"],
        )

    return (
        edges.join(side("left", "l"), "l")
        .join(side("right", "r"), "r")
        .withColumn("level", L.similarity_level(F.col("sim")))
        .orderBy(F.desc("sim"), "l", "r")
    )


def top_similar_pairs(index: DataFrame, level: str = DEFAULT_STRICTNESS, limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs at a named strictness; an unknown name means the default."""
    return similar_pairs(index, STRICTNESS.get(level, STRICTNESS[DEFAULT_STRICTNESS]), limit)


def _match_scan(index: DataFrame, queries: Sequence, top_k: int, min_score: float) -> DataFrame:
    ids = np.array([r.query_id for r in queries], dtype=np.int64)
    matrix = unit_rows(np.array([r.vec for r in queries], dtype=np.float64))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.empty((len(ids), 0), dtype=np.int64)
        sims = np.empty((len(ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(matrix_of(batch.column("vec")))
            found = np.round(matrix @ units.T, SIM_DIGITS)
            mine = np.broadcast_to(batch.column("row_index").to_numpy(), found.shape)
            rows, sims = np.hstack([rows, mine]), np.hstack([sims, found])
            if rows.shape[1] > top_k:
                order = np.lexsort((rows, -sims))[:, :top_k]
                rows = np.take_along_axis(rows, order, 1)
                sims = np.take_along_axis(sims, order, 1)
        keep = sims >= min_score
        if keep.any():
            owner = np.broadcast_to(ids[:, None], sims.shape)
            yield pa.record_batch(
                {"query_id": pa.array(owner[keep]), "row_index": pa.array(rows[keep]), "sim": pa.array(sims[keep])}
            )

    data = index.filter(F.col("vec").isNotNull()).select(
        F.col("row_index").cast("long").alias("row_index"), F.col("vec").cast("array<double>").alias("vec")
    )
    return data.mapInArrow(best, "query_id long, row_index long, sim double")


def _match_tiles(index: DataFrame, queries: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """Both sides shuffled as tiles; queries are the marked rows and only they ask."""
    rows = index.select((F.col("row_index").cast("long") * 2).alias("id"), F.col("vec"), F.lit(0).alias("asks"))
    asked = queries.select((F.col("query_id").cast("long") * 2 + 1).alias("id"), F.col("vec"), F.lit(1).alias("asks"))
    tiles = build_tiles(rows.unionByName(asked), min_score, F.col("asks"), apart=True)
    found = tiles.run(
        nearest_kernel(min_score, top_k, only_marked=True),
        "v long, u long, sim double, v_load long, u_load long",
    )
    return found.select(
        F.shiftright("v", 1).alias("query_id"), F.shiftright("u", 1).alias("row_index"), "sim"
    )


def match_ids(index: DataFrame, queries: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, row_index, sim, rank): the best rows per query above a floor.

    Queries of a checked, bounded size travel to the tasks and the index is scanned in
    place; each task keeps its own best ``top_k`` per query and only those are shuffled.
    A larger query set is matched by tile pairs instead.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size.n:
        schema = "query_id long, row_index long, sim double, rank int"
        return index.sparkSession.createDataFrame([], schema)
    if size.n * size.dim * 8 <= MAX_QUERY_BYTES:
        asked = queries.select(
            F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")
        )
        found = _match_scan(index, asked.collect(), top_k, min_score)
    else:
        found = _match_tiles(index, queries, top_k, min_score)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_index")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_k)


def rank_matches(index: DataFrame, queries: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Matches with level, attributes, snippet and sections of the matched ideas."""
    hits = match_ids(index, queries, top_k, min_score)
    found = index.drop("vec").join(hits, "row_index")
    return with_sections(found, "text", problem="Problem", solution="Solution").select(
        "query_id", "rank", "row_index", "sim",
        L.query_level(F.col("sim")).alias("level"),
        *IDENTITY_COLUMNS,
        snippet(F.col("text")).alias("snippet"),
        "problem", "solution",
    )
