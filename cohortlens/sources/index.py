"""The idea index: snapshots of a table with metadata, text and vector per row, and a note on each."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import text_hash

# Fixed value: the sections an indexed document is made of.
INDEX_FIELDS = ("Project", "Problem", "Solution", "Differentiation", "Impact", "Inspiration", "Keywords")

SNAPSHOTS_TRIED = 10  # newest ones that are looked at for a whole one


def index_gaps(metadata: DataFrame, vectors: DataFrame, key: str = "row_index") -> DataFrame:
    """Keys present on one side only; an index is complete when there are none."""
    a, b = metadata.select(key), vectors.select(key)
    left = a.join(b, key, "left_anti").withColumn("missing", F.lit("vector"))
    right = b.join(a, key, "left_anti").withColumn("missing", F.lit("metadata"))
    return left.unionByName(right)


def content_hash(df: DataFrame, order: str = "row_index", hash_column: str = "text_hash") -> DataFrame:
    """One row: a hash over all (row, text hash) pairs that does not depend on partitioning.

    The order is part of every pair's own hash, so the pairs can be folded by
    commuting sums of 32-bit slices and no task ever holds the whole list.
    """
    pair = F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.col(hash_column)), 256)
    slices = [
        F.coalesce(F.sum(F.conv(F.substring(pair, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0))
        .cast("string")
        for i in range(8)
    ]
    return df.agg(F.sha2(F.concat_ws(",", *slices), 256).alias("content_hash"), F.count(F.lit(1)).alias("rows"))


def manifest(df: DataFrame, model: str, vector: str = "vec", order: str = "row_index") -> DataFrame:
    """One row describing an index: model, dimensions, input type, content hash and rows."""
    hashed = df.select(order, text_hash(F.col("text")).alias("text_hash"), F.size(vector).alias("_dim"))
    pair = content_hash(hashed, order)
    dims = hashed.agg(F.max("_dim").alias("dimensions"))
    return pair.select(
        F.lit(model).alias("model"),
        dims.scalar().alias("dimensions"),
        F.lit("document").alias("input_type"),
        "content_hash",
        "rows",
        F.lit(",".join(INDEX_FIELDS)).alias("text_fields"),
    )


def write_index(df: DataFrame, folder: str, model: str, vector: str = "vec") -> int:
    """Write rows (with text hashes) as a new snapshot, then the note that points to it.

    All vectors must have one width. Nothing that exists is overwritten: readers keep the
    snapshot they have, and a run that dies before the note is written leaves the index as
    it was. Returns the snapshot's version. Writers must take turns.
    """
    widths = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if widths.lo != widths.hi:
        raise ValueError(f"vectors have {widths.lo} to {widths.hi} dimensions")
    spark = df.sparkSession
    notes = read_notes(spark, folder)
    version = 1 if notes is None else (notes.agg(F.max("version").alias("v")).first().v or 0) + 1
    snapshot = f"rows-{version}-{uuid.uuid4().hex}"
    df.withColumn("text_hash", text_hash(F.col("text"))).write.parquet(f"{folder}/{snapshot}")
    written = spark.read.parquet(f"{folder}/{snapshot}")
    note = manifest(written, model, vector).select(F.lit(version).cast("long").alias("version"), F.lit(snapshot).alias("snapshot"), "*", F.current_timestamp().alias("created_at"))
    note.coalesce(1).write.mode("append").json(f"{folder}/notes")
    return version


NOTE = (
    "version long, snapshot string, model string, dimensions int, input_type string, content_hash string, rows long, text_fields string, created_at timestamp"
)


def read_notes(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row per snapshot that was finished, or None where there is no index."""
    try:
        return spark.read.schema(NOTE).json(f"{folder}/notes")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_index(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """Rows of the newest whole snapshot (or of one version), or None if there is none.

    A snapshot is whole if as many rows with a vector of the noted width, and with the
    noted content hash, are there; if not, the one before it is tried.
    """
    notes = read_notes(spark, folder)
    if notes is None:
        return None
    wanted = notes if version is None else notes.filter(F.col("version") == version)
    for note in wanted.orderBy(F.desc("version")).limit(SNAPSHOTS_TRIED).collect():
        try:
            rows = spark.read.parquet(f"{folder}/{note.snapshot}")
        except AnalysisException:  # rows that were removed or never written whole
            continue
        widths = rows.agg(F.count("vec").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
        there = content_hash(rows.filter("vec IS NOT NULL")).first()
        whole = (widths.n, there.content_hash) == (note["rows"], note.content_hash)
        if whole and (not widths.n or widths.lo == widths.hi == note.dimensions):
            return rows
    return None


def prune_index(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove the rows of all but the newest ``keep`` snapshots; returns their names."""
    notes = read_notes(spark, folder)
    if notes is None:
        return []
    names = [r.snapshot for r in notes.orderBy(F.desc("version")).select("snapshot").collect()][keep:]  # one note a refresh
    removed = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            removed.append(name)
    return removed


def stale_rows(docs: DataFrame, index: DataFrame, hash_column: str = "text_hash") -> DataFrame:
    """Documents whose text is not in the index yet; only these need a new vector."""
    return docs.join(index.select(hash_column), hash_column, "left_anti")


def index_is_current(docs: DataFrame, index: DataFrame, model: str, stored_model: str) -> bool:
    """True when the model is the same and both sides hash to the same ordered content."""
    if model != stored_model:
        return False
    a, b = (content_hash(x).first() for x in (docs, index))
    return a.content_hash == b.content_hash
