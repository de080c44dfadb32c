"""Check new submissions against the archive as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.vectors import MIN_SCORE, TOP_K, match_ids

MIN_CHARS = 15  # fixed value: shorter submissions are not checked


def checkable(arrivals: DataFrame) -> DataFrame:
    """Submissions with both parts filled and enough text, with a hash of what is compared."""
    idea, description = strip(F.col("idea")), strip(F.col("description"))
    kept = arrivals.filter(
        (idea != "") & (description != "") & (F.length(idea) + F.length(description) >= MIN_CHARS)
    )
    return kept.withColumn("text_hash", F.sha2(F.concat_ws("\n", idea, description), 256))


def check_batch(arrivals: DataFrame, index: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Closest archived ideas per distinct text of a batch; equal texts share one check."""
    ready = checkable(arrivals)
    first = ready.groupBy("text_hash").agg(F.min("query_id").alias("query_id"))
    asked = ready.join(first.select("query_id"), "query_id", "left_semi").select("query_id", "vec")
    return match_ids(index, asked, top_k, min_score)


def check_arrivals(
    stream: DataFrame,
    index: DataFrame,
    output: str,
    checkpoint: str,
    top_k: int = TOP_K,
    min_score: float = MIN_SCORE,
    remember: str = "7 days",
) -> StreamingQuery:
    """Start a query that appends matches of new texts to ``output`` as Parquet.

    ``stream`` has columns query_id, idea, description, vec and arrived_at. A text seen
    within ``remember`` is not checked again; the watermark bounds that state. Each batch
    writes its own folder, so a replayed batch replaces its earlier output.
    """
    fresh = (
        checkable(stream)
        .withWatermark("arrived_at", remember)
        .dropDuplicatesWithinWatermark(["text_hash"])
    )

    def write(batch: DataFrame, number: int) -> None:
        # The batch is evaluated for its size, its vectors and its result: keep one copy.
        batch = batch.persist()
        try:
            match_ids(index, batch, top_k, min_score).write.mode("overwrite").parquet(f"{output}/batch={number}")
        finally:
            batch.unpersist()

    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
