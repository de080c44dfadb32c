"""Connected components of an edge table, in rounds of grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is one node per component.

    Each round hooks every node to its least neighbour, follows the hooks to their roots,
    and keeps the edges between different roots. Grouped minima combine before the
    shuffle, so a node with very many edges is no hot spot. Rows with a null end and
    loops are left out; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = spark.createDataFrame([], live.schema.add("unused", "long")).select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = True
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hooks = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while True:
            upper = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            moved = stage(hooks.join(upper, "root").select("node", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")))
            hooks = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        if first:
            labels, first = hooks.withColumnRenamed("root", "label"), False
        else:
            labels = labels.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        ends = live.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        live = stage(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels
