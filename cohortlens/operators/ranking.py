"""Ranks, ranking metrics, score blending, shortlists and the two-stage cascade.

Order-based measures first group rows to distinct scores; running counts over the
ordered scores come from ``running_sums`` and stay exact for any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ordering import global_row_number, running_sums

# Weights, grid and guards of the evaluation.
BLEND_WEIGHT = 0.6
BLEND_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
THRESHOLD_GRID = tuple(round(0.05 + 0.025 * i, 3) for i in range(29))
RECALL_FLOOR = 0.85
MIN_ROWS = 3


def rank_pct(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank over the number of non-null values; ties share it, nulls have none."""
    value = F.col(column)
    counts = df.filter(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, [F.asc("_v")], ["_n"])
    whole = counts.agg(F.sum("_n")).scalar()
    ranks = placed.select("_v", ((F.col("_n_before") + (F.col("_n") + 1) / 2) / whole).alias(name))
    return df.join(ranks, value == F.col("_v"), "left").drop("_v")


def score_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (and series): rows, positives, and both among the lower scores."""
    pairs = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    grouped = pairs.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    if not by:
        return running_sums(grouped, [F.asc("score")], ["n", "pos"])
    grouped = stage(grouped)
    placed = running_sums(grouped, [*[F.asc(c) for c in by], F.asc("score")], ["n", "pos"])
    base = placed.groupBy(*by).agg(F.min("n_before").alias("_n0"), F.min("pos_before").alias("_p0"))
    return (
        placed.join(base, list(by))
        .withColumns({"n_before": F.col("n_before") - F.col("_n0"), "pos_before": F.col("pos_before") - F.col("_p0")})
        .drop("_n0", "_p0")
    )


def _metric_sums(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """All sums the three metrics need, in one pass over the curve."""
    whole = curve.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"), F.count(F.lit(1)).alias("scores")
    )
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    rank = F.col("n_before") + (n + 1) / 2
    below = F.col("n_before") - F.col("pos_before") + (n - pos) / 2
    at_or_above = F.col("rows") - F.col("n_before")
    tp = F.col("positives") - F.col("pos_before")
    if by:
        joined = curve.join(whole, list(by))
    else:
        joined = curve.withColumns({c: whole.select(c).scalar() for c in whole.columns})
    return joined.groupBy(*by, "rows", "positives", "scores").agg(
        F.sum(pos * below).alias("won"),
        F.sum(pos * tp / at_or_above).alias("step"),
        F.sum(rank * rank * n).alias("rr"),
        F.sum(rank * pos).alias("ry"),
    )


def prediction_metrics(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """auc, average precision and Spearman correlation, null where they mean nothing.

    Fewer than three scored rows, one class only or one score only give nulls.
    """
    sums = _metric_sums(score_curve(df, score, label, by), by)
    rows, p = F.col("rows").cast("double"), F.col("positives").cast("double")
    usable = (rows >= MIN_ROWS) & (p > 0) & (p < rows) & (F.col("scores") > 1)
    mean_rank = (rows + 1) / 2
    covariance = F.col("ry") - mean_rank * p
    spread = F.sqrt((F.col("rr") - rows * mean_rank * mean_rank) * (p - p * p / rows))
    return sums.select(
        *by, "rows", "positives",
        F.when(usable, F.col("won") / (p * (rows - p))).alias("auc"),
        F.when(usable, F.col("step") / p).alias("average_precision"),
        F.when(usable, covariance / spread).alias("spearman"),
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Classification measures; an empty denominator gives 0."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "fn": fn,
        "fn_rate": ratio(fn, fn + tp),
        "fp": fp,
        "fp_rate": ratio(fp, fp + tn),
    }


def confusion_metrics(
    df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("_fp"),
        F.count_if(~hit & true).alias("_fn"), F.count_if(~hit & ~true).alias("tn"),
    )
    measures = rates(F.col("tp"), F.col("_fp"), F.col("_fn"), F.col("tn"))
    return counts.select(*by, *[c.alias(n) for n, c in measures.items()])


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "label", grid: Sequence[float] = THRESHOLD_GRID) -> DataFrame:
    """Confusion measures at every threshold from one pass: conditional counts, no fan-out."""
    true = F.col(label) == 1
    counts = []
    for i, t in enumerate(grid):
        hit = F.col(score) >= t
        counts += [F.count_if(hit & true).alias(f"tp{i}"), F.count_if(hit & ~true).alias(f"fp{i}")]
    totals = df.agg(F.count_if(true).alias("_p"), F.count_if(~true).alias("_n"), *counts)
    per = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp0"))
            for i, t in enumerate(grid)
        ]
    )
    rows = totals.select("_p", "_n", F.explode(per).alias("s")).select("_p", "_n", "s.*")
    measures = rates(F.col("tp"), F.col("fp0"), F.col("_p") - F.col("tp"), F.col("_n") - F.col("fp0"))
    return rows.select("threshold", *[c.alias(n) for n, c in measures.items()])


def pick_threshold(sweep: DataFrame, recall_floor: float = RECALL_FLOOR) -> DataFrame:
    """Best F2 (then recall) among thresholds keeping the recall, else among all of them."""
    order = [F.desc(F.col("recall") >= recall_floor), F.desc("f2"), F.desc("recall"), F.asc("threshold")]
    return sweep.orderBy(*order).limit(1)


def blend(df: DataFrame, weight: float = BLEND_WEIGHT, model: str = "model_prob", agent: str = "agent_score") -> DataFrame:
    """Add both percentile ranks and their weighted mean, null where a score is missing."""
    ranked = rank_pct(rank_pct(df, model, "model_rank"), agent, "agent_rank")
    return ranked.withColumn("hybrid", weight * F.col("model_rank") + (1 - weight) * F.col("agent_rank"))


def weight_sweep(blended: DataFrame, weights: Sequence[float] = BLEND_WEIGHTS, label: str = "label") -> DataFrame:
    """AUC of every blend weight; all series share one grouped curve."""
    series = F.array(
        *[
            F.struct(
                F.lit(w).alias("weight"),
                (w * F.col("model_rank") + (1 - w) * F.col("agent_rank")).alias("score"),
            )
            for w in weights
        ]
    )
    long = blended.select(F.col(label).alias("label"), F.explode(series).alias("s")).select("label", "s.*")
    return prediction_metrics(long, by=["weight"]).select("weight", "auc")


def with_agent_score(df: DataFrame, cache: DataFrame, key: str = "identity") -> DataFrame:
    """Left lookup of the review score; the cache holds one row per identity."""
    return df.join(cache.select(key, F.col("score").alias("agent_score")), key, "left")


def best_per_identity(df: DataFrame, score: str = "model_prob", key: str = "identity", order: str = "row_id") -> DataFrame:
    """Each identity's highest-scored row (tie: the first), by a grouped extreme."""
    best = F.max(F.struct(F.col(score), F.negative(order).alias("_o"))).alias("_b")
    kept = df.groupBy(key).agg(best).select((-F.col("_b._o")).alias(order))
    return df.join(kept, order, "left_semi")


def model_top_k(df: DataFrame, k: int, score: str = "model_prob", order: str = "row_id") -> DataFrame:
    """The k best identities, best first."""
    return best_per_identity(df, score, order=order).orderBy(F.desc(score), order).limit(k)


def model_rank(df: DataFrame, score: str = "model_prob", order: str = "row_id") -> DataFrame:
    """Rank 1..n over all rows by falling score.

    Only score and ``order``, which must be unique, are sorted and written; the ranks are
    joined to the rows.
    """
    ranks = global_row_number(df.select(score, order), [F.desc(score), F.asc(order)], "model_rank")
    return df.join(ranks.select(order, "model_rank"), order)


def primary_shortlist(ranked: DataFrame, n: int) -> DataFrame:
    """First n ranked rows, but no more than there are predicted acceptances."""
    predicted = ranked.agg(F.count_if(F.col("predicted_accepted") == 1)).scalar()
    return ranked.filter(F.col("model_rank") <= F.least(F.lit(n), predicted))


def combined_shortlist(ranked: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """Shortlist rows joined with their review: score text, verdict, sources, status."""
    joined = ranked.filter(F.col("model_rank") <= n).join(reviews, "identity", "left")
    total = F.col("total_score")
    return joined.select(
        "model_rank", "identity", "project_name",
        F.round("accept_probability", 3).alias("model_prob"),
        F.when(total.isNotNull(), F.concat(F.format_string("%.1f", total), F.lit("/25"))).otherwise("N/A").alias("selection_score"),
        "verdict",
        F.coalesce("sources", F.lit(0)).alias("sources"),
        F.when(F.col("error").isNotNull(), "Error").otherwise("Done").alias("status"),
    )


def cascade_metrics(df: DataFrame, k: int, weight: float = BLEND_WEIGHT) -> DataFrame:
    """One row on the model-first, review-second cascade over (identity, label,
    model_prob, agent_score). The shortlist is at most k rows, whatever the input."""
    scope = df.agg(F.sum("label").alias("total_positives"), F.avg("label").alias("base_rate"))
    top = stage(model_top_k(df, k))
    half = F.greatest(F.lit(1), F.floor(F.col("size") / 2))
    size = top.agg(F.count(F.lit(1))).scalar()
    sized = top.withColumn("size", size)
    model = global_row_number(sized, [F.desc("model_prob"), F.asc("row_id")], "_m").filter(F.col("_m") <= half)
    agent = global_row_number(
        sized.filter("agent_score IS NOT NULL"), [F.desc("agent_score"), F.desc("model_prob"), F.asc("row_id")], "_a"
    ).filter(F.col("_a") <= half)
    blended = stage(blend(top, weight))
    series = {"model": "model_prob", "agent": "agent_score", "hybrid": "hybrid"}
    long = blended.select(
        "label",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).cast("double").alias("score")) for s, c in series.items()])
        ).alias("e"),
    ).select("label", "e.*")
    measured = stage(prediction_metrics(long, by=["series"]))
    found = {
        f"{m}_{s}": measured.filter(F.col("series") == s).agg(F.max(m)).scalar()
        for s in series
        for m in ("auc", "average_precision", "spearman")
    }
    counted = top.agg(
        F.count(F.lit(1)).alias("primary_top_k"),
        F.sum("label").alias("accepted_in_top_k"),
        F.count("agent_score").alias("agent_scored_in_top_k"),
    )
    out = counted.withColumns(
        {
            "total_positives": scope.select("total_positives").scalar(),
            "base_rate": scope.select("base_rate").scalar(),
            "agent_missing_in_top_k": F.col("primary_top_k") - F.col("agent_scored_in_top_k"),
            "precision_at_k": F.try_divide(F.col("accepted_in_top_k"), F.col("primary_top_k")),
            "top_half_precision_model": model.agg(F.avg("label")).scalar(),
            "top_half_precision_agent": agent.agg(F.avg("label")).scalar(),
            **found,
        }
    )
    recall = F.try_divide(F.col("accepted_in_top_k"), F.col("total_positives"))
    return out.withColumn("recall_at_k", F.coalesce(recall, F.lit(0.0)))


def portable_key(*columns: Column, seed: int) -> Column:
    """Pseudo-random sort key that any engine with md5 can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def stratified_sample(df: DataFrame, per_class: int = 15, seed: int = 42, label: str = "label", order: str = "row_id") -> DataFrame:
    """First row per identity, then ``per_class`` of each class in hash order."""
    first = df.groupBy("identity").agg(F.min(order).alias(order)).select(order)
    unique = df.join(first, order, "left_semi").withColumn("_k", portable_key(F.col("identity"), seed=seed))
    classes = [unique.filter(F.col(label) == c).orderBy("_k", order).limit(per_class) for c in (1, 0)]
    return classes[0].unionByName(classes[1]).drop("_k")


def sample_pools(pools: DataFrame, counts: dict[str, int], seed: int = 7, order: str = "row_id") -> DataFrame:
    """``counts[pool]`` rows of each pool in hash order."""
    keyed = pools.withColumn("_k", portable_key(F.col(order), seed=seed))
    parts = [keyed.filter(F.col("pool") == p).orderBy("_k", order).limit(n) for p, n in counts.items()]
    return reduce(DataFrame.unionByName, parts).drop("_k")
