"""Ranking, metric, blending and shortlist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.documents import idea_text
from ..operators import filters, ranking
from ..sources import roles as R
from . import register
from .role_sql import FULL, SCORED
from .similarity import IDEA_TEXT

CUT = 0.4


def _scored(spark, d):
    return R.scored(spark, d).withColumn("score", F.col("model_prob"))


def _rounded(df, *keep: str):
    """Doubles of derived measures at six digits, the rest as it is."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


def pct(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE) "
        f"/ count({column}) OVER () END"
    )


@register("rank_pct", f"""WITH {SCORED} SELECT row_id, round({pct("model_prob")}, 6) AS model_rank, round({pct("agent_score").replace("rank() OVER (ORDER BY agent_score)", "rank() OVER (ORDER BY agent_score NULLS LAST)")}, 6) AS agent_rank FROM scored""")
def rank_pct(spark, d):
    out = ranking.rank_pct(ranking.rank_pct(R.scored(spark, d), "model_prob", "model_rank"), "agent_score", "agent_rank")
    return _rounded(out.select("row_id", "model_rank", "agent_rank"))


@register("model_rank", f"WITH {SCORED} SELECT row_id, model_prob, row_number() OVER (ORDER BY model_prob DESC, row_id) AS model_rank FROM scored")
def model_rank(spark, d):
    return ranking.model_rank(R.scored(spark, d)).select("row_id", "model_prob", "model_rank")


_BEST = "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY identity ORDER BY model_prob DESC, row_id) = 1)"


@register("best_per_identity", f"WITH {SCORED}, {_BEST} SELECT row_id, identity, model_prob FROM best")
def best_per_identity(spark, d):
    return ranking.best_per_identity(R.scored(spark, d)).select("row_id", "identity", "model_prob")


@register("model_top_k", f"WITH {SCORED}, {_BEST} SELECT row_id, identity, model_prob FROM best ORDER BY model_prob DESC, row_id LIMIT 40")
def model_top_k(spark, d):
    return ranking.model_top_k(R.scored(spark, d), 40).select("row_id", "identity", "model_prob")


_RANKED = f"ranked AS (SELECT *, row_number() OVER (ORDER BY model_prob DESC, row_id) AS model_rank, CAST(model_prob >= {CUT} AS INTEGER) AS predicted_accepted FROM scored)"


def _ranked(spark, d):
    out = ranking.model_rank(R.scored(spark, d))
    return out.withColumn("predicted_accepted", (F.col("model_prob") >= CUT).cast("int"))


@register("primary_shortlist", f"WITH {SCORED}, {_RANKED} SELECT row_id, model_rank FROM ranked WHERE model_rank <= least(50, (SELECT sum(predicted_accepted) FROM ranked))")
def primary_shortlist(spark, d):
    return ranking.primary_shortlist(_ranked(spark, d), 50).select("row_id", "model_rank")


@register("combined_shortlist", f"""WITH {SCORED}, {_RANKED}, reviews AS (
  SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN round(value % 25, 1) END AS total_score, CASE WHEN event_type <> 'error' THEN event_type END AS verdict, user_id % 7 AS sources, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)
SELECT model_rank, CAST(row_id AS VARCHAR) AS identity, identity AS project_name, round(model_prob, 3) AS model_prob,
  CASE WHEN total_score IS NOT NULL THEN printf('%.1f', total_score) || '/25' ELSE 'N/A' END AS selection_score, verdict, coalesce(sources, 0) AS sources,
  CASE WHEN error IS NOT NULL THEN 'Error' ELSE 'Done' END AS status
FROM ranked LEFT JOIN reviews ON row_id = event_id WHERE model_rank <= 60""")
def combined_shortlist(spark, d):
    ranked = _ranked(spark, d).withColumns(
        {"project_name": F.col("identity"), "identity": F.col("row_id").cast("string"), "accept_probability": F.col("model_prob")}
    )
    reviews = R.read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("identity"),
        F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") % 25, 1)).alias("total_score"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("verdict"),
        (F.col("user_id") % 7).alias("sources"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    return ranking.combined_shortlist(ranked, reviews, 60)


# --- metrics -------------------------------------------------------------------------------

def confusion_sql(threshold: str) -> str:
    return f"""count(*) FILTER (s >= {threshold} AND y = 1) AS tp, count(*) FILTER (s >= {threshold} AND y = 0) AS fp,
  count(*) FILTER (s < {threshold} AND y = 1) AS fn, count(*) FILTER (s < {threshold} AND y = 0) AS tn"""


RATES = """round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(5 * tp::DOUBLE / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2, fn, round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0), 6) AS fn_rate,
  fp, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fp_rate"""
_SY = "sy AS (SELECT model_prob AS s, label AS y FROM scored)"


@register("confusion_metrics", f"WITH {SCORED}, {_SY}, c AS (SELECT {confusion_sql('0.4')} FROM sy) SELECT {RATES} FROM c")
def confusion_metrics(spark, d):
    return _rounded(ranking.confusion_metrics(_scored(spark, d), CUT))


SWEEP = f"""WITH {SCORED}, {_SY}, grid AS (SELECT round(0.05 + 0.025 * unnest(range(29)), 3)::DOUBLE AS threshold),
c AS (SELECT threshold, {confusion_sql("threshold")} FROM grid, sy GROUP BY 1), sweep AS (SELECT threshold, {RATES} FROM c)"""


@register("threshold_sweep", f"{SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return _rounded(ranking.threshold_sweep(_scored(spark, d)))


@register("pick_threshold", f"{SWEEP} SELECT * FROM sweep ORDER BY recall >= 0.85 DESC, f2 DESC, recall DESC, threshold LIMIT 1")
def pick_threshold(spark, d):
    return _rounded(ranking.pick_threshold(ranking.threshold_sweep(_scored(spark, d))))


def metric_ctes(series: str) -> str:
    """CTEs measuring a relation ``series(key, s, y)`` per key."""
    return f"""pairs AS (SELECT * FROM ({series}) WHERE s IS NOT NULL AND y IS NOT NULL),
g AS (SELECT key, s, count(*) AS n, sum(y) AS pos FROM pairs GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY key) AS rows_, sum(pos) OVER (PARTITION BY key) AS p, count(*) OVER (PARTITION BY key) AS scores,
  sum(n) OVER (PARTITION BY key ORDER BY s) - n AS nb, sum(pos) OVER (PARTITION BY key ORDER BY s) - pos AS pb FROM g),
m AS (SELECT key, CAST(any_value(rows_) AS BIGINT) AS rows, CAST(any_value(p) AS BIGINT) AS positives,
  CASE WHEN any_value(rows_) >= 3 AND any_value(p) > 0 AND any_value(p) < any_value(rows_) AND any_value(scores) > 1 THEN 1 END AS ok,
  sum(pos * (nb - pb + (n - pos) / 2.0::DOUBLE)) / nullif(any_value(p) * (any_value(rows_) - any_value(p)), 0) AS auc0,
  sum(pos * (p - pb)::DOUBLE / (rows_ - nb)) / nullif(any_value(p), 0) AS ap0 FROM w GROUP BY 1),
r AS (SELECT key, y, rank() OVER (PARTITION BY key ORDER BY s) + (count(*) OVER (PARTITION BY key, s) - 1) / 2.0::DOUBLE AS rk FROM pairs),
sp AS (SELECT key, corr(rk, y) AS sp0 FROM r GROUP BY 1),
measured AS (SELECT m.key, rows, positives, round(CASE WHEN ok = 1 THEN auc0 END, 6) AS auc, round(CASE WHEN ok = 1 THEN ap0 END, 6) AS average_precision,
  round(CASE WHEN ok = 1 THEN sp0 END, 6) AS spearman FROM m JOIN sp ON m.key = sp.key)"""


_MODEL = "SELECT 0 AS key, model_prob AS s, label AS y FROM scored"
_AGENT = "SELECT 0 AS key, agent_score AS s, label AS y FROM scored"


@register("roc_auc", f"WITH {SCORED}, {metric_ctes(_MODEL)} SELECT auc FROM measured")
def roc_auc(spark, d):
    return _rounded(ranking.prediction_metrics(_scored(spark, d)).select("auc"))


@register("average_precision", f"WITH {SCORED}, {metric_ctes(_MODEL)} SELECT average_precision FROM measured")
def average_precision(spark, d):
    return _rounded(ranking.prediction_metrics(_scored(spark, d)).select("average_precision"))


@register("spearman", f"WITH {SCORED}, {metric_ctes(_MODEL)} SELECT spearman FROM measured")
def spearman(spark, d):
    return _rounded(ranking.prediction_metrics(_scored(spark, d)).select("spearman"))


@register("prediction_metrics", f"WITH {SCORED}, {metric_ctes(_AGENT)} SELECT rows, positives, auc, average_precision, spearman FROM measured")
def prediction_metrics(spark, d):
    return _rounded(ranking.prediction_metrics(_scored(spark, d), "agent_score"))


_RANKS = f"""ranks AS (SELECT *, {pct("model_prob")} AS model_rank, {pct("agent_score").replace("ORDER BY agent_score)", "ORDER BY agent_score NULLS LAST)")} AS agent_rank FROM scored)"""


@register("blend_scores", f"WITH {SCORED}, {_RANKS} SELECT row_id, round(0.6 * model_rank + 0.4 * agent_rank, 6) AS hybrid FROM ranks")
def blend_scores(spark, d):
    return _rounded(ranking.blend(R.scored(spark, d)).select("row_id", "hybrid"))


_WEIGHTED = "SELECT w::DOUBLE AS key, round(w * model_rank + (1 - w) * agent_rank, 12) AS s, label AS y FROM ranks, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)"


@register("weight_sweep", f"WITH {SCORED}, {_RANKS}, {metric_ctes(_WEIGHTED)} SELECT key AS weight, auc FROM measured")
def weight_sweep(spark, d):
    return _rounded(ranking.weight_sweep(ranking.blend(R.scored(spark, d))), "weight")


_TOP = f"{_BEST}, top AS (SELECT * FROM best ORDER BY model_prob DESC, row_id LIMIT 60)"
_TOP_RANKS = f"""tranks AS (SELECT *, {pct("model_prob")} AS model_rank, {pct("agent_score").replace("ORDER BY agent_score)", "ORDER BY agent_score NULLS LAST)")} AS agent_rank FROM top)"""
_SERIES = """SELECT 'model' AS key, model_prob AS s, label AS y FROM tranks UNION ALL SELECT 'agent', agent_score, label FROM tranks
  UNION ALL SELECT 'hybrid', round(0.6 * model_rank + 0.4 * agent_rank, 12), label FROM tranks"""
_FOUND = ", ".join(
    f"(SELECT {m} FROM measured WHERE key = '{s}') AS {m}_{s}"
    for s in ("model", "agent", "hybrid")
    for m in ("auc", "average_precision", "spearman")
)


@register("cascade_metrics", f"""WITH {SCORED}, {_TOP}, {_TOP_RANKS}, {metric_ctes(_SERIES)},
half AS (SELECT greatest(1, count(*) // 2) AS h FROM top),
mh AS (SELECT avg(label) AS v FROM (SELECT label, row_number() OVER (ORDER BY model_prob DESC, row_id) AS rn FROM top), half WHERE rn <= h),
ah AS (SELECT avg(label) AS v FROM (SELECT label, row_number() OVER (ORDER BY agent_score DESC, model_prob DESC, row_id) AS rn FROM top WHERE agent_score IS NOT NULL), half WHERE rn <= h)
SELECT count(*) AS primary_top_k, CAST(sum(label) AS BIGINT) AS accepted_in_top_k, count(agent_score) AS agent_scored_in_top_k, count(*) - count(agent_score) AS agent_missing_in_top_k,
  (SELECT CAST(sum(label) AS BIGINT) FROM scored) AS total_positives, round((SELECT avg(label) FROM scored), 6) AS base_rate,
  round(sum(label)::DOUBLE / count(*), 6) AS precision_at_k, round(sum(label)::DOUBLE / (SELECT sum(label) FROM scored), 6) AS recall_at_k,
  round((SELECT v FROM mh), 6) AS top_half_precision_model, round((SELECT v FROM ah), 6) AS top_half_precision_agent, {_FOUND} FROM top""")
def cascade_metrics(spark, d):
    return _rounded(ranking.cascade_metrics(R.scored(spark, d), 60))


_FIRST = "uniq AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY identity ORDER BY row_id) = 1)"


@register("stratified_sample", f"""WITH {SCORED}, {_FIRST} SELECT row_id, identity, label FROM uniq
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || identity), row_id) <= 15""")
def stratified_sample(spark, d):
    return ranking.stratified_sample(R.scored(spark, d)).select("row_id", "identity", "label")


@register("sample_ideas", f"""WITH {FULL}, pools AS (SELECT *, 'en' AS pool FROM full_apps WHERE problem_en IS NOT NULL AND solution_en IS NOT NULL
  UNION ALL SELECT *, 'ar' FROM full_apps WHERE regexp_matches(problem, '[À-ÿ]') AND solution IS NOT NULL),
picked AS (SELECT * FROM pools WHERE year IN (1997, 1998) QUALIFY row_number() OVER (PARTITION BY pool ORDER BY md5('7|' || row_id), row_id) <= CASE pool WHEN 'en' THEN 10 ELSE 5 END)
SELECT row_id, pool, {IDEA_TEXT} AS text FROM picked""")
def sample_ideas(spark, d):
    scoped = filters.scope_years(R.full_applicants(spark, d), (1997, 1998))
    picked = ranking.sample_pools(filters.idea_pools(scoped, R.ACCENT_SCRIPT), {"en": 10, "ar": 5})
    return picked.select("row_id", "pool", idea_text(picked).alias("text"))


@register("agent_lookup", f"""WITH {SCORED}, cache AS (SELECT identity, max(agent_score) AS score FROM scored GROUP BY 1)
SELECT row_id, score AS agent_score FROM scored LEFT JOIN cache USING (identity)""")
def agent_lookup(spark, d):
    scored = R.scored(spark, d)
    cache = scored.groupBy("identity").agg(F.max("agent_score").alias("score"))
    return ranking.with_agent_score(scored.drop("agent_score"), cache).select("row_id", "agent_score")
