"""Splitting, training, resampling and scoring queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as K
from ..operators import learning as M
from ..operators import neighbours as N
from ..operators.staged import Space
from ..operators.staged import experiments as tried
from ..operators.staged import staged_search as search
from ..session import stage
from ..sources import roles as R
from . import register
from .role_sql import APPS, SCORED

GROUPS = """groups AS (SELECT identity, max(label) AS y FROM scored GROUP BY 1),
ranks AS (SELECT identity, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || identity), identity) AS rank, count(*) OVER (PARTITION BY y) AS size FROM groups)"""


def _labelled(spark, d):
    return R.scored(spark, d).withColumnRenamed("label", "y")


@register("group_split", f"WITH {SCORED}, {GROUPS} SELECT row_id, rank <= round(size * 0.2::DOUBLE) AS is_test FROM scored JOIN ranks USING (identity)")
def group_split(spark, d):
    return M.group_split(_labelled(spark, d)).select("row_id", "is_test")


@register("fold_ids", f"WITH {SCORED}, {GROUPS} SELECT row_id, CAST(rank % 5 AS INTEGER) AS fold FROM scored JOIN ranks USING (identity)")
def fold_ids(spark, d):
    return M.fold_ids(_labelled(spark, d)).select("row_id", "fold")


@register("undersample", f"""WITH {SCORED} SELECT row_id, label AS y FROM scored WHERE label = 1 UNION ALL
SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS rn FROM scored WHERE label = 0)
WHERE rn <= (SELECT count(*) FROM scored WHERE label = 1)""")
def undersample(spark, d):
    return M.undersample(_labelled(spark, d).select("row_id", "y"))


NUMERIC = [c for c in K.NUMERIC["base"] if c != "name_len"]
CATEGORICAL = ["cohort_f", "nationality_bin", "stage_f", "age_group_f"]


def _base(spark, d):
    """Applications with the demographic, registration and stage features, written once."""
    df = R.applications(spark, d)
    key = F.col("row_id")
    df = df.withColumns(
        {
            "gender": R.cycle(key, ("Female", "Male")), "how_heard": F.lit("Email"),
            "prior_program_experience": R.cycle(key, ("Yes", "No")), "previous_participant": R.cycle(key, ("No", "Yes")),
            "previous_participant_year": F.when(key % 4 == 0, (1990 + key % 12).cast("string")),
            "in_two_cohorts": (key % 8 == 0).cast("int"), "sector_raw": F.col("Sector"), "stage_raw": F.col("Business Stage"),
            "project_name": F.col("applicant_name"),
        }
    )
    for step in (K.feat_identity, K.feat_demographic, K.feat_registration, K.feat_stage):
        df = step(df)
    return stage(M.model_input(df, NUMERIC, CATEGORICAL))


def _prepare():
    return M.preprocessor(NUMERIC, CATEGORICAL)


def _logistic(seed: int = M.SEED):
    return M.make_model("logistic", {"maxIter": 10}, seed=seed)


@register("preprocess")
def preprocess(spark, d):
    df = _base(spark, d)
    ready = _prepare().fit(df).transform(df)
    return ready.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@register("train_score")
def train_score(spark, d):
    split = stage(M.group_split(_base(spark, d)))
    model = M.fit(split.filter("NOT is_test"), _prepare(), M.make_model("forest", {"numTrees": 10, "maxDepth": 4}))
    return M.probabilities(split.filter("is_test"), model)


@register("score_table")
def score_table(spark, d):
    split = stage(M.group_split(_base(spark, d)))
    model = M.fit(split.filter("NOT is_test"), _prepare(), _logistic())
    return M.score_table(split.filter("is_test"), model)


@register("oof_scores")
def oof_scores(spark, d):
    return M.out_of_fold(_base(spark, d), _prepare, _logistic, k=3).select("row_id", "y", "prob")


NEAR = "round(list_distance(a.v, b.v), 9)"


@register("nearest_neighbours", f"""WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id, row_number() OVER w AS place, b.id AS neighbour, {NEAR} AS distance
FROM p a JOIN p b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY {NEAR}, b.id) QUALIFY place <= 5""")
def nearest_neighbours(spark, d):
    return N.nearest_neighbours(R.idea_vectors(spark, d).select(F.col("row_index").alias("id"), "vec"), 5)


@register("smote", f"""WITH {SCORED}, p AS (SELECT row_id, CAST(model_prob < 0.3 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v FROM scored JOIN embeddings ON row_id = vec_id),
few AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM p WHERE y = 1),
near AS (SELECT a.row_id, b.row_id AS neighbour, b.v AS u, row_number() OVER w AS place, count(*) OVER (PARTITION BY a.row_id) AS others
  FROM few a JOIN few b ON a.row_id <> b.row_id WINDOW w AS (PARTITION BY a.row_id ORDER BY {NEAR}, b.row_id) QUALIFY place <= 5),
size AS (SELECT count(*) FILTER (y = 1) AS few, greatest(count(*) FILTER (y = 0) - count(*) FILTER (y = 1), 0) AS gap FROM p),
made AS (SELECT row_id, v, unnest(range(1, gap // few + CAST(n <= gap % few AS BIGINT) + 1)) AS copy FROM few, size),
drawn AS (SELECT *, CAST('0x' || substr(m, 1, 8) AS BIGINT) AS pick, CAST('0x' || substr(m, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS weight
  FROM (SELECT *, md5('42|' || row_id || '|' || copy) AS m FROM made))
SELECT row_id, y, NULL AS base, NULL AS copy, NULL AS neighbour, NULL AS weight, list_transform(v, lambda x: round(x, 6)) AS features FROM p
UNION ALL SELECT NULL, 1, row_id, CAST(copy AS INTEGER), neighbour, round(weight, 9), list_transform(range(1, len(v) + 1), lambda i: round(v[i] + (u[i] - v[i]) * weight, 6))
FROM drawn JOIN near USING (row_id) WHERE place = pick % least(others, 5) + 1""")
def smote(spark, d):
    vectors = R.idea_vectors(spark, d).withColumnRenamed("row_index", "row_id")
    labelled = _labelled(spark, d).join(vectors, "row_id").withColumn("y", (F.col("model_prob") < 0.3).cast("int"))
    points = M.smote(labelled.select("row_id", "y", F.col("vec").cast("array<double>").alias("features")))
    values = F.transform(vector_to_array("features"), lambda x: F.round(x, 6))
    return points.select("row_id", "y", "base", "copy", "neighbour", F.round("weight", 9).alias("weight"), values.alias("features"))


@register("bagged_scores")
def bagged_scores(spark, d):
    split = stage(M.group_split(_base(spark, d)))
    model = lambda seed: M.make_model("forest", {"numTrees": 5, "maxDepth": 3}, seed=seed)
    return M.bagged(split.filter("NOT is_test"), split.filter("is_test"), _prepare, model, (42, 43))


# The columns of _base by the step that makes them: each set adds some to the demographic ones.
_DEMOGRAPHIC = ["age", "team_member_count_num", "app_year", "age_missing_flag", "team_missing_flag"]
_REGISTRATION = ["cr", "cr_and_team", "in_two_cohorts", "prev_year_recency", "prev_year_missing_flag"]
_STAGE_MARKS = ["stage_maturity", "sector_missing_flag", "stage_missing_flag"]


@register("experiments")
def experiments(spark, d):
    """Families, feature sets, imputation with scaling, drawn parameters, resampling and averaged seeds; the best is marked."""
    space = Space(
        feature_sets={
            "demographic": _DEMOGRAPHIC, "demographic_registration": _DEMOGRAPHIC + _REGISTRATION,
            "demographic_stage": _DEMOGRAPHIC + _STAGE_MARKS, "full": NUMERIC,
        },
        categorical=CATEGORICAL,
        families={"logistic": {"maxIter": 5}, "forest": {"numTrees": 10, "maxDepth": 4}, "boosted": {"maxIter": 5}},
        choices={"boosted": {"maxIter": [3, 5, 8], "stepSize": [0.02, 0.05, 0.1], "maxDepth": [3, 4, 5], "subsamplingRate": [0.7, 0.85, 1.0]}},
    )
    return tried(_base(spark, d), space, k=2)


@register("staged_search")
def staged_search(spark, d):
    """State of a small search; tests recompute its measures in SQL from the scores."""
    space = Space(
        feature_sets={"base": NUMERIC[:6], "full": NUMERIC}, categorical=CATEGORICAL[:2], families={"logistic": {"maxIter": 4}}, booster="logistic",
        imputes=("median",), scales=("standard", "minmax"), choices={"logistic": {"regParam": [0.0, 0.01, 0.1], "maxIter": [3, 6]}}, draws=2,
        samples=("under",), bag_seeds=(42, 7),
    )
    return search(_base(spark, d), space, k=2).state


# --- models that SQL repeats: transform, train, score, rank -----------------------------------

_SIZE = "TRY_CAST(CASE WHEN team_member_count = '5+' THEN '6' ELSE team_member_count END AS DOUBLE)"
_AGE = "year - CAST(year(TRY_CAST(date_of_birth AS DATE)) AS INTEGER)"
_RECENT = "CASE WHEN row_id % 4 = 0 AND year IS NOT NULL THEN greatest(0, year - (1990 + row_id % 12)) END"
_STAGE = "coalesce(\"Business Stage\", 'Not Specified')"
_CR = "CAST(coalesce(has_commercial_registration = 'Yes', false) AS INTEGER)"
_VALUES = {
    "age": _AGE, "team_member_count_num": _SIZE, "app_year": "year",
    "stage_maturity": f"CASE {_STAGE} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.STAGE_MATURITY.items()) + " ELSE -1 END",
    "cr": _CR, "cr_and_team": f"{_CR} * CAST(coalesce(individual_or_team = 'Team', false) AS INTEGER)", "in_two_cohorts": "CAST(row_id % 8 = 0 AS INTEGER)",
    "prev_year_recency": _RECENT, "age_missing_flag": f"CAST({_AGE} IS NULL AS INTEGER)", "team_missing_flag": f"CAST({_SIZE} IS NULL AS INTEGER)",
    "sector_missing_flag": 'CAST("Sector" IS NULL AS INTEGER)', "stage_missing_flag": 'CAST("Business Stage" IS NULL AS INTEGER)',
    "prev_year_missing_flag": "CAST(row_id % 4 <> 0 AS INTEGER)",
}
_LEVELS = {
    "cohort_f": "coalesce(cohort, 'Unknown')", "nationality_bin": "CASE WHEN nationality = 'Bahrain' THEN 'Bahrain' ELSE 'Other' END",
    "stage_f": _STAGE, "age_group_f": "coalesce(\"Age Group\", 'Not Specified')",
}
_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
# f: labelled rows; u and l: their numbers and levels, a row each
_FEATURES = f"""{APPS}, f AS (SELECT *, coalesce(applicant_name, '') || '|' || coalesce(date_of_birth, '') AS identity, CAST(coalesce(outcome_clean = 'Accepted', false) AS INTEGER) AS y FROM apps),
u AS (SELECT row_id, unnest({_names(NUMERIC)}) AS slot, unnest([{", ".join(f"CAST({_VALUES[n]} AS DOUBLE)" for n in NUMERIC)}]) AS v FROM f),
l AS (SELECT row_id, unnest({_names(CATEGORICAL)}) AS col, unnest([{", ".join(_LEVELS[n] for n in CATEGORICAL)}]) AS level FROM f),
g AS (SELECT identity, max(y) AS y FROM f GROUP BY 1),
r AS (SELECT identity, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || identity), identity) AS rank, count(*) OVER (PARTITION BY y) AS size FROM g)"""
# part: (m, row_id, held), the training and held rows of each model m; p: the probabilities of held rows
_BAYES = f"""st AS (SELECT m, slot, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM u JOIN part USING (row_id) WHERE NOT held GROUP BY ALL),
known AS (SELECT DISTINCT m, col, level FROM l JOIN part USING (row_id) WHERE NOT held),
x AS (SELECT m, row_id, held, slot, CASE WHEN hi = lo THEN 0.5 ELSE (coalesce(v, mean) - lo) / (hi - lo) END AS x FROM u JOIN part USING (row_id) JOIN st USING (m, slot)
  UNION ALL SELECT m, row_id, held, col || '=' || coalesce(known.level, '?'), 1.0 FROM l JOIN part USING (row_id) LEFT JOIN known USING (m, col, level)),
slots AS (SELECT DISTINCT m, slot FROM st UNION SELECT m, col || '=' || level FROM known UNION SELECT DISTINCT m, col || '=?' FROM known),
width AS (SELECT m, count(*) AS slots FROM slots GROUP BY 1),
sizes AS (SELECT m, greatest(count(*) FILTER (y = 0), 1) / greatest(count(*) FILTER (y = 1), 1) AS heavy FROM f JOIN part USING (row_id) WHERE NOT held GROUP BY 1),
w AS (SELECT m, row_id, y, CASE WHEN y = 1 THEN heavy ELSE 1.0 END AS w FROM f JOIN part USING (row_id) JOIN sizes USING (m) WHERE NOT held),
prior AS (SELECT m, y, ln((sum(w) + 1) / (sum(sum(w)) OVER (PARTITION BY m) + 2)) AS pi FROM w GROUP BY m, y),
mass AS (SELECT m, y, slot, sum(w * x) AS s FROM w JOIN x USING (m, row_id) GROUP BY ALL),
whole AS (SELECT m, y, sum(s) AS s FROM mass GROUP BY ALL),
coef AS (SELECT m, y, slot, ln((coalesce(mass.s, 0) + 1) / (whole.s + slots)) AS c FROM slots JOIN width USING (m) JOIN whole USING (m) LEFT JOIN mass USING (m, y, slot)),
sums AS (SELECT m, row_id, y, sum(x * c) AS s FROM x JOIN coef USING (m, slot) WHERE held GROUP BY ALL),
p AS (SELECT row_id, 1 / (1 + exp(sum(CASE WHEN y = 0 THEN s + pi ELSE -s - pi END))) AS prob FROM sums JOIN prior USING (m, y) GROUP BY row_id)"""
_HELD = "part AS (SELECT 0 AS m, row_id, rank <= round(size * 0.2::DOUBLE) AS held FROM f JOIN r USING (identity))"


def _counted():
    return M.preprocessor(NUMERIC, CATEGORICAL, "mean", "minmax")


def _bayes():
    return M.make_model("bayes")


@register("preprocess_minmax", f"""WITH {_FEATURES}, st AS (SELECT slot, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1),
x AS (SELECT row_id, slot, CASE WHEN hi = lo THEN 0.5 ELSE (coalesce(v, mean) - lo) / (hi - lo) END AS x, list_position({_names(NUMERIC)}, slot) AS place FROM u JOIN st USING (slot)),
n AS (SELECT row_id, list(round(x, 6) ORDER BY place) AS features FROM x GROUP BY 1),
k AS (SELECT col, list(level ORDER BY n DESC, level) || ['?'] AS levels FROM (SELECT col, level, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT row_id, flatten(list(list_transform(levels, lambda z: CAST(z = level AS INTEGER)::DOUBLE) ORDER BY list_position({_names(CATEGORICAL)}, col))) AS hot FROM l JOIN k USING (col) GROUP BY 1)
SELECT row_id, features || hot AS features FROM n JOIN h USING (row_id)""")
def preprocess_minmax(spark, d):
    df = _base(spark, d)
    ready = _counted().fit(df).transform(df)
    return ready.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@register("bayes_scores", f"WITH {_FEATURES}, {_HELD}, {_BAYES} SELECT row_id, round(prob, 6) AS prob FROM p")
def bayes_scores(spark, d):
    split = stage(M.group_split(_base(spark, d)))
    model = M.fit(split.filter("NOT is_test"), _counted(), _bayes())
    return M.probabilities(split.filter("is_test"), model).withColumn("prob", F.round("prob", 6))


@register("bayes_oof", f"""WITH {_FEATURES}, part AS (SELECT m, row_id, rank % 3 = m AS held FROM f JOIN r USING (identity), (SELECT unnest(range(3)) AS m)), {_BAYES}
SELECT row_id, y, round(prob, 6) AS prob FROM p JOIN f USING (row_id)""")
def bayes_oof(spark, d):
    scores = M.out_of_fold(_base(spark, d), _counted, _bayes, k=3)
    return scores.select("row_id", "y", F.round("prob", 6).alias("prob"))


@register("bayes_table", f"""WITH {_FEATURES}, {_HELD}, {_BAYES}, q AS (SELECT row_id, identity, y, round(prob, 9) AS q FROM p JOIN f USING (row_id))
SELECT row_id, identity, y, round(q, 6) AS accept_probability, CAST(q >= 0.5 AS INTEGER) AS predicted_accepted, 0.5::DOUBLE AS prediction_threshold, row_number() OVER (ORDER BY q DESC, row_id) AS model_rank FROM q""")
def bayes_table(spark, d):
    split = stage(M.group_split(_base(spark, d)))
    model = M.fit(split.filter("NOT is_test"), _counted(), _bayes())
    table = M.score_table(split.filter("is_test"), model, 0.5)
    return table.withColumn("accept_probability", F.round("accept_probability", 6))
