"""Ranking metrics, rubric, features, splits and training."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as K
from cohortlens.operators import learning as M
from cohortlens.operators import ordering, ranking, rubric


def scored(spark, rows):
    return spark.createDataFrame(rows, "row_id long, identity string, label int, model_prob double, agent_score double")


def test_running_sums_and_row_numbers(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.permutation(500)]
    df = spark.createDataFrame([(v, v % 7) for v in values], "k long, n long").repartition(6)
    got = ordering.running_sums(df, [F.asc("k")], ["n"]).orderBy("k").collect()
    total = 0
    for r in got:
        assert r.n_before == total
        total += r.n
    numbered = ordering.global_row_number(df, [F.desc("k")], "pos").collect()
    assert {(r.k, r.pos) for r in numbered} == {(k, 500 - k) for k in range(500)}


def plain_metrics(pairs):
    n, p = len(pairs), sum(y for _, y in pairs)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z)
    ap = tp = seen = 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        hits = sum(y for t, y in pairs if t == s)
        tp, seen = tp + hits, seen + sum(1 for t, _ in pairs if t == s)
        ap += hits / p * tp / seen
    ranks = [sum(t < s for t, _ in pairs) + (sum(t == s for t, _ in pairs) + 1) / 2 for s, _ in pairs]
    return wins / (p * (n - p)), ap, np.corrcoef(ranks, [y for _, y in pairs])[0, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_equal_their_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(float(rng.integers(0, 8)) / 8, int(rng.random() < 0.4)) for _ in range(60)]
    got = ranking.prediction_metrics(spark.createDataFrame(pairs, "score double, label int")).first()
    assert (got.auc, got.average_precision, got.spearman) == pytest.approx(plain_metrics(pairs))


def test_metric_guards(spark):
    few = spark.createDataFrame([(0.9, 1), (None, 0), (0.2, 1), (None, 0), (0.1, 0)], "score double, label int")
    assert ranking.prediction_metrics(few).first().auc == 1.0
    for rows in ([(0.1, 1), (0.2, 0)], [(0.1, 1), (0.2, 1), (0.3, 1)], [(0.1, 1), (0.1, 0), (0.1, 0)]):
        assert ranking.prediction_metrics(spark.createDataFrame(rows, "score double, label int")).first().auc is None


def test_blend_and_cascade(spark):
    df = scored(spark, [(1, "a", 1, 0.9, 40.0), (2, "b", 0, 0.6, 60.0), (3, "c", 1, 0.4, 55.0), (4, "d", 0, 0.1, 35.0)])
    got = ranking.cascade_metrics(df, 4).first()
    assert (got.precision_at_k, got.recall_at_k, got.agent_scored_in_top_k, got.agent_missing_in_top_k) == (0.5, 1.0, 4, 0)
    assert got.top_half_precision_model == 0.5 and got.auc_model == 0.75
    order = scored(spark, [(1, "a", 1, 0.9, 70.0), (2, "b", 1, 0.8, 60.0), (3, "c", 0, 0.4, 50.0), (4, "d", 0, 0.1, 40.0)])
    assert {r.auc for r in ranking.weight_sweep(ranking.blend(order)).collect()} == {1.0}
    ties = scored(spark, [(1, "a", 1, 0.5, None), (2, "b", 1, 0.5, 1.0), (3, "c", 0, 0.9, 2.0)])
    ranks = {r.row_id: (r.model_rank, r.agent_rank) for r in ranking.blend(ties).collect()}
    assert ranks[1] == (0.5, None) and ranks[3] == (1.0, 1.0)


def test_shortlists(spark):
    df = scored(spark, [(1, "a", 1, 0.4, None), (2, "a", 1, 0.9, None), (3, "b", 0, 0.7, None), (4, "c", 0, 0.1, None)])
    assert [r.row_id for r in ranking.model_top_k(df, 2).collect()] == [2, 3]
    ranked = ranking.model_rank(df).withColumn("predicted_accepted", (F.col("model_prob") >= 0.7).cast("int"))
    assert {r.row_id for r in ranking.primary_shortlist(ranked, 3).collect()} == {2, 3}
    named = ranked.withColumns({"project_name": F.col("identity"), "accept_probability": F.col("model_prob"), "identity": F.col("row_id").cast("string")})
    reviews = spark.createDataFrame([("2", 19.0, "Strong", 3, None), ("3", None, None, None, "timeout")], "identity string, total_score double, verdict string, sources int, error string")
    rows = ranking.combined_shortlist(named, reviews, 2).orderBy("model_rank").collect()
    assert [(r.selection_score, r.verdict, r.sources, r.status) for r in rows] == [("19.0/25", "Strong", 3, "Done"), ("N/A", None, 0, "Error")]
    twice = scored(spark, [(i, f"p{i % 8}", i % 2, 0.1, None) for i in range(16)])
    picked = ranking.stratified_sample(twice, 2).collect()
    assert len(picked) == 4 and len({r.identity for r in picked}) == 4 and sum(r.label for r in picked) == 2


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.35, 0), (0.1, 0)], "score double, label int")
    sweep = ranking.threshold_sweep(df)
    assert sweep.count() == 29 and ranking.pick_threshold(sweep).first().threshold == 0.375
    none = ranking.confusion_metrics(df, 0.95).first()
    assert (none.precision, none.recall, none.f2, none.fn) == (0.0, 0.0, 0.0, 2)


# --- rubric -------------------------------------------------------------------------------

def flat_scores(spark, rows):
    return spark.createDataFrame([(1, i, n, s, "why") for i, (n, s) in enumerate(rows)], "review_id long, slot int, dimension string, score string, rationale string")


def test_scores(spark):
    given = zip([c.name for c in rubric.DEFAULT_CRITERIA], ["4", "4", "3", "4", "3"])
    got = rubric.score_payloads(flat_scores(spark, list(given))).first()
    assert (got.total_score, got.verdict) == (18.0, "Promising")
    two = [rubric.Criterion("Alpha", "", 0.75), rubric.Criterion("Beta", "", 0.25)]
    assert rubric.score_payloads(flat_scores(spark, [("ALPHA!", "4"), ("beta", "2"), ("Beta", "5")]), two).first().total_score == 17.5
    odd = rubric.score_payloads(flat_scores(spark, [("alpha", "9"), ("gamma", "x")]), two).first()
    assert odd.dimensions[0].score == 5.0 and odd.dimensions[1].rationale == rubric.MISSING_DIMENSION


@pytest.mark.parametrize(
    "text, json",
    [('```json\n{"a":{"b":1}}\n```', '{"a":{"b":1}}'), ('x {"a": "}\\"{"} y }', '{"a": "}\\"{"}'), ("{broken", None), ('{"a": "open', None), ("none", None), (None, None), ("{bad}", None)],
)
def test_extract_json(spark, text, json):
    assert spark.createDataFrame([(text,)], "t string").select(rubric.extract_json(F.col("t"))).first()[0] == json


def test_answers_to_scores(spark):
    text = '{"dimensions": {"Feasibility": {"score": 3.26, "rationale": " ok ", "evidence": ["a", "b"]}, "Market Potential": 4}}'
    df = spark.createDataFrame([(1, text), (2, '{"dimensions": {}}')], "review_id long, j string")
    got = {r.review_id: r for r in rubric.score_payloads(rubric.payload_dimensions(df, "j", "review_id")).collect()}
    by_name = {x.name: x for x in got[1].dimensions}
    assert by_name["Feasibility"].score == 3.3 and by_name["Feasibility"].evidence == ["a", "b"] and by_name["Feasibility"].rationale == "ok"
    assert by_name["Market Potential"].score == 0.0 and got[2].total_score == 0.0 and got[2].verdict == "Weak"


def crit(spark, rows):
    return spark.createDataFrame([(i + 1, n, None, w) for i, (n, w) in enumerate(rows)], "position int, name string, guidance string, weight string")


def test_criteria(spark, tmp_path):
    weights = [r.weight for r in rubric.normalise_weights(crit(spark, [("a", "2"), ("b", "1"), (" ", "9")])).orderBy("position").collect()]
    assert weights == [0.666667, 0.333333]
    assert {r.weight for r in rubric.normalise_weights(crit(spark, [("a", "0"), ("b", "-1")])).collect()} == {0.5}

    def verdict(rows):
        return tuple(rubric.validate_criteria(crit(spark, rows)).first())

    assert verdict([("a", "0.5")]) == (True, "")
    assert verdict([])[1] == "Add at least one selection criterion."
    assert verdict([("a", "1.5")])[1] == "Row 1: 'a' weight must be between 0% and 100%."
    assert verdict([("a", "0.1"), ("A", "0.1")])[1] == "Row 2: duplicate criterion 'A'."
    assert not verdict([("a", "NaN")])[0] and not verdict([("a", "x")])[0] and not verdict([(" ", "0.1")])[0]
    assert rubric.load_criteria() == list(rubric.DEFAULT_CRITERIA)
    assert rubric.load_criteria(str(tmp_path / "none.json"), spark) == list(rubric.DEFAULT_CRITERIA)
    rubric.save_criteria(crit(spark, [("a", "3"), ("b", "1")]), str(tmp_path / "c.json"))
    loaded = rubric.load_criteria(spark.read.json(str(tmp_path / "c.json")))
    assert sorted((c.name, c.weight) for c in loaded) == [("a", 0.75), ("b", 0.25)]


# --- features and models ----------------------------------------------------------------------

def test_registry():
    numeric, categorical = K.feature_set("base_criteria")
    assert (len(numeric), len(categorical)) == (104, 14) and len(set(numeric)) == 104
    assert list(K.keyword_columns(["a b", "a-b", "c"])) == ["kw_a_b", "kw_a_b_2", "kw_c"]


def test_engineered_columns(spark):
    from cohortlens.sources import roles as R

    folder = "/root/testdata/sf0.001"
    raw = R.full_applicants(spark, folder)
    frequency = K.keyword_frequency(raw)
    top = K.top_keywords(frequency)
    out = K.engineer_features(raw, frequency=frequency, top=top)
    numeric, categorical = K.feature_set("full", top)
    assert not set(numeric + categorical) - set(out.columns)
    plan = out.select(*numeric)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert out.select("row_id").count() == raw.select("row_id").count()


def test_fitted_vocabulary_is_used(spark):
    train = spark.createDataFrame([(1, "a; b"), (2, "a, uncategorized")], "row_id long, keywords string")
    batch = spark.createDataFrame([(9, "A;z"), (10, None)], "row_id long, keywords string")
    frequency = K.keyword_frequency(train)
    got = {r.row_id: r for r in K.feat_keywords(batch, frequency=frequency, top=K.top_keywords(frequency)).collect()}
    assert (got[9].kw_mean_freq, got[9].kw_min_freq, got[9].kw_a, got[9].kw_b) == (1.0, 0, 1, 0)
    assert (got[10].keyword_count, got[10].kw_mean_freq) == (0, 0.0)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"p{i // 2}", int(rng.random() < 0.3), float(rng.normal()), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, identity string, y int, x double, c string")
    return df.withColumn("x", F.when(F.col("row_id") % 9 != 0, F.col("x") + F.col("y") * 2))


def test_splits(people):
    split = M.group_split(people).groupBy("identity").agg(F.count_distinct("is_test").alias("n"), F.first("is_test").alias("t"))
    got = split.collect()
    assert all(r.n == 1 for r in got) and sum(r.t for r in got) == pytest.approx(30, abs=1)
    folds = M.fold_ids(people, 3)
    assert folds.groupBy("identity").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 4


def test_training(people):
    prepare = lambda: M.preprocessor(["x"], ["c"])
    data = M.model_input(people, ["x"], ["c"])
    scores = M.fold_scores(data, prepare, lambda: M.make_model("logistic", {"maxIter": 10}), 2)
    assert scores.count() == 300
    auc = ranking.prediction_metrics(scores, "prob", "y").first().auc
    assert auc > 0.8
    assert 0 < M.fold_means(scores).first().recall <= 1
    counted = M.fit(data, M.preprocessor(["x"], ["c"], "mean", "minmax"), M.make_model("bayes"))
    assert ranking.prediction_metrics(data.join(M.probabilities(data, counted), "row_id"), "prob", "y").first().auc > 0.7
    model = M.fit(data, prepare(), M.make_model("logistic", {"maxIter": 10}), sample="smote")
    table = M.score_table(data, model).orderBy("model_rank").collect()
    assert [r.model_rank for r in table] == list(range(1, 301))
    assert all((r.accept_probability >= 0.125) == bool(r.predicted_accepted) for r in table)
    with pytest.raises(ValueError):
        M.preprocessor(["is_winner"], [])


def test_resampling(spark, people):
    vectors = people.select("row_id", "y", F.array(F.coalesce("x", F.lit(0.5)), F.lit(1.0)).alias("features"))
    people_y = {r.row_id: r.y for r in vectors.collect()}
    balanced = M.smote(vectors)
    counts = {r.y: r["count"] for r in balanced.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    own = {r.row_id: r.features for r in vectors.collect()}
    made = balanced.filter("row_id IS NULL").collect()
    assert made and len({(r.base, r.copy) for r in made}) == len(made)
    for r in made:
        draw = hashlib.md5(f"42|{r.base}|{r.copy}".encode()).hexdigest()
        assert math.isclose(r.weight, int(draw[8:16], 16) / 2**32)
        a, b = own[r.base], own[r.neighbour]
        assert all(math.isclose(v, x + (z - x) * r.weight) for v, x, z in zip(r.features.toArray(), a, b, strict=True))
        nearer = [i for i, v in own.items() if i != r.base and people_y[i] == 1 and math.dist(a, v) < math.dist(a, b)]
        assert len(nearer) < M.NEIGHBOURS
    alone = vectors.filter("y = 0").unionByName(vectors.filter("y = 1").limit(1))
    with pytest.raises(ValueError):
        M.smote(alone)
    assert M.smote(vectors.filter("y = 1")).count() == vectors.filter("y = 1").count()
    under = {r.y: r["count"] for r in M.undersample(vectors).groupBy("y").count().collect()}
    assert under[0] == under[1]
    only = spark.createDataFrame([(1,), (1,)], "y int")
    assert M.pos_weight(only).first()[0] == 0.5
