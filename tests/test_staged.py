import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import learning, staged

SWEEP = """
WITH g AS (SELECT round(0.05::DOUBLE + 0.025::DOUBLE * unnest(range(29)), 3) AS t),
m AS (SELECT stage, candidate, row_id, y, avg(prob) AS p FROM scores GROUP BY ALL),
c AS (SELECT stage, candidate, t, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn FROM m, g GROUP BY ALL),
r AS (SELECT *, coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stage, candidate ORDER BY recall >= 0.85 DESC, f2 DESC, recall DESC, t) = 1)
SELECT stage, candidate, t, round(f2, 4) AS f2, round(recall, 4) AS recall FROM b ORDER BY 1, 2"""


@pytest.fixture(scope="module")
def space():
    return staged.Space(
        feature_sets={"base": ["x"], "full": ["x", "z"]}, categorical=["c"], families={"logistic": {"maxIter": 5}, "forest": {"numTrees": 3, "maxDepth": 2}}, booster="forest",
        imputes=("mean", "none"), scales=("minmax", "standard"), choices={"logistic": {"regParam": [0.0, 0.1, 1.0], "maxIter": [3, 8]}}, draws=2,
        samples=("under",), bag_seeds=(42, 7),
    )


@pytest.fixture(scope="module")
def found(spark, space, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(i, f"p{i // 2}", int(rng.random() < 0.35), float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, identity string, y int, x double, z double, c string")
    df = df.withColumns({"x": F.when(F.col("row_id") % 9 != 0, F.col("x") + F.col("y")), "z": F.col("z") + F.col("y")})
    folder = str(tmp_path_factory.mktemp("search"))
    return df, folder, staged.staged_search(df, space, k=2, folder=folder)


def test_measures_follow_from_the_scores(found):
    state = [r.asDict() for r in found[2].state.orderBy("stage", "candidate").collect()]
    scores = found[2].scores.toPandas()  # noqa: F841
    got = duckdb.sql(SWEEP).fetchall()
    assert [(r["stage"], r["candidate"], r["threshold"], r["f2"], r["recall"]) for r in state if r["stage"] < 7] == got
    train = {r.row_id for r in found[2].scores.select("row_id").distinct().collect()}
    test = {r.row_id for r in found[2].test.collect()}
    assert not train & test and len(train | test) == 240
    per = found[2].scores.groupBy("stage", "candidate", "seed", "row_id").count().filter("count > 1")
    assert per.isEmpty()


def test_stages_feed_on_the_winners_before(found, space):
    state = [r.asDict() for r in found[2].state.orderBy("stage", "candidate").collect()]
    by = {s: [r for r in state if r["stage"] == s] for s in range(1, 8)}
    assert [len(by[s]) for s in range(1, 8)] == [2, 2, 3, 2, 1, 1, 1]
    key = lambda r: (r["f2"], r["recall"], -r["stage"], -r["candidate"])
    way = max((r for s in (1, 2, 3) for r in by[s] if r["model"] == "forest" and r["feature_set"] == "full"), key=key)
    assert all((r["impute"], r["scale"]) == (way["impute"], way["scale"]) for s in (4, 5) for r in by[s])
    tuned = max(by[4], key=key)
    assert all((r["model"], r["params"]) == (tuned["model"], tuned["params"]) for r in by[5]) and [r["sample"] for r in by[5]] == ["under"]
    single = max((r for s in range(1, 6) for r in by[s]), key=key)
    assert all(by[6][0][n] == single[n] for n in ("model", "feature_set", "impute", "scale", "sample", "params")) and by[6][0]["seeds"] == "42 7"
    final = max((r for r in state if r["stage"] < 7), key=key)
    assert [r for r in state if r["chosen"] and r["stage"] < 7] == [final]
    assert by[7][0]["threshold"] == final["threshold"] and len(found[2].models) == len(final["seeds"].split())
    hit = [(r.prob >= final["threshold"], r.y) for r in found[2].test.collect()]
    tp, fp, fn = sum(a and y for a, y in hit), sum(a and not y for a, y in hit), sum(not a and y for a, y in hit)
    assert by[7][0]["f2"] == round(5 * tp / (5 * tp + 4 * fn + fp), 4)


def test_a_second_run_reads_what_is_there(found, space, monkeypatch):
    df, folder, first = found
    fits = []
    monkeypatch.setattr(staged, "fit_prepared", lambda *a, real=staged.fit_prepared: fits.append(a) or real(*a))
    again = staged.staged_search(df, space, k=2, folder=folder)
    assert len(fits) == len(again.models)  # the final training alone
    assert again.state.collect() == first.state.collect()


def test_draws_are_seeded():
    choices = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    one = [staged.drawn_params(choices, "forest", n) for n in range(1, 30)]
    assert one == [staged.drawn_params(choices, "forest", n) for n in range(1, 30)]
    assert len({json.dumps(p) for p in one}) == 6
    assert one != [staged.drawn_params(choices, "forest", n, 7) for n in range(1, 30)]


def test_experiments_try_every_stage_and_mark_the_best(found, space, monkeypatch):
    df, folder, first = found
    monkeypatch.setattr(staged, "staged_search", lambda *given: first if given[:3] == (df, space, 2) else None)
    table = staged.experiments(df, space, k=2)
    rows = [r.asDict() for r in table.orderBy("config").collect()]
    assert [r["config"] for r in rows] == list(range(len(rows))) and [r["stage"] for r in rows] == [1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6]
    tried = first.state.filter("stage < 7").orderBy("stage", "candidate").collect()
    assert [(r["model"], r["params"], r["threshold"], r["f2"], r["recall"]) for r in rows] == [(r.model, r.params, r.threshold, r.f2, r.recall) for r in tried]
    assert [r for r in rows if r["chosen"]] == [learning.best_experiment(table).first().asDict()]


def test_the_experiments_query_names_every_step(monkeypatch):
    from cohortlens.plans import learning as plans

    asked = []
    monkeypatch.setattr(plans, "_base", lambda spark, d: None)
    monkeypatch.setattr(plans, "tried", lambda df, space, k: asked.append(space))
    plans.experiments(None, None)
    space = asked[0]
    assert set(space.families) == {"logistic", "forest", "boosted"} and len(space.feature_sets) > 1 and set(space.feature_sets["full"]) == set(plans.NUMERIC)
    assert set(space.imputes) == {"median", "mean", "none"} and set(space.scales) == {"standard", "robust", "minmax"} and set(space.samples) == {"smote", "under"}
    assert space.choices[space.booster] and space.draws == staged.DRAWS and tuple(space.bag_seeds) == staged.BAG_SEEDS
