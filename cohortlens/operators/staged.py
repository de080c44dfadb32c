"""Staged model search: every stage tries candidates around the winners of the stages before.

1 families with their defaults, 2 feature sets, 3 imputation and scaling, 4 drawn
parameters, 5 resampling, 6 several seeds averaged, then the best of all is trained on the
whole training part and measured on the test part. A candidate's out-of-fold scores are
written as a table of their own, named after its settings; the state table of the search
follows from those tables alone. A search started again with the same folder reads what is
there and goes on behind it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, stage
from .learning import FOLDS, SEED, evaluate, fit_prepared, fold_ids, group_split, make_model, model_input, preprocessor, probabilities
from .ranking import confusion_metrics

WEIGHTED = "class_weight"  # in place of a resampling: positives weigh as much as negatives
# Seeds of the averaged models and number of parameter draws of the training run.
BAG_SEEDS = (42, 7, 2024)
DRAWS = 15
DIGITS = 4  # measures are compared at this precision
SCORES = "row_id long, y int, fold int, seed int, prob double"
STATE = (
    "stage int, candidate int, model string, feature_set string, impute string, scale string, sample string, params string, seeds string, "
    "threshold double, f2 double, recall double, precision double, fn_rate double, cv_f2 double, cv_recall double, chosen boolean"
)


@dataclass(frozen=True)
class Space:
    """What the stages may try. ``whole`` names the feature set of stages 1 and 3 to 6."""

    feature_sets: Mapping[str, Sequence[str]]
    categorical: Sequence[str]
    families: Mapping[str, Mapping[str, Any]] = field(default_factory=lambda: {"logistic": {}, "forest": {}, "boosted": {}})
    booster: str = "boosted"
    whole: str = "full"
    imputes: Sequence[str] = ("median", "mean", "none")
    scales: Sequence[str] = ("standard", "robust", "minmax")
    choices: Mapping[str, Mapping[str, Sequence[Any]]] = field(default_factory=dict)
    draws: int = DRAWS
    samples: Sequence[str] = ("smote", "under")
    bag_seeds: Sequence[int] = BAG_SEEDS


@dataclass(frozen=True)
class Candidate:
    stage: int
    candidate: int
    model: str
    feature_set: str
    impute: str = "median"
    scale: str = "standard"
    sample: str = WEIGHTED
    params: str = "{}"
    seeds: tuple[int, ...] = (SEED,)


@dataclass(frozen=True)
class Search:
    """``state`` a row per candidate and one for the test part (stage 7), ``scores`` all
    out-of-fold scores with stage and candidate, ``test`` (row_id, y, prob), ``models`` the
    trained pipelines, one per seed."""

    state: DataFrame
    scores: DataFrame
    test: DataFrame
    models: list[PipelineModel]


def drawn_params(choices: Mapping[str, Sequence[Any]], family: str, number: int, seed: int = SEED) -> dict[str, Any]:
    """One value per parameter, picked by an md5 of seed, family, draw and parameter name."""
    def pick(name: str) -> int:
        return int(hashlib.md5(f"{seed}|{family}|{number}|{name}".encode()).hexdigest()[:8], 16)

    return {name: values[pick(name) % len(values)] for name, values in choices.items()}


def best(rows: Sequence[dict[str, Any]]) -> dict[str, Any]:
    """The row of the highest (f2, recall); of equal ones the earliest."""
    return max(rows, key=lambda r: (r["f2"], r["recall"], -r["stage"], -r["candidate"]))


def measures(scores: DataFrame) -> dict[str, float]:
    """Best threshold of out-of-fold scores, averaged over seeds, and the measures there; means over folds at 0.5."""
    mean = stage(scores.groupBy("row_id", "y").agg(F.avg("prob").alias("prob")))
    found = evaluate(mean).select("threshold", "f2", "recall", "precision", "fn_rate").first().asDict()
    last = scores.select(F.max("seed")).scalar()
    folds = confusion_metrics(scores.filter(F.col("seed") == last), 0.5, "prob", "y", by=["fold"])
    means = folds.agg(F.avg("f2").alias("cv_f2"), F.avg("recall").alias("cv_recall")).first().asDict()
    return {k: round(v, DIGITS) for k, v in {**found, **means}.items()}


def staged_search(df: DataFrame, space: Space, k: int = FOLDS, seed: int = SEED, folder: str | None = None) -> Search:
    """Search over labelled rows (row_id, identity, y and the columns of ``space``).

    Identities go whole to the test part or to one fold. Driver memory holds the state rows
    only, one a candidate; all scores stay in tables under ``folder`` (a new one in the
    shared folder, unless given).
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    columns = list(dict.fromkeys(c for names in space.feature_sets.values() for c in names))
    data = stage(group_split(model_input(df, columns, space.categorical)))
    train, test = stage(fold_ids(data.filter("NOT is_test"), k, seed)), data.filter("is_test")
    rows: list[dict[str, Any]] = []
    tables: list[DataFrame] = []
    measured: dict[str, dict[str, float]] = {}

    prepared: dict[tuple[str, str, str, int | None], PipelineModel] = {}  # fitted preparations, shared by candidates

    def trained(candidate: Candidate, fold: int | None, model_seed: int) -> PipelineModel:
        part = train if fold is None else train.filter(F.col("fold") != fold)
        way = (candidate.feature_set, candidate.impute, candidate.scale, fold)
        if way not in prepared:
            numeric = space.feature_sets[candidate.feature_set]
            prepared[way] = preprocessor(numeric, space.categorical, candidate.impute, candidate.scale).fit(part)
        params = {**space.families.get(candidate.model, {}), **json.loads(candidate.params)}
        model = make_model(candidate.model, params, weighted=candidate.sample == WEIGHTED, seed=model_seed)
        return fit_prepared(part, prepared[way], model, None if candidate.sample == WEIGHTED else candidate.sample, model_seed)

    def fold_table(candidate: Candidate) -> DataFrame:
        parts = []
        for model_seed in candidate.seeds:
            for fold in range(k):
                model = trained(candidate, fold, model_seed)
                held = train.filter(F.col("fold") == fold)
                scored = held.select("row_id", "y", "fold").join(probabilities(held, model).hint("merge"), "row_id")
                parts.append(scored.select("row_id", F.col("y").cast("int").alias("y"), "fold", F.lit(model_seed).alias("seed"), "prob"))
        return reduce(DataFrame.unionByName, parts)

    def add(candidate: Candidate) -> dict[str, Any]:
        settings = asdict(candidate)
        name = table_name(settings, space, k, seed)
        scores = kept_table(f"{folder}/{name}", lambda: fold_table(candidate), df)
        if name not in measured:  # the same settings can come up in several stages
            measured[name] = measures(scores)
        tables.append(scores.select(F.lit(candidate.stage).alias("stage"), F.lit(candidate.candidate).alias("candidate"), "*"))
        rows.append({**settings, "seeds": " ".join(map(str, candidate.seeds)), **measured[name]})
        return rows[-1]

    for n, family in enumerate(space.families, 1):
        add(Candidate(1, n, family, space.whole))
    for n, name in enumerate(space.feature_sets, 1):
        add(Candidate(2, n, space.booster, name))
    ways = [(i, s) for i in space.imputes for s in space.scales if i != "none" or s == "standard"]
    for n, (impute, scale) in enumerate(ways, 1):
        add(Candidate(3, n, space.booster, space.whole, impute, scale))
    way = best([r for r in rows if r["model"] == space.booster and r["feature_set"] == space.whole])
    ready = {"feature_set": space.whole, "impute": way["impute"], "scale": way["scale"]}
    draws = [(family, number) for family in space.choices for number in range(1, space.draws + 1)]
    for n, (family, number) in enumerate(draws, 1):
        params = drawn_params(space.choices[family], family, number, seed)
        add(Candidate(4, n, family, params=json.dumps(params, sort_keys=True), **ready))
    tuned = best([r for r in rows if r["stage"] == 4] or [way])
    for n, sample in enumerate(space.samples, 1):
        add(Candidate(5, n, tuned["model"], sample=sample, params=tuned["params"], **ready))
    single = best(rows)
    settings = {name: single[name] for name in ("model", "feature_set", "impute", "scale", "sample", "params")}
    add(Candidate(6, 1, **settings, seeds=tuple(space.bag_seeds)))
    final = best(rows)
    chosen = Candidate(**{**{f: final[f] for f in Candidate.__dataclass_fields__}, "seeds": tuple(map(int, final["seeds"].split()))})
    models = [trained(chosen, None, s) for s in chosen.seeds]
    held = reduce(DataFrame.unionByName, (probabilities(test, m) for m in models)).groupBy("row_id").agg(F.avg("prob").alias("prob"))
    result = stage(test.select("row_id", F.col("y").cast("int").alias("y")).join(held.hint("merge"), "row_id"))
    at = confusion_metrics(result, final["threshold"], "prob", "y").select("f2", "recall", "precision", "fn_rate").first()
    reached = {name: None if at is None else round(at[name], DIGITS) for name in ("f2", "recall", "precision", "fn_rate")}
    state = [{**r, "chosen": r is final} for r in rows]
    state.append({**final, "stage": 7, "candidate": 1, **reached, "cv_f2": None, "cv_recall": None, "chosen": True})
    names = [part.split()[0] for part in STATE.split(", ")]
    return Search(spark.createDataFrame([tuple(r[n] for n in names) for r in state], STATE), reduce(DataFrame.unionByName, tables), result, models)


def experiments(df: DataFrame, space: Space, k: int = FOLDS, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """One row per configuration that the stages of a search tried, with the measures at its best threshold.

    ``config`` numbers them in the order they were tried. ``chosen`` marks the best by (f2, recall),
    the one that ``best_experiment`` finds. The test part of ``df`` is in no measure.
    """
    state = staged_search(df, space, k, seed, folder).state.filter("stage < 7")
    tried = Window.orderBy("stage", "candidate")  # over one row a configuration
    return state.select((F.row_number().over(tried) - 1).alias("config"), *(c for c in state.columns if c != "candidate"))


def table_name(settings: Mapping[str, Any], space: Space, k: int, seed: int) -> str:
    """Name of a candidate's scores: all that they depend on, besides the rows."""
    used = {
        **{name: value for name, value in settings.items() if name not in ("stage", "candidate")}, "k": k, "split": seed, "columns": list(space.feature_sets[settings["feature_set"]]), "categorical": list(space.categorical),
        "defaults": dict(space.families.get(settings["model"], {})),
    }
    digest = hashlib.sha256(json.dumps(used, sort_keys=True, default=str).encode()).hexdigest()
    return f"scores-{digest[:24]}"


def kept_table(path: str, make: Callable[[], DataFrame], df: DataFrame) -> DataFrame:
    """The scores at ``path`` if a run before has finished them, else made and written now."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.read.schema(SCORES).parquet(path)
    make().write.mode("overwrite").parquet(path)
    return spark.read.schema(SCORES).parquet(path)
