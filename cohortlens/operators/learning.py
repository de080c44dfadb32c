"""Training and scoring with Spark ML: preprocessing, grouped splits, resampling, search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .filters import assert_no_leak
from .neighbours import nearest_neighbours
from .ordering import global_row_number
from .ranking import confusion_metrics, pick_threshold, portable_key, threshold_sweep

# Seed, shares and thresholds of the training run.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
REPEAT_STEP = 101
DECISION_THRESHOLD = 0.125
NEIGHBOURS = 5
PROBABILITY_DIGITS = 9
UNKNOWN = "UNKNOWN"
ABSENT = "-1e9D"  # a missing number that is not imputed


# --- splits -----------------------------------------------------------------------------

def _class_ranks(df: DataFrame, seed: int) -> DataFrame:
    """(identity, y, rank, size): identities in hash order inside their class."""
    groups = df.groupBy("identity").agg(F.max("y").alias("y"))
    keyed = groups.withColumn("_k", portable_key(F.col("identity"), seed=seed))
    placed = global_row_number(keyed, [F.asc("y"), F.asc("_k"), F.asc("identity")], "_n")
    sizes = groups.groupBy("y").agg(F.count(F.lit(1)).alias("size"))
    starts = placed.groupBy("y").agg((F.min("_n") - 1).alias("_before"))
    per_class = F.broadcast(sizes.join(starts, "y"))  # one row per class
    return placed.join(per_class, "y").select("identity", "y", (F.col("_n") - F.col("_before")).alias("rank"), "size")


def group_split(df: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: whole identities, the same share of each class."""
    ranks = _class_ranks(df, seed)
    flags = ranks.select("identity", (F.col("rank") <= F.round(F.col("size") * share)).alias("is_test"))
    return df.join(flags.hint("merge"), "identity")


def fold_ids(df: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1: whole identities, classes spread evenly."""
    folds = _class_ranks(df, seed).select("identity", (F.col("rank") % k).cast("int").alias("fold"))
    return df.join(folds.hint("merge"), "identity")


def pos_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive; an absent class counts as one row."""
    negative, positive = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    one = F.lit(1)
    return df.agg((F.greatest(negative, one) / F.greatest(positive, one)).alias("pos_weight"))


# --- models --------------------------------------------------------------------------------

def preprocessor(
    numeric: Sequence[str], categorical: Sequence[str], impute: str = "median", scale: str = "standard"
) -> Pipeline:
    """Impute and scale numbers, one-hot labels (unknown ones share a slot) -> ``features``.

    Without imputation missing numbers become ABSENT and nothing is scaled: the trees of
    'forest' and 'boosted' can then part them from all others.
    """
    assert_no_leak([*numeric, *categorical])
    scalers = {
        "standard": lambda: StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
        "robust": lambda: RobustScaler(inputCol="_num", outputCol="_scaled", withCentering=True),
        "minmax": lambda: MinMaxScaler(inputCol="_num", outputCol="_scaled"),
    }
    if impute not in ("median", "mean", "none"):
        raise ValueError(f"unknown imputation: {impute}")
    filled = [f"_i_{c}" for c in numeric]
    stages: list[Estimator | Transformer] = []
    if impute == "none":
        marked = ", ".join(f"coalesce(nanvl(`{c}`, NULL), {ABSENT}) AS `_i_{c}`" for c in numeric)
        stages.append(SQLTransformer(statement=f"SELECT *, {marked} FROM __THIS__"))
    else:
        stages.append(Imputer(strategy=impute, inputCols=list(numeric), outputCols=filled))
    stages.append(VectorAssembler(inputCols=filled, outputCol="_num", handleInvalid="keep"))
    number = "_num"
    if impute != "none" and scale in scalers:
        stages.append(scalers[scale]())
        number = "_scaled"
    if categorical:
        indexed, encoded = [f"_x_{c}" for c in categorical], [f"_o_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"))
        stages.append(VectorAssembler(inputCols=[number, *encoded], outputCol="features", handleInvalid="keep"))
    else:
        stages.append(VectorAssembler(inputCols=[number], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def model_input(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ("row_id", "identity", "y")) -> DataFrame:
    """Just the columns a model needs: numbers as double, labels as filled strings."""
    return df.select(
        *keep,
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in categorical if c not in keep],
    )


def with_class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Add ``weight``: positives weigh as much in total as negatives."""
    return df.withColumn("weight", F.when(F.col(label) == 1, pos_weight(df, label).scalar()).otherwise(1.0))


def make_model(name: str, params: dict | None = None, weighted: bool = True, seed: int = SEED) -> Estimator:
    """'logistic', 'forest', 'boosted' or 'bayes' with the caller's parameters.

    'bayes' counts feature mass per class in one pass, so any engine can repeat it; it needs
    numbers of 0 or more, as scaling by 'minmax' gives.
    """
    shared = {"featuresCol": "features", "labelCol": "y", **({"weightCol": "weight"} if weighted else {})}
    makers = {
        "logistic": lambda: LogisticRegression(**shared, **{"maxIter": 50, **(params or {})}),
        "forest": lambda: RandomForestClassifier(**shared, seed=seed, **{"numTrees": 50, **(params or {})}),
        "bayes": lambda: NaiveBayes(**shared, **{"smoothing": 1.0, **(params or {})}),
        "boosted": lambda: GBTClassifier(**shared, seed=seed, **{"maxIter": 30, **(params or {})}),
    }
    if name not in makers:
        raise ValueError(f"unknown model: {name}")
    return makers[name]()


def fit(train: DataFrame, prepare: Pipeline, model: Estimator, sample: str | None = None, seed: int = SEED) -> PipelineModel:
    """Fit preprocessing, optionally resample the training features, then fit the model."""
    return fit_prepared(train, prepare.fit(train), model, sample, seed)


def fit_prepared(train: DataFrame, fitted: PipelineModel, model: Estimator, sample: str | None = None, seed: int = SEED) -> PipelineModel:
    """As ``fit``, with a preparation that is fitted already."""
    ready = fitted.transform(train).select("row_id", "y", "features")
    if sample == "under":
        ready = undersample(ready, seed)
    elif sample == "smote":
        ready = smote(ready, seed=seed)
    elif sample is not None:
        raise ValueError(f"unknown resampling: {sample}")
    return PipelineModel(stages=[fitted, model.fit(with_class_weight(ready))])


def probabilities(df: DataFrame, model: Transformer, name: str = "prob") -> DataFrame:
    """(row_id, name): probability of acceptance."""
    out = model.transform(df)
    return out.select("row_id", vector_to_array("probability")[1].alias(name))


def out_of_fold(
    df: DataFrame,
    prepare: Callable[[], Pipeline],
    model: Callable[[], Estimator],
    k: int = FOLDS,
    repeats: int = 1,
    seed: int = SEED,
    sample: str | None = None,
) -> DataFrame:
    """Add ``prob``: each row scored by models that saw none of its identity, averaged
    over repeats. ``repeat``-wise folds stay in the frame returned by ``fold_scores``."""
    scores = fold_scores(df, prepare, model, k, repeats, seed, sample)
    means = scores.groupBy("row_id").agg(F.avg("prob").alias("prob"))
    return df.join(means.hint("merge"), "row_id")


def fold_scores(df, prepare, model, k=FOLDS, repeats=1, seed=SEED, sample=None) -> DataFrame:
    """(row_id, y, repeat, fold, prob), one row per application and repeat.

    Rows and probabilities meet in merge joins: files of a few numbers a row are small enough for
    Spark to broadcast tens of millions of rows, one such table per fold.
    """
    parts = []
    for repeat in range(repeats):
        folded = stage(fold_ids(df, k, seed + repeat * REPEAT_STEP))
        for fold in range(k):
            fitted = fit(folded.filter(F.col("fold") != fold), prepare(), model(), sample, seed)
            held = folded.filter(F.col("fold") == fold)
            scored = held.select("row_id", "y").join(probabilities(held, fitted).hint("merge"), "row_id")
            parts.append(scored.select("row_id", "y", F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "prob"))
    return stage(reduce(DataFrame.unionByName, parts))


def fold_means(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean of the per-fold measures at a threshold."""
    per = confusion_metrics(scores, threshold, "prob", "y", by=["repeat", "fold"])
    return per.agg(*[F.avg(c).alias(c) for c in per.columns if c not in ("repeat", "fold")])


def bagged(train: DataFrame, test: DataFrame, prepare: Callable[[], Pipeline], model: Callable[[int], Estimator], seeds: Sequence[int]) -> DataFrame:
    """(row_id, prob): mean probability of one model per seed."""
    fitted = prepare().fit(train)
    ready = stage(with_class_weight(fitted.transform(train).select("row_id", "y", "features")))
    held = fitted.transform(test).select("row_id", "features")
    parts = [probabilities(held, model(s).fit(ready)) for s in seeds]
    return reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(F.avg("prob").alias("prob"))


# --- resampling ------------------------------------------------------------------------------

def undersample(df: DataFrame, seed: int = SEED) -> DataFrame:
    """All positives and as many negatives, picked in hash order."""
    keyed = df.filter("y = 0").withColumn("_k", portable_key(F.col("row_id"), seed=seed))
    placed = global_row_number(keyed, [F.asc("_k"), F.asc("row_id")], "_n")
    wanted = df.agg(F.count_if(F.col("y") == 1)).scalar()
    return df.filter("y = 1").unionByName(placed.filter(F.col("_n") <= wanted).drop("_n", "_k"))


def interpolated(minority: DataFrame, count: int, k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """``count`` points (base, copy, neighbour, weight, vec) between rows (row_id, vec) and their neighbours.

    Copies are dealt evenly over the rows in order of row_id. The neighbour is one of the k
    nearest by Euclidean distance; an md5 of seed, row and copy draws it and how far along.
    """
    placed = stage(global_row_number(minority.select("row_id", "vec"), [F.asc("row_id")], "_n"))
    few = placed.count()
    if few < 2:
        raise ValueError("interpolation needs two positive rows or more")
    near = nearest_neighbours(placed.select(F.col("row_id").alias("id"), "vec"), k)
    listed = near.groupBy(F.col("id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("place", "neighbour"))).alias("_near"))  # at most k
    copies = F.lit(count // few) + (F.col("_n") <= count % few).cast("int")
    made = placed.join(listed, "row_id").filter(copies > 0).select("row_id", "vec", "_near", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row_id").cast("string"), F.col("copy").cast("string")))
    number = lambda start: F.conv(F.substring(draw, start, 8), 16, 10).cast("long")
    drawn = made.select(
        F.col("row_id").alias("base"), "copy", F.element_at("_near", (number(1) % F.size("_near") + 1).cast("int"))["neighbour"].alias("neighbour"),
        (number(9) / F.lit(4294967296.0)).alias("weight"), "vec",
    )
    other = placed.select(F.col("row_id").alias("neighbour"), F.col("vec").alias("_other"))
    along = F.zip_with("vec", "_other", lambda a, b: a + (b - a) * F.col("weight"))
    return drawn.join(other, "neighbour").select("base", "copy", "neighbour", "weight", along.alias("vec"))


def smote(df: DataFrame, k: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """As many positive as negative rows, by points between a positive row and one of its nearest.

    Original rows keep ``row_id``; new ones have none, but ``base``, ``copy``, ``neighbour``
    and ``weight`` tell where they come from. One positive row, or none, raises ValueError
    unless no point is wanted.
    """
    array = F.col("features") if dict(df.dtypes)["features"].startswith("array") else vector_to_array("features")
    rows = stage(df.select("row_id", F.col("y").cast("int").alias("y"), array.alias("vec")))
    size = rows.agg(F.count_if(F.col("y") == 1).alias("few"), F.count_if(F.col("y") == 0).alias("many")).first()
    if size.many > size.few:
        new = interpolated(rows.filter("y = 1"), size.many - size.few, k, seed)
        rows = rows.unionByName(new.withColumns({"row_id": F.lit(None).cast("long"), "y": F.lit(1)}), allowMissingColumns=True)
    return rows.select(*(c for c in rows.columns if c != "vec"), array_to_vector("vec").alias("features"))


# --- selection and scoring ---------------------------------------------------------------------

def evaluate(scores: DataFrame) -> DataFrame:
    """One row: the best threshold of out-of-fold scores and its measures."""
    return pick_threshold(threshold_sweep(scores, "prob", "y"))


def best_experiment(table: DataFrame) -> DataFrame:
    """The row of an experiment table with the highest (f2, recall); of equal ones the earliest."""
    return table.orderBy(F.desc("f2"), F.desc("recall"), "config").limit(1)


def score_table(df: DataFrame, model: Transformer, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Probability, decision and rank per application; true labels only where present.

    Probabilities are kept to PROBABILITY_DIGITS, so noise in the last bits ranks nothing.
    """
    found = probabilities(df, model, "accept_probability").withColumn("accept_probability", F.round("accept_probability", PROBABILITY_DIGITS))
    ranked = global_row_number(found, [F.desc("accept_probability"), F.asc("row_id")], "model_rank")  # two columns are written
    scored = df.join(ranked, "row_id")
    out = scored.withColumns(
        {
            "predicted_accepted": (F.col("accept_probability") >= threshold).cast("int"),
            "prediction_threshold": F.lit(threshold),
        }
    )
    kept = [c for c in ("row_id", "identity", "project_name", "year", "y") if c in df.columns]
    return out.select(*kept, "accept_probability", "predicted_accepted", "prediction_threshold", "model_rank")
