"""Quality classifier by co-training on two views.

The text view sees the words of a document, the metadata view its language, source and the
shape of the page (length, lines, share of signs, capitals and digits). Each view is a naive
Bayes model over a table of counts of fixed size, so training is one pass that sums counts
over the whole corpus. A bounded sample of labelled documents starts both. In each round a
view labels all unlabelled documents it is confident about, and these labels train the
other view. Both views are calibrated on labelled documents that never train them, and a
logistic combination of the calibrated views scores every document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLANK_WORDS, Slice, byte_class, slices, words_of
from .counts import summed
from .registry import register
from .tables import table

TEXT_SLOTS = 1 << 18
META_SLOTS = 1 << 12
MAX_LABELS = 20_000  # labelled documents used, by the order of a hash of their ids
CALIBRATION_FOLDS = 5  # one in so many labelled documents calibrates and does not train
ROUNDS = 2
CONFIDENT = (0.03, 0.97)
LABEL_WEIGHT, PSEUDO_WEIGHT = 4, 1
SMOOTHING = 4.0
SIGNS = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
CAPITALS = byte_class((0x41, 0x5A))
DIGITS = byte_class((0x30, 0x39))


@dataclass(frozen=True)
class View:
    """Log odds of each slot, and the calibration ``a * x + b`` of a document's mean log odds ``x``."""

    odds: np.ndarray
    slope: float = 1.0
    bias: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * x + self.bias, -30, 30)


@dataclass(frozen=True)
class Model:
    text: View
    meta: View
    weights: tuple[float, float, float] = (1.0, 1.0, 0.0)  # of the two logits, and a constant
    trained: bool = True
    rounds: list = field(default_factory=list)

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(x_text), self.meta.logit(x_meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def meta_slots(part: Slice, langs: list, sources: list) -> np.ndarray:
    """One slot per metadata feature (row: document)."""
    data, size = part.data, np.diff(part.offsets)
    doc_of = lambda places: np.searchsorted(part.offsets, places, side="right") - 1
    count = lambda kind: np.bincount(doc_of(np.flatnonzero(kind)), minlength=len(part))
    share = lambda n: np.ceil(np.log2(1 + 1000 * n / np.maximum(size, 1))).astype(np.int64)
    size_bin = lambda n: np.floor(np.log2(1 + n)).astype(np.int64)
    n_lines = 1 + count(data == 10)
    numbers = [size_bin(size), size_bin(n_lines), size_bin(size / n_lines), share(count(SIGNS[data])), share(count(CAPITALS[data])), share(count(DIGITS[data])), share(count(data >= 0x80))]
    names: dict[str, int] = {}

    def slot(name: str) -> int:
        if name not in names:
            names[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % META_SLOTS
        return names[name]

    columns = [[slot(f"lang={x}") for x in langs], [slot(f"source={x}") for x in sources]]
    columns += [[slot(f"{k}={x}") for x in column.tolist()] for k, column in enumerate(numbers)]
    return np.array(columns, dtype=np.int64).T.reshape(len(part), -1)


def text_slots(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of every word."""
    words, _ = words_of(part, BLANK_WORDS, lower=False)
    return (words.code >> np.uint64(64 - 18)).astype(np.int64), words.doc


def view_scores(model: Model, part: Slice, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot, doc = text_slots(part)
    n = np.bincount(doc, minlength=len(part))
    x_text = np.bincount(doc, weights=model.text.odds[slot], minlength=len(part)) / np.maximum(n, 1)
    return x_text, model.meta.odds[meta].mean(axis=1)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a (2, slots) table: row 1 is good."""
    share = (counts + SMOOTHING * (counts.sum(axis=0) > 0)) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.where(counts.sum(axis=0) > 0, np.log(np.maximum(share[1], 1e-12)) - np.log(np.maximum(share[0], 1e-12)), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the columns of ``x`` and a constant, by Newton steps on standardised columns."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge * len(x) / 100), 1e-6)
    for _ in range(50):
        p = sigmoid(np.clip(z @ w, -30, 30))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def label_sample(labels: DataFrame, column: str = "quality", limit: int = MAX_LABELS) -> DataFrame:
    """(doc_id, label, fold) of at most ``limit`` labelled ids, in the order of a hash of the id.

    An id labelled several times takes the majority; even votes and null labels don't count.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.avg((F.col(column) > 0).cast("int")).alias("vote"))
    voted = votes.where("vote <> 0.5").select("doc_id", (F.col("vote") > 0.5).cast("int").alias("label"))
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(CALIBRATION_FOLDS)).cast("int"))


def _columns(docs: DataFrame, labels: DataFrame | None, how: str = "left") -> DataFrame:
    rows = docs.select(F.col("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    if labels is None:
        return rows.withColumns({"label": F.lit(None).cast("int"), "fold": F.lit(None).cast("int")})
    return rows.join(F.broadcast(labels), "doc_id", how)  # at most MAX_LABELS rows


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        langs, sources, labels, folds = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        for part in slices(batch.column(1)):
            own = slice(part.first, part.first + len(part))
            label = np.array([-1 if x is None else x for x in labels[own]], dtype=np.int64)
            fold = np.array([-1 if x is None else x for x in folds[own]], dtype=np.int64)
            yield batch, part, meta_slots(part, langs[own], sources[own]), label, fold


def train_counts(rows: DataFrame, held) -> np.ndarray:
    """Counts of both views, [text bad, text good, meta bad, meta good], and what each view labelled.

    ``held`` is a broadcast Model, or None for the first counts from labels alone. A view
    counts the labelled documents that train, and those the *other* view is sure of.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        text, meta_table, taught = np.zeros((2, TEXT_SLOTS), np.int64), np.zeros((2, META_SLOTS), np.int64), np.zeros(4, np.int64)
        for _, part, meta, label, fold in _batches(batches):
            weight = np.where((label >= 0) & (fold > 0), LABEL_WEIGHT, 0)
            classes = {"text": np.maximum(label, 0), "meta": np.maximum(label, 0)}
            weights = {"text": weight, "meta": weight.copy()}
            if held is not None:
                x_text, x_meta = view_scores(held.value, part, meta)
                sure = {"meta": sigmoid(held.value.text.logit(x_text)), "text": sigmoid(held.value.meta.logit(x_meta))}
                for k, (pupil, p) in enumerate(sure.items()):
                    low, high = (label < 0) & (p <= CONFIDENT[0]), (label < 0) & (p >= CONFIDENT[1])
                    classes[pupil] = np.where(high, 1, np.where(low, 0, classes[pupil]))
                    weights[pupil] = np.where(high | low, PSEUDO_WEIGHT, weights[pupil])
                    taught[2 * k : 2 * k + 2] += [int(low.sum()), int(high.sum())]
            slot, doc = text_slots(part)
            for c in (0, 1):
                w = np.where(classes["text"] == c, weights["text"], 0)
                used = w[doc] > 0
                text[c] += np.bincount(slot[used], weights=w[doc[used]], minlength=TEXT_SLOTS).astype(np.int64)
                w = np.where(classes["meta"] == c, weights["meta"], 0)
                used = w > 0
                meta_table[c] += np.bincount(meta[used].ravel(), weights=np.repeat(w[used], meta.shape[1]), minlength=META_SLOTS).astype(np.int64)
        return np.concatenate([text.ravel(), meta_table.ravel(), taught])

    return summed(rows, count, 2 * TEXT_SLOTS + 2 * META_SLOTS + 4)


def scored(rows: DataFrame, held) -> DataFrame:
    """doc_id, label, fold, mean log odds and probability of both views, and the combined score."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label int, fold int, x_text double, x_meta double, p_text double, p_meta double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, meta, _, _ in _batches(batches):
            x_text, x_meta = view_scores(held.value, part, meta)
            own = batch.slice(part.first, len(part))
            arrays = [pa.array(a) for a in (x_text, x_meta, *held.value.score(x_text, x_meta))]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(4), own.column(5), *arrays], names=["doc_id", "label", "fold", "x_text", "x_meta", "p_text", "p_meta", "score"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, limit: int = MAX_LABELS) -> Model:
    """Train both views on ``docs`` (doc_id, text, lang, source) from ``label_sample(labels)``.

    Without labels of both classes among the documents the model is untrained and says 0.5.
    """
    spark = docs.sparkSession
    sample = label_sample(labels, limit=limit)
    chosen = spark.createDataFrame([tuple(r) for r in sample.collect()], sample.schema)  # at most ``limit`` rows
    labelled, every = _columns(docs, chosen, "inner"), _columns(docs, chosen)
    blank = Model(View(np.zeros(TEXT_SLOTS)), View(np.zeros(META_SLOTS)), trained=False)
    model, history = None, []
    for number in range(rounds + 1):
        held = spark.sparkContext.broadcast(model) if model else None
        counts = train_counts(every if model else labelled, held)
        split = 2 * TEXT_SLOTS
        text, meta = counts[:split].reshape(2, -1), counts[split : split + 2 * META_SLOTS].reshape(2, -1)
        if number == 0 and not (meta.sum(axis=1) > 0).all():
            return blank
        history.append(counts[split + 2 * META_SLOTS :].tolist())
        raw = Model(View(log_odds(text)), View(log_odds(meta)))
        rows = scored(labelled, spark.sparkContext.broadcast(raw)).where("fold = 0").select("x_text", "x_meta", "label").collect()
        table_ = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 3)
        model = calibrated(raw, table_, history)
    return model


def calibrated(raw: Model, rows: np.ndarray, history: list) -> Model:
    """Calibrate both views and their combination on (x_text, x_meta, label) rows that trained neither."""
    x, y = rows[:, :2], rows[:, 2]
    if len(y) == 0 or y.min() == y.max():
        return Model(raw.text, raw.meta, rounds=history)
    (ta, tb), (ma, mb) = logistic(x[:, :1], y), logistic(x[:, 1:], y)
    text, meta = View(raw.text.odds, ta, tb), View(raw.meta.odds, ma, mb)
    weights = logistic(np.column_stack([text.logit(x[:, 0]), meta.logit(x[:, 1])]), y)
    return Model(text, meta, tuple(weights.tolist()), rounds=history)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept of each row of ``docs``, whole texts.

    Null texts, languages and sources are empty ones and are scored like others. Repeated
    rows and null ids are kept, a row each; other columns are left out; an empty table gives
    an empty result. An untrained model keeps everything.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = scored(_columns(docs, None), held)
    if not model.trained:
        out = out.withColumns({c: F.lit(0.5) for c in ("p_text", "p_meta", "score")})
    return out.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= threshold).alias("kept"))


@register("op10_cotraining")
def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rated = classify(docs, model)
    return rated.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "score")), "kept")
