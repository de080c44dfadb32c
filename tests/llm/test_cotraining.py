import numpy as np
import pyarrow as pa

from cohortlens.llm import cotraining as c
from cohortlens.llm.arrays import slices
from cohortlens.llm.counts import summed


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = c.fit(docs, labels.where("doc_id % 3 > 0"))
    assert model.trained and model.rounds[0] == [0, 0, 0, 0] and min(model.rounds[1]) > 0
    out = c.classify(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert sum(not r.kept for r in bad) > 0.7 * len(bad)
    wins = np.mean([[(g.score > b.score) + 0.5 * (g.score == b.score) for b in bad] for g in good])
    assert wins > 0.96
    brier = np.mean([(r.score - r.quality) ** 2 for r in out])
    assert brier < 0.06  # the share of bad documents alone would give about 0.12


def test_edges(spark):
    rows = [(k, ("### $$$ !! " if k % 4 == 0 else "plain words here ") * (1 + k % 7), "en", "a", 7) for k in range(80)]
    rows += [(200, None, None, None, 7), (201, "", "", "", 7), (None, "plain words", "en", "a", 7), (3, rows[3][1], "en", "a", 7), (202, "word " * 50000, "en", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    votes = [(k, int(k % 4 != 0)) for k in range(60)] + [(7, 0), (7, None), (None, 1), (900, 1), (8, 0)]
    labels = spark.createDataFrame(votes, "doc_id long, quality int")
    sample = {r.doc_id: r.label for r in c.label_sample(labels).collect()}
    assert 7 not in sample and None not in sample and sample[8] == 0 and len(sample) == 60
    assert c.label_sample(labels, limit=10).count() == 10
    model = c.fit(docs, labels)
    out = c.classify(docs, model).collect()
    assert len(out) == len(rows)
    verdict = {r.doc_id: r.kept for r in out}
    assert not verdict[64] and verdict[65] and verdict[202]
    assert all(0 <= r.score <= 1 for r in out)
    one = c.fit(docs, labels.where("quality = 1"))
    assert not one.trained and all(r.kept for r in c.classify(docs, one).collect())
    assert not c.fit(docs, labels.limit(0)).trained
    assert c.classify(docs.limit(0), model).count() == 0


def test_same_counts_for_any_partitioning(spark):
    df = spark.createDataFrame([(k % 50,) for k in range(3000)], "v int")

    def count(batches):
        out = np.zeros(1000, dtype=np.int64)
        for b in batches:
            out += np.bincount(b.column(0).to_numpy(), minlength=1000)
        return out

    for n in (1, 7):
        got = summed(df.repartition(n), count, 1000)
        assert got[:50].tolist() == [60] * 50 and got[50:].sum() == 0


def test_log_odds_and_logistic():
    odds = c.log_odds(np.array([[10, 0, 0, 5], [10, 20, 0, 5]]))
    assert odds[2] == 0 and odds[1] > 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < c.sigmoid(1.5 * x[:, 0] - 0.5 * x[:, 1] + 0.3)).astype(float)
    assert np.allclose(c.logistic(x, y), [1.5, -0.5, 0.3], atol=0.15)


def test_meta_slots_follow_the_page():
    part = next(slices(pa.array(["a b\nc", "$$$ AAA 11"])))
    slots = c.meta_slots(part, ["en", "en"], ["x", "y"])
    assert slots.shape == (2, 9) and slots[0, 0] == slots[1, 0] and slots[0, 1] != slots[1, 1]
