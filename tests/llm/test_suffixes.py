import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import suffixes as s


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + s.LENGTH] for d in data for i in range(len(d) - s.LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - s.LENGTH + 1):
            if seen[d[i : i + s.LENGTH]] > 1:
                gone[i : i + s.LENGTH] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ漢") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(50, 260)) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [prose(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(len(parts) + 1), p[a : len(p) - rng.randrange(0, 20)])
        texts.append("\n".join(parts))
    texts += texts[:4] + ["", None, "short", "short", "x" * 1500, "xy" * 300, passages[0][:400], passages[1]]
    twice = prose(90)
    return texts + [twice + " middle " + twice, "a" * 399, "a" * 399]


def results(df, **options):
    out = {}
    for r in s.repeated_spans(df, **options).collect():
        if r.n_equal > 1 and r.n_bytes >= s.LENGTH:
            got = (r.n_bytes, r.n_bytes, 1, hashlib.sha256(b"").hexdigest())
        elif r.cut is None:
            got = (r.n_bytes, 0, 0, r.sha)
        else:
            got = (r.n_bytes, r.cut.n_removed, len(r.cut.spans), hashlib.sha256(bytes(r.cut.kept)).hexdigest())
        out.setdefault(r.doc_id, []).append(got)
    return out


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"hot": 1, "bucket_rows_target": 40})])
def test_equals_brute_force(spark, seed, options):
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, sha string")
    got = results(df, **options)
    for k, want in enumerate(brute(texts)):
        assert got[k] == [(*want[:3], hashlib.sha256(want[3]).hexdigest())], k


def test_repeated_and_missing_ids(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdef ") for _ in range(900))
    other = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = [(1, text), (1, other), (None, text[100:] + "!"), (None, "n"), (2, other[:450]), (2, other[:450])]
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x[1] for x in got[1]) == [450, 800]
    assert sorted(x[1] for x in got[None]) == [0, 800]
    assert [x[1] for x in got[2]] == [450, 450]
    assert s.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_passage_is_one_row_for_all_holders(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(1200)
    texts = [prose(rng.randrange(500)) + passage + prose(rng.randrange(500)) for _ in range(120)] + [passage] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = results(df)
    for k, want in enumerate(brute(texts)):
        assert got[k] == [(*want[:3], hashlib.sha256(want[3]).hexdigest())], k
    grams = {g for part in s.slices(pa.array([passage])) for found in s.samples(part) for g in found[4].view(np.int64).tolist()}
    held = spark.createDataFrame([(bytes(16), sorted(grams), passage), (bytes(15) + b"1", sorted(grams), passage)], "owner binary, grams array<long>, text string")
    rows = s.aligned(held.coalesce(1), True).collect()
    assert sum(r.body is not None for r in rows) == len({r.name for r in rows})


def test_sliding_least():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 1000).astype(np.uint64)
    for width in (1, 7, 273, 1000):
        assert (s.sliding_least(v, width) == np.lib.stride_tricks.sliding_window_view(v, width).min(axis=1)).all()


def test_samples_do_not_depend_on_the_chunk(monkeypatch):
    from cohortlens.llm.arrays import slices

    rng = random.Random(3)
    texts = pa.array(["".join(rng.choice("abcd") for _ in range(5000)), "", "".join(rng.choice("abcd") for _ in range(900))])

    def starts():
        out = {}
        for part in slices(texts):
            for doc, place, first, last, gram in s.samples(part):
                for row in zip(doc.tolist(), place.tolist(), first.tolist(), last.tolist(), gram.tolist()):
                    for k in range(row[2], row[3] + 1):
                        out[k] = (row[0], row[1], row[4])
        return out

    whole = starts()
    monkeypatch.setattr(s, "CHUNK", 700)
    assert starts() == whole and len(whole) == 5000 - 399 + 900 - 399
