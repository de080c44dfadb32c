"""Similarity operators against the small fixtures and against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import greedy, search, tiles, vectors
from cohortlens.streaming.arrivals import check_arrivals, check_batch

SCHEMA = "row_index long, project_name string, year string, cohort_id string, sector string, text string, vec array<float>"


def idea(i, name, vec, problem="p", solution="s", cohort="2024-1"):
    text = f"Project: {name}\nProblem: {problem}\nSolution: {solution}"
    return (i, name, "2024", cohort, "Tech", text, [float(x) for x in vec])


@pytest.fixture(scope="module")
def dup(spark):
    rows = [
        idea(0, "Alpha", (1, 0, 0, 0), "shared problem", "solution one"),
        idea(1, "Alpha", (1, 0, 0, 0), "shared problem", "solution one"),
        idea(2, "ALPHA", (0.99, 0.1, 0, 0), "shared problem with extra words", "solution one with extra words"),
        idea(3, "Beta", (0.88, 0.35, 0, 0), "shared problem", "solution two", "2024-2"),
        idea(4, "Gamma", (0, 1, 0, 0), "other problem", "other solution", "2024-2"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def base(spark):
    rows = [idea(0, "A", (1, 0, 0, 0)), idea(1, "A again", (0.99, 0.1, 0, 0)), idea(2, "B", (0, 1, 0, 0)), idea(3, "C", (0.5, 0.5, 0, 0.8))]
    return spark.createDataFrame(rows, SCHEMA)


def names(df):
    return sorted(r.project_name for r in df.collect())


def test_dedup(dup):
    assert names(greedy.dedup_exact(dup)) == ["ALPHA", "Beta", "Gamma"]
    assert names(greedy.dedup_index(dup)) == ["ALPHA", "Beta", "Gamma"]


def test_pairs(dup):
    got = vectors.top_similar_pairs(dup, "Very similar").collect()
    assert len(got) == 6 and {r.level for r in got} == {"Nearly identical", "Very similar"}
    assert (got[0].l, got[0].r, got[0].left_problem) == (0, 1, "shared problem")
    assert len(vectors.similar_pairs(dup, 0.92, 2).collect()) == 2


@pytest.mark.parametrize("threshold, cap, groups, edges", [(0.70, 12, [["ALPHA", "Beta"]], 1), (0.97, 12, [], 0), (0.0, 2, [["ALPHA", "Beta"]], 1)])
def test_groups(dup, threshold, cap, groups, edges):
    members, inside = greedy.clusters(greedy.dedup_index(dup), threshold, cap)
    got = members.collect()
    found = [sorted(r.project_name for r in got if r.cluster_id == c) for c in sorted({r.cluster_id for r in got})]
    assert found == groups and inside.count() == edges
    if edges and threshold == 0.70:
        partner = greedy.closest_partner(inside).orderBy("row_index").collect()
        assert [(r.row_index, r.partner, r.band) for r in partner] == [(2, 3, "Very similar"), (3, 2, "Very similar")]


def queries_of(spark, *vecs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "query_id long, vec array<float>")


def test_top_k(spark, base):
    asked = queries_of(spark, (1, 0, 0, 0))
    got = vectors.rank_matches(base, asked, 3, 0.5).orderBy("rank").collect()
    assert [r.project_name for r in got] == ["A", "A again"] and got[0].level == "Very similar"
    assert names(vectors.rank_matches(base, asked, 3, 1.0)) == ["A"]
    assert vectors.match_ids(base, asked.filter("1 = 0")).count() == 0


def test_large_query_set_takes_the_shuffled_way(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 5))
    index = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "row_index long, vec array<double>")
    asked = queries_of(spark, *rng.normal(size=(9, 5)))
    scan = {tuple(r) for r in vectors.match_ids(index, asked, 4, 0.1).collect()}
    monkeypatch.setattr(vectors, "MAX_QUERY_BYTES", 8)
    shuffled = {tuple(r) for r in vectors.match_ids(index, asked, 4, 0.1).select("query_id", "row_index", "sim", "rank").collect()}
    assert scan == shuffled and scan


def cloud(seed, n, dim, spread):
    """Clustered vectors with a crowd of near copies, exact copies and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    which = rng.choice(5, size=n, p=[0.4, 0.2, 0.2, 0.1, 0.1])
    vecs = centres[which] + spread * rng.normal(size=(n, dim))
    vecs[3] = vecs[4] = vecs[5]
    vecs[8] = vecs[9] = 0
    return vecs, rng.integers(1, 6, size=n)


def similarity(vecs):
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    return np.round(unit @ unit.T, 9)


def sequential_drops(vecs, lengths, threshold):
    sims, n = similarity(vecs), len(vecs)
    order = sorted((-sims[i, j], i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] >= threshold)
    dropped = set()
    for _, i, j in order:
        if i not in dropped and j not in dropped:
            dropped.add(j if lengths[i] >= lengths[j] else i)
    return dropped


def sequential_groups(vecs, threshold, cap):
    sims, n = similarity(vecs), len(vecs)
    np.fill_diagonal(sims, -9)
    near = [[j for j in range(n) if sims[i, j] >= threshold] for i in range(n)]
    order = sorted(range(n), key=lambda i: (-len(near[i]), -max([sims[i, j] for j in near[i]], default=0.0), i))
    taken, out, number = set(), set(), 0
    for a in order:
        free = sorted((j for j in near[a] if j not in taken), key=lambda j: (-sims[a, j], j))[: cap - 1]
        if a in taken or not free:
            continue
        taken |= {a, *free}
        out |= {(number, i) for i in (a, *free)}
        number += 1
    return out


def frame(spark, vecs, lengths):
    rows = [(i, [float(x) for x in v], "x" * int(k)) for i, (v, k) in enumerate(zip(vecs, lengths))]
    return spark.createDataFrame(rows, "row_index long, vec array<double>, text string").repartition(3)


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "MAX_TILE_ROWS", 32)
    monkeypatch.setattr(tiles, "MIN_TILE_ROWS", 16)


def test_pair_search_equals_brute_force(spark, small_tiles):
    vecs, lengths = cloud(1, 90, 6, 0.4)
    sims = similarity(vecs)
    want = sorted((-sims[i, j], i, j) for i in range(90) for j in range(i + 1, 90) if sims[i, j] >= 0.9)
    got = vectors.pair_edges(frame(spark, vecs, lengths).withColumnRenamed("row_index", "id"), 0.9, 40).collect()
    assert [(r.l, r.r) for r in got] == [(i, j) for _, i, j in want[:40]]


def test_near_duplicates_equal_the_sequential_walk(spark, small_tiles):
    vecs, lengths = cloud(2, 70, 5, 0.35)
    df = frame(spark, vecs, lengths)
    want = sequential_drops(vecs, lengths, 0.95)
    assert {r.row_index for r in greedy.near_duplicates(df, 0.95, partners=4).collect()} == want and len(want) > 20


@pytest.mark.parametrize("sparse_degree", [64, 0])
def test_groups_equal_the_sequential_walk(spark, small_tiles, sparse_degree):
    vecs, lengths = cloud(4, 60, 5, 0.4)
    got = greedy.group_members(frame(spark, vecs, lengths), 0.93, 4, sparse_degree).collect()
    assert {(r.cluster_id, r.row_index) for r in got} == sequential_groups(vecs, 0.93, 4)


def test_dense_groups_take_few_passes(spark, monkeypatch):
    vecs, lengths = cloud(5, 100, 5, 0.4)
    vecs = np.concatenate([vecs, vecs[:1].repeat(20, axis=0)])
    lengths = np.ones(len(vecs))
    passes, real = [], greedy.listed_neighbours
    monkeypatch.setattr(greedy, "listed_neighbours", lambda *given: passes.append(given[-1]) or real(*given))
    monkeypatch.setattr(greedy, "MAX_LISTED", 240)
    monkeypatch.setattr(greedy, "MAX_FOUND", 100)
    got = greedy.group_members(frame(spark, vecs, lengths), 0.2, 4, 8).collect()
    wanted = sequential_groups(vecs, 0.2, 4)
    assert {(r.cluster_id, r.row_index) for r in got} == wanted and len(got) == len(wanted)
    assert sorted(r.cluster_id for r in got if r.is_anchor) == sorted({c for c, _ in wanted})
    assert max(passes) > 8 and len(passes) < len({c for c, _ in wanted}) / 2  # a list ran out; far fewer passes than groups


def test_keyword_search(spark, base):
    assert [r.project_name for r in search.keyword_search(base, " AGAIN  a").orderBy("rank").collect()] == ["A again", "A"]
    asked = queries_of(spark, (1, 0, 0, 0))
    hit = search.search_frame(search.search(base, "again", asked))
    assert hit.columns == ["Project", "Year", "Cohort", "Sector", "Problem", "Solution"]
    assert [r.Project for r in hit.collect()] == ["A again"]
    assert {r["match"] for r in search.search(base, "zzz", asked).collect()} == {"semantic"}


def test_pack_batches(spark):
    sizes = [4, 4, 400, 40, 4, 4, 4]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "row_index long, text string")
    got = search.pack_batches(df, rows=3, budget=100).orderBy("row_index").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 2, 2, 3] and [r.tokens for r in got][:3] == [1, 1, 100]


def test_embed(spark, base):
    got = search.embed(base, dimensions=32).collect()
    assert len(got) == 4 and all(len(r.vec) == 32 for r in got)

    def ones(batches):
        for batch in batches:
            yield batch[["row_index"]].assign(vec=[[1.0, 0.0]] * len(batch))

    assert {tuple(r.vec) for r in search.embed(base, ones).collect()} == {(1.0, 0.0)}


def test_sparse_vectors_and_matches(spark):
    texts = ["red apple pie", "red apple tart", "green pear", "", None, "red red pie crust", "green pear", "pie"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_index long, text string")
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % search.SLOTS
    want = {}
    for i, own in enumerate(words):
        weights = {w: own.count(w) * math.log((len(texts) + 1) / (sum(w in o for o in words) + 1)) for w in set(own)}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        want.update({(i, slot(w)): x / norm for w, x in weights.items()})
    entries = search.embed_sparse(df)
    got = {(r.row_index, r.slot): r.x for r in entries.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    for tile in (2, 100):
        found = search.sparse_matches(entries, entries.filter("row_index % 2 = 0"), 3, tile).collect()
        for i in range(0, len(texts), 2):
            dots = {j: round(sum(x * want.get((j, s), 0) for (k, s), x in want.items() if k == i), 9) for j in range(len(texts)) if j != i}
            best = sorted(((-d, j) for j, d in dots.items() if d > 0))[:3]
            assert sorted((r.place, r.row_index, r.similarity) for r in found if r.query_id == i) == [(n, j, pytest.approx(-d)) for n, (d, j) in enumerate(best, 1)]
    assert search.sparse_matches(entries.limit(0), entries, 3).count() == 0
    assert search.embed_sparse(df.limit(0)).count() == 0


def test_arrivals(spark, base, tmp_path):
    rows = [
        (1, "idea one", "a long description", [1.0, 0.0, 0.0, 0.0]),
        (2, "idea one", "a long description", [1.0, 0.0, 0.0, 0.0]),
        (3, "short", "text", [1.0, 0.0, 0.0, 0.0]),
        (4, "other idea", "another description", [0.0, 1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "query_id long, idea string, description string, vec array<float>").withColumn(
        "arrived_at", F.lit("2024-01-01").cast("timestamp")
    )
    got = {(r.query_id, r.row_index) for r in check_batch(df, base).collect()}
    assert got == {(1, 0), (1, 1), (1, 3), (4, 2), (4, 3)} or got == {(1, 0), (1, 1), (4, 2)}
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    query = check_arrivals(stream, base, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert query.exception() is None
    streamed = {(min(r.query_id, 2), r.row_index) if r.query_id < 3 else (r.query_id, r.row_index) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {r for _, r in streamed} == {r for _, r in got} and {q for q, _ in streamed} in ({1, 4}, {2, 4})
    # started again, the stream checks nothing twice; a later file brings one known and one new text
    more = [(7, "other idea", "another description", [0.0, 1.0, 0.0, 0.0]), (8, "third idea", "with a description", [0.0, 0.0, 1.0, 0.0])]
    late = spark.createDataFrame(more, "query_id long, idea string, description string, vec array<float>").withColumn("arrived_at", F.lit("2024-01-02").cast("timestamp"))
    for step, added in (("replayed", set()), ("later", {8})):
        if added:
            late.select(*df.columns).coalesce(1).write.mode("append").parquet(folder)
        query = check_arrivals(spark.readStream.schema(df.schema).parquet(folder), base, str(tmp_path / "out"), str(tmp_path / "state"), min_score=-1.0)
        query.awaitTermination(60)
        asked = {r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert asked - {1, 2, 4} == added, step


@pytest.mark.parametrize("seed", [1, 2])
def test_pack_batches_over_many_blocks(spark, seed, monkeypatch):
    """Equals the walk over all texts, whatever the blocks."""
    rng = random.Random(seed)
    sizes = [rng.choice([0, 4, 40, 200, 390, 900]) for _ in range(500)]
    df = spark.createDataFrame([(3 * i, "x" * n) for i, n in enumerate(sizes)], "row_index long, text string")
    want, count, used, batch = [], 0, 0, 0
    for n in sizes:
        tokens = max(1, n // 4)
        if count and (count == 5 or used + tokens > 150):
            batch, count, used = batch + 1, 0, 0
        want.append(batch)
        count, used = count + 1, used + tokens
    monkeypatch.setattr(search, "PACK_FAN", 4)
    got = search.pack_batches(df.repartition(7), rows=5, budget=150, block=10).orderBy("row_index").collect()
    assert [r.batch for r in got] == want
    assert search.pack_batches(df.limit(0)).count() == 0


def test_missing_vectors_are_no_copies(spark):
    rows = [(0, "long text", [1.0, 0.0]), (1, "a", None), (2, "b", None), (3, "c", None), (4, "z", [0.0, 0.0]), (5, "z", [0.0, 0.0]), (6, "long", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_index long, text string, vec array<float>")
    assert {r.row_index for r in greedy.near_duplicates(df, 0.9).collect()} == {6}


def test_similarity_of_one_across_cells(spark, monkeypatch):
    """Vectors a hair apart round to a similarity of 1 and must not be pruned."""
    monkeypatch.setattr(tiles, "MIN_TILE_ROWS", 2)
    monkeypatch.setattr(tiles, "MAX_TILE_ROWS", 2)
    rows = [(i, [1.0, i * 1e-6]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = tiles.unit_rows(np.array([v for _, v in rows]))
    want = int(np.triu(np.round(unit @ unit.T, tiles.SIM_DIGITS) >= 1, 1).sum())
    assert vectors.pair_edges(df, 1.0, None).count() == want > 700
