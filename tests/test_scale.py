"""Plans and bounds that keep large tables out of the driver and out of single tasks."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import learning as M
from cohortlens.sources import roles as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"p{i % 60}", int(i % 60 % 3 == 0), float(i % 7), "ab"[i % 2]) for i in range(120)]
    return spark.createDataFrame(rows, "row_id long, identity string, y int, n double, c string")


def parts():
    return M.preprocessor(["n"], ["c"], "mean", "minmax")


def test_folds_are_joined_without_broadcasts(people, monkeypatch):
    plans, write = [], M.stage
    monkeypatch.setattr(M, "stage", lambda df: plans.append(plan(df)) or write(df))
    out = M.out_of_fold(people, parts, lambda: M.make_model("bayes"), k=2)
    assert out.count() == 120
    assert "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1]  # rows and probabilities
    assert "BroadcastHashJoin" not in plan(out)
    for df in (M.group_split(people), M.fold_ids(people, 2)):
        assert plan(df).split("Join")[0].endswith("SortMerge")  # the outermost join


def test_customers_are_not_broadcast(spark, tmp_path):
    spark.sql("SELECT 1L o_orderkey, 2L o_custkey, 'F' o_orderstatus, 1.0D o_totalprice, timestamp'2024-01-02' o_orderdate, '2-HIGH' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 2L c_custkey, 'x' c_name, 0 c_nationkey, 1.0D c_acctbal, 'A' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0 n_nationkey, 'N' n_name, 0 n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    apps = R.applications_raw(spark, str(tmp_path))
    assert plan(apps).count("BroadcastHashJoin") == 1  # nations
    assert [r.applicant_name for r in apps.collect()] == ["x"]


def test_answers_are_dealt_before_they_are_sorted(spark):
    from cohortlens.operators import rubric

    flat = spark.createDataFrame([(i, s, "Feasibility", "4", "r") for i in range(20) for s in range(3)], "review_id long, slot int, dimension string, score string, rationale string")
    scored = rubric.score_dimensions(flat, rubric.DEFAULT_CRITERIA)
    text = plan(scored)
    assert "Sort" not in text[text.index("Exchange"):]  # the plan is printed from its end
    assert scored.count() == 20


def test_tasks_follow_the_number_of_answers(spark, monkeypatch):
    from cohortlens.operators import rubric

    monkeypatch.setattr(rubric, "ANSWERS_PER_TASK", 10)
    rows = [(i, s, name, "4", f"r{s}") for i in range(20) for s, name in enumerate(["Feasibility", "FEASIBILITY!", "other", None])]
    flat = spark.createDataFrame([*rows, rows[0]], "review_id long, slot int, dimension string, score string, rationale string")
    scored = rubric.score_dimensions(flat, rubric.DEFAULT_CRITERIA)
    assert "REPARTITION_BY_NUM" in plan(scored) and "hashpartitioning(review_id" in plan(scored) and ", 9)" in plan(scored)
    found = {r.review_id: r.dimensions[4] for r in scored.collect()}
    assert len(found) == 20 and all((d.score, d.rationale, d.evidence) == (4.0, "r0", []) for d in found.values())
    assert rubric.score_dimensions(flat.limit(0), rubric.DEFAULT_CRITERIA).collect() == []


def test_sparse_tiles_send_a_record_an_id(spark):
    from cohortlens.operators import search

    entries = spark.createDataFrame([(i, s, 0.1 * (1 + (i + s) % 5)) for i in range(40) for s in range(i % 4, 9)], "row_index long, slot int, x double")
    asked = entries.filter("row_index % 10 = 0")
    found = search.sparse_matches(entries, asked, 3, 8)
    text = plan(found)
    assert "slots" in text and "FlatMapGroupsInArrow" in text
    whole = search.sparse_matches(entries, asked, 3)
    assert sorted(found.collect()) == sorted(whole.collect()) and found.count() == 12


def test_many_sparse_queries_meet_rows_that_stay_in_place(spark, monkeypatch):
    from cohortlens.operators import search

    entries = spark.createDataFrame([(i, s, 0.1 * (1 + (i * s) % 5)) for i in range(40) for s in range(i % 4, 9)], "row_index long, slot int, x double")
    whole = search.sparse_matches(entries, entries.filter("row_index < 3"), 4)
    found = search.sparse_matches(entries, entries, 4, 8)
    assert "FlatMapGroupsInArrow" in plan(whole) and "FlatMapGroupsInArrow" not in plan(found)
    assert sorted(found.filter("query_id < 3").collect()) == sorted(whole.collect()) and found.count() == 160
    texts = spark.createDataFrame([(1, "a a b"), (1, "b c"), (2, "c"), (3, None)], "row_index long, text string")
    counted = search.word_counts(texts, 1 << 18)
    assert sorted((r.row_index, sorted(r.ns)) for r in counted.collect()) == [(1, [1, 2, 2]), (2, [1]), (3, [])]
    assert "Exchange" not in plan(search.word_counts(texts.filter("row_index > 1"), 1 << 18))


def test_sections_read_the_lines_once(spark):
    from cohortlens.functions import documents as D

    doc = spark.createDataFrame([("Project: a\nProblem: b\nProblem: c",), (None,)], "t string")
    found = doc.select(D.document_sections(F.col("t")).alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.s for r in found.collect()] == [{"Project": "a", "Problem": "c"}, {}]


def test_openings_split_no_more_than_their_words(spark, tmp_path):
    spark.createDataFrame([(1, " a  b c d\ne", "s"), (2, "x", "s"), (3, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ideas = R.idea_documents(spark, str(tmp_path))
    assert " , 4)" in ideas._jdf.queryExecution().optimizedPlan().toString()
    assert {r.row_index: r.project_name for r in ideas.collect()} == {1: "a b c", 2: "x", 3: ""}
