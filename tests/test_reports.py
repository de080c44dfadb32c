"""Loaders, filters, joins, reports and repeat submissions on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import filters, joins, reports, rubric
from cohortlens.operators.repeats import repeat_submissions
from cohortlens.sources import index as I
from cohortlens.sources import tables as T


@pytest.fixture(scope="module")
def apps(spark):
    rows = [
        (1, "Alpha", "2023", "arabic", "2023-2", "Tech", "Accepted", "1", "Team"),
        (2, "Beta ", "2023.0", "English", "2023-1", "Tech", "Rejected", "2", "solo"),
        (3, "ALPHA", "2024", "English", "2024-1", "Food", "Accepted", "6", "group"),
        (4, "Gamma", "2024", " Eng ", "2024-1", "Not Specified", "Accepted", "5+", None),
        (5, None, "bad", None, None, None, "Rejected", None, "ind"),
    ]
    raw = spark.createDataFrame(
        rows,
        "row_id long, project_name string, year string, cohort string, cohort_id string, Sector string, "
        "outcome_clean string, team_member_count string, individual_or_team string",
    )
    return T.load_applications(raw.withColumn("noise", F.lit(1)), keep=["row_id"])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_loading(apps):
    assert "noise" not in apps.columns and dict(apps.dtypes)["year"] == "int"
    assert [r.cohort for r in apps.orderBy("row_id").collect()] == ["Arabic", "English", "English", "English", None]
    assert [r.applicant_type for r in apps.orderBy("row_id").collect()] == ["Team", "Individual", "Team", None, "Individual"]


def test_dataset_recognition(spark):
    a = spark.range(1).selectExpr("1 AS x", "1 AS year", "1 AS cohort")
    b = spark.range(1).selectExpr("1 AS year", "1 AS cohort", "1 AS Sector")
    assert T.match_dataset([a, b], T.APPLICATION_COLUMNS) is b
    with pytest.raises(ValueError):
        T.match_dataset([a], T.APPLICATION_COLUMNS)
    assert not T.has_model_schema(b) and T.choose_model_table([a, b]) is a


def test_csv_with_bom_and_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿year,project_name,note\n2024,"a ""b""\nc",NA\nx,,\n', encoding="utf-8")
    typed = T.read_table(spark, str(path), T.APPLICATION_SCHEMA).collect()
    assert typed[0].year == 2024 and typed[0].project_name == 'a "b"\nc' and typed[1].year is None
    text = T.read_strings(spark, str(path)).collect()
    assert text[0].note == "NA" and text[1].project_name == "" and text[1].note == ""


def test_filters(apps):
    assert rows(filters.apply_filters(apps, years=[2024], types=["Team"]), "row_id") == [(3,)]
    assert filters.apply_filters(apps).count() == 5
    raw = apps.drop("applicant_type", "cohort")
    loose = filters.apply_filters(raw, strict=False, cohorts=["English"], types=["group"])
    assert rows(loose, "row_id") == [(3,)]
    with pytest.raises(ValueError):
        filters.assert_no_leak(["age", "is_winner"])
    assert [r.Sector for r in filters.filter_options(apps, "Sector").collect()] == ["Food", "Not Specified", "Tech"]


def test_kpis_and_distribution(apps):
    assert tuple(reports.kpis(apps).first()) == (5, 3, 60.0)
    assert reports.kpis(apps.filter("1 = 0")).first().rate == 0.0
    got = rows(reports.distribution(apps, "Sector"), "label", "n", "pct", "text", "note")
    assert got == [("Food", 1, 33.3, "1", "1 Not Specified"), ("Tech", 2, 66.7, "2", "1 Not Specified")]
    shares = rows(reports.distribution(apps, "Sector", top=1, percent=True), "label", "text", "note")
    assert shares == [("Tech", "100.0%", "20.0% Not Specified")]


def test_team_sizes(apps):
    got = reports.team_size_distribution(apps).collect()
    assert [(r.label, r.n) for r in got] == [("2", 1), ("3", 0), ("4", 0), ("5", 0), ("5+", 2)]
    assert got[0].note == "1 Not Specified"
    assert reports.team_size_distribution(apps, percent=True).first().note == "25.0% Not Specified"


def test_crosstab_and_cohorts(apps):
    got = rows(reports.crosstab(apps, "cohort", "outcome_clean", percent=True), "a", "b", "n", "text")
    assert got == [("Arabic", "Accepted", 1, "100.0%"), ("English", "Accepted", 2, "66.7%"), ("English", "Rejected", 1, "33.3%")]
    assert rows(reports.crosstab(apps, "Sector", "outcome_clean", top=1), "a") == [("Tech",), ("Tech",)]
    assert rows(reports.cohort_scope(apps, ("2023",)), "row_id") == [(1,), (2,)]
    odd = apps.withColumn("cohort_id", F.when(F.col("row_id") == 1, "spring").otherwise(F.col("cohort_id")))
    assert reports.cohort_scope(odd, ("2023",)).count() == 5
    no_ids = apps.withColumn("cohort_id", F.lit(None).cast("string"))
    assert rows(reports.cohort_scope(no_ids).filter("cohort_key IS NOT NULL"), "cohort_key")[0] == ("Arabic",)


def test_attendance(spark, apps):
    att = spark.createDataFrame(
        [(1, 5, 2, 5, 0, "  alpha", 1.0), (2, 2, 1, 1, 1, "BETA", 0.5), (3, 4, 1, 2, 0, "gamma", 0.2), (4, 3, 0, 0, 0, "nobody", 0.1), (5, 1, 1, 1, 0, None, None)],
        "k long, sessions_scheduled int, attendance_member_rows int, member_days_present int, member_days_virtual int, "
        "matched_project_name string, member_attendance_rate double",
    )
    joined = joins.join_attendance(att, apps, "row_id")
    assert joined.count() == 5
    assert rows(joined.filter("Sector IS NOT NULL"), "k", "Sector") == [(1, "Tech"), (2, "Tech"), (3, "Not Specified")]
    assert tuple(joins.matched_count(joined).first()) == (3, 5)
    assert joins.join_attendance(att.drop("matched_project_name"), apps, "row_id").count() == 5
    summary = reports.attendance_summary(joined, "Sector").collect()
    assert [(r.label, r.projects, r.attended, r.opportunities, r.rate, r.missing) for r in summary] == [("Tech", 2, 7.0, 12.0, 58.3, 2)]
    assert reports.attendance_summary(apps, "Sector").count() == 0
    scaled = reports.attendance_pct(att, "member_attendance_rate", "p")
    assert [r.p for r in scaled.orderBy("k").collect()] == pytest.approx([100.0, 50.0, 20.0, 10.0, None])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "ArrowEvalPython" not in plan


def test_analyst_reports(apps):
    top = reports.top_categories(apps, "Sector", 2).collect()
    assert [(r.value, r.n) for r in top] == [("Not Specified", 2), ("Tech", 2)]
    with pytest.raises(ValueError):
        reports.top_categories(apps, "nope")
    kpi = reports.analyst_kpis(apps).first()
    assert (kpi.applications, kpi.teams, kpi.home, kpi.years) == (5, 2, 0, "2023,2024")
    got = {r.column: (r.nulls, r.distinct_values) for r in reports.profile(apps).collect()}
    assert got["Sector"] == (1, 3) and got["row_id"] == (0, 5)
    quick = {r.column: r.nulls for r in reports.profile(apps, approximate=True).collect()}
    assert quick["Sector"] == 1
    lines = [r.line for r in reports.narrative(apps, limit=6).collect()]
    assert [r.line for r in reports.narrative(apps).collect()][:7] == lines
    assert lines[0].startswith("The dashboard contains 5 application records. Acceptance rate is 60.0%")
    assert lines[1] == "Top Sector: Not Specified (2), Tech (2), Food (1)." and len(lines) == 7


REPEATS = [
    (0, 2024, "2024-1", "Repeat Idea", "1990-01-01", "Technology & IT", "Rejected", "solo", "p1", "s1"),
    (1, 2024, "2024-2", "Repeat Idea ", "1990-01-01", "Technology & IT", "Accepted", "Team", "p2", "s2"),
    (2, 2024, "2024-2", "Single Idea", "1991-02-02", "Food & Beverage", "Rejected", "solo", "p3", "s3"),
    (3, 2025, "2025-1", "Repeat Idea", "1989-03-03", "Food & Beverage", "Rejected", "solo", "p4", "s4"),
    (4, 2025, "2025-2", "Repeat Idea", "1989-03-03", "Food & Beverage", "Rejected", "solo", "nan", "s5"),
]
REPEAT_COLUMNS = "row_id long, year int, cohort_id string, project_name string, date_of_birth string, Sector string, outcome_clean string, individual_or_team string, problem_en string, solution_en string"


def test_repeat_submissions(spark):
    df = spark.createDataFrame(REPEATS, REPEAT_COLUMNS)
    got = repeat_submissions(df, "row_id").orderBy("year").collect()
    assert [r.year for r in got] == [2024, 2025]
    assert (got[0].cohort_1, got[0].cohort_2, got[0].outcome_1, got[0].outcome_2) == ("2024-1", "2024-2", "Rejected", "Accepted")
    assert got[0].applicant_type == "Team" and got[0].idea_text == "p2\ns2" and got[1].idea_text == "s5"
    assert repeat_submissions(df, "row_id", outcomes=["Accepted"]).count() == 1
    assert repeat_submissions(df, "row_id", years=[2025], types=["Individual"]).count() == 1
    assert repeat_submissions(df, "row_id", sectors=["Food & Beverage"], types=["Team"]).count() == 0
    assert repeat_submissions(df.drop("date_of_birth"), "row_id").count() == 2
    assert repeat_submissions(df.drop("cohort_id"), "row_id").count() == 0
    same = df.filter("row_id = 0").union(df.filter("row_id = 0"))
    assert repeat_submissions(same, "row_id").count() == 0


def test_index_store(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "row_index long, text string, vec array<float>")
    folder = str(tmp_path / "index")
    assert I.load_index(spark, folder) is None
    I.write_index(docs, folder, "m")
    stored = I.load_index(spark, folder)
    assert stored.count() == 2
    changed = docs.withColumn("text", F.when(F.col("row_index") == 1, "c").otherwise(F.col("text"))).withColumn("text_hash", F.sha2("text", 256))
    assert rows(I.stale_rows(changed, stored), "row_index") == [(1,)]
    assert I.index_is_current(stored, stored, "m", "m")
    assert not I.index_is_current(changed, stored, "m", "m") and not I.index_is_current(stored, stored, "m", "n")
    uneven = docs.union(spark.createDataFrame([(2, "x", [1.0])], docs.schema))
    with pytest.raises(ValueError):
        I.write_index(uneven, folder, "m")


def test_index_survives_crashes_and_damage(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "row_index long, text string, vec array<float>")
    newer = docs.withColumn("text", F.concat("text", F.lit("!")))
    folder = str(tmp_path / "index")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert I.write_index(docs, folder, "m") == 1
    held = I.load_index(spark, folder)

    def crash(*_):
        raise RuntimeError("lost between rows and note")

    with monkeypatch.context() as broken:
        broken.setattr(I, "manifest", crash)
        with pytest.raises(RuntimeError):
            I.write_index(newer, folder, "m")
    assert texts(I.load_index(spark, folder)) == ["a", "b"]
    assert I.write_index(newer, folder, "m") == 2
    assert texts(I.load_index(spark, folder)) == ["a!", "b!"] and texts(held) == ["a", "b"]
    assert texts(I.load_index(spark, folder, 1)) == ["a", "b"] and I.load_index(spark, folder, 9) is None
    # the same number of rows with other texts is no whole snapshot
    snapshot = I.read_notes(spark, folder).filter("version = 2").first().snapshot
    other = docs.withColumn("text_hash", F.sha2("text", 256)).collect()
    spark.createDataFrame(other, I.load_index(spark, folder).schema).write.mode("overwrite").parquet(f"{folder}/{snapshot}")
    assert texts(I.load_index(spark, folder)) == ["a", "b"]
    assert I.write_index(newer, folder, "m") == 3
    assert len(I.prune_index(spark, folder, 1)) == 2 and texts(I.load_index(spark, folder)) == ["a!", "b!"]
    assert I.load_index(spark, folder, 1) is None


def test_merge_cache_and_results(spark, tmp_path):
    cache = spark.createDataFrame([("a", 1.0), ("b", None), ("c", None)], "identity string, score double")
    new = spark.createDataFrame([("a", 9.0), ("b", 2.0), ("d", 4.0)], "identity string, score double")
    merged = T.merge_cache(cache, new)
    assert {r.identity: r.score for r in merged.collect()} == {"a": 1.0, "b": 2.0, "c": None, "d": 4.0}
    for ending in ("json", "csv", "parquet"):
        T.write_result(merged, str(tmp_path / f"out.{ending}"))
    assert T.read_table(spark, str(tmp_path / "out.parquet")).count() == 4


def test_halves_round_to_even(spark):
    """6.25 % shows as 6.2, answers of 3.25 and 4.5 at equal weights give 19.2."""
    df = spark.createDataFrame([("Accepted" if k == 0 else "Rejected",) for k in range(16)], "outcome_clean string")
    assert reports.kpis(df).first().rate == 6.2
    criteria = (rubric.Criterion("Alpha", "", 0.5), rubric.Criterion("Beta", "", 0.5))
    flat = spark.createDataFrame([(1, 0, "alpha", "3.25", "r"), (1, 1, "BETA", "4.5", "r")], "review_id long, slot int, dimension string, score string, rationale string")
    row = rubric.score_payloads(flat, criteria).first()
    assert [d.score for d in row.dimensions] == [3.2, 4.5] and row.total_score == 19.2


def test_sources_are_numbered_per_idea(spark):
    rows = [(1, 0, "http://a", "t", "x" * 900), (1, 1, " http://a ", None, "y"), (2, 0, "http://b", "", None), (2, 1, "http://c", "t", "z"), (2, 2, "ftp://d", "t", "z")]
    hits = spark.createDataFrame(rows, "idea_id long, position int, url string, title string, content string")
    got = rubric.dedupe_sources(hits).orderBy("idea_id", "position").collect()
    assert [(r.idea_id, r.position, r.url, r.title, len(r.snippet)) for r in got] == [(1, 0, "http://a", "t", 900), (2, 0, "http://b", "http://b", 0), (2, 1, "http://c", "t", 1)]
    assert max(len(r.snippet) for r in rubric.dedupe_sources(hits, chars=700).collect()) == 700
