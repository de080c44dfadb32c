"""Labels, text functions and documents."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import documents as D
from cohortlens.functions import labels as L
from cohortlens.functions import text as X

C = F.col


@pytest.mark.parametrize(
    "raw, cohort, kind",
    [
        (" ARABIC round", "Arabic", "Arabic Round"),
        ("eng 2", "English", "Eng 2"),
        (" Mixed ", "Mixed", "Mixed"),
        ("solo_founder", "solo_founder", "Individual"),
        ("IND", "IND", "Individual"),
        ("study_group", "study_group", "Team"),
        (None, None, None),
    ],
)
def test_cohort_and_type(one, raw, cohort, kind):
    assert one(L.clean_cohort(C("v")), L.clean_applicant_type(C("v")), v=raw) == (cohort, kind)


@pytest.mark.parametrize("raw, year", [("2024", 2024), ("2024.0", 2024), ("n/a", None), (None, None)])
def test_year(one, raw, year):
    assert one(L.to_year(C("v")), v=raw) == year


@pytest.mark.parametrize(
    "raw, bucket",
    [("1", None), ("1.5", None), ("2", "2"), ("3.0", "3"), ("6", "5+"), ("5+", "5+"), ("-", "Not Specified"),
     ("nan", "Not Specified"), ("0", "Not Specified"), ("many", "Not Specified"), (None, "Not Specified")],
)
def test_team_size(one, raw, bucket):
    assert one(L.team_size_bucket(C("v")), v=raw) == bucket


def test_missing_rules_differ(one):
    assert one(L.is_missing_group(C("v")), v=" Blank ") is True
    assert one(L.is_missing_label(C("v")), v="blank") is False
    assert one(L.is_missing_label(C("v")), v=" BLANKS") is True
    assert one(L.is_missing_label(C("v")), v=None) is None


@pytest.mark.parametrize("raw, label", [("A / B", "B"), ("A / ", "A / "), ("plain", "plain")])
def test_slash_label(one, raw, label):
    assert one(L.clean_slash_label(C("v")), v=raw) == label


def test_cohort_labels(one):
    assert one(L.cohort_year(C("v")), L.cohort_label(C("v")), v="2024-1") == ("2024", "2024-1 (EN)")
    assert one(L.cohort_year(C("v")), L.cohort_label(C("v")), v="2024-3") == ("2024", "2024-3")
    assert one(L.cohort_year(C("v")), L.cohort_label(C("v")), v="spring") == (None, "spring")


def test_levels(one):
    doc = [one(L.similarity_level(C("v")), v=s) for s in (0.99, 0.93, 0.88, 0.82, 0.75)]
    assert doc == ["Nearly identical", "Very similar", "Similar", "Somewhat similar", "Not similar"]
    query = [one(L.query_level(C("v")), v=s) for s in (0.70, 0.60, 0.52, 0.45)]
    assert query == ["Very similar", "Similar", "Somewhat similar", "Not similar"]


@pytest.mark.parametrize(
    "raw, clean",
    [("  a\t\n b ", "a b"), ("a b", "a b"), ("a  b", "a b"), ("a b", "a b"), ("a  b", "a b"), (None, "")],
)
def test_clean_text(one, raw, clean):
    assert one(X.clean_text(C("v")), v=raw) == clean


@pytest.mark.parametrize(
    "left, right, same",
    [("NOSH Cafe", "Nosh", True), ("Indoor Football Pitch", "Dome Indoor Football Pitches", False),
     ("Pearls of Bahrain", "Pearls bay", False), ("Daribny / دربني", "Daribny", True), ("", "x", False), ("ab", "ab cd", False)],
)
def test_names_share_identity(one, left, right, same):
    assert one(X.names_share_identity(C("a"), C("b")), a=left, b=right) is same


def test_snippet(one):
    assert one(X.snippet(C("v")), v="x" * 160) == "x" * 160
    assert one(X.snippet(C("v")), v="y" * 158 + "   " + "z" * 9) == "y" * 158 + "..."


@pytest.mark.parametrize(
    "text, found",
    [("an AI tool", True), ("air", False), ("a-i", False), ("(ai)", True), ("artificial intelligence!", True),
     ("artificial  intelligence", False), ("éai", False), (None, False)],
)
def test_whole_words(one, text, found):
    assert one(X.has_any(X.words(C("v")), C("v"), ["ai", "artificial intelligence"]), v=text) is found


def test_token_measures(one):
    assert one(X.word_count(C("v")), v=" a  b\nc ") == 3
    assert one(X.unique_ratio(X.measured_words(C("v"))), v="A a b, B c c2") == pytest.approx(4 / 6)
    assert one(X.unique_ratio(X.measured_words(C("v"))), v=None) == 1.0
    pair = X.jaccard(X.measured_words(C("a")), X.measured_words(C("b")))
    assert one(pair, a="x y z", b="y z w") == pytest.approx(0.5)
    assert one(pair, a=None, b=None) == 1.0
    assert one(pair, a="!", b="a") == 0.0


@pytest.mark.parametrize(
    "text, age",
    [("established in 2019", 5), ("running for 3 years", 3), ("selling over 45 yrs", None), ("since 2030", 0), ("new", None)],
)
def test_business_age(one, text, age):
    assert one(X.business_age(C("v"), F.lit(2024)), v=text) == age


def test_split_list(one):
    assert one(X.split_list(C("v")), v=" a ;b,, c ") == ["a", "b", "c"]
    assert one(X.split_list(C("v")), v=None) == []


def test_document_round_trip(spark):
    arabic = "مشكلة"
    df = spark.createDataFrame(
        [("P", " cut\nwaste ", arabic, "cut waste", "k"), (None, None, arabic, None, None), (None,) * 5],
        "project_name string, problem_en string, problem string, solution_en string, keywords string",
    )
    texts = [r.document for r in D.make_document(df).select("document").collect()]
    assert texts[0] == f"Project: P\nProblem: cut waste Original: {arabic}\nSolution: cut waste\nKeywords: k"
    assert texts[1] == f"Problem: {arabic}"
    assert texts[2] == "Unnamed idea"
    doc = spark.createDataFrame([("Problem: a\nnoise\n Problem:  b \nSolution:",)], "t string")
    assert doc.select(D.document_sections(C("t"))).first()[0] == {"Problem": "b", "Solution": ""}


def test_equal_texts_once(spark):
    df = spark.createDataFrame([("same", "same", "x")], "project_name string, problem_en string, solution_en string")
    assert D.make_document(df).first().document == "Project: same\nSolution: x"


def test_idea_ids(spark):
    df = spark.createDataFrame([(0, "a"), (7, "a"), (3, "b"), (12345, "a")], "row_index long, project_name string")
    ids = {r.row_index: r.idea_id for r in D.with_idea_ids(df).collect()}
    assert len(ids[0]) == 12 and ids[7] == ids[0] + "-0007" and ids[12345] == ids[0] + "-12345"
    assert len(set(ids.values())) == 4
