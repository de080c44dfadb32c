"""Label cleaning, missing-value rules and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Labels and thresholds that results depend on.
NOT_SPECIFIED = "Not Specified"
ACCEPTED = "Accepted"
MISSING_LABELS = ("not specified", "blanks")
MISSING_GROUPS = ("", "nan", "none", "null", "not specified", "blanks", "blank")
NO_TEAM_SIZE = ("", "-", "nan", "None", "null")
TEAM_BUCKETS = ("2", "3", "4", "5", "5+")
AGE_ORDER = ("18-24", "25-34", "35-44", "45+", "Not Specified")
COHORT_LANGUAGES = {"1": "EN", "2": "AR"}
DOCUMENT_LEVELS = (
    ("Nearly identical", 0.97),
    ("Very similar", 0.92),
    ("Similar", 0.87),
    ("Somewhat similar", 0.80),
)
QUERY_LEVELS = (
    ("Very similar", 0.65),
    ("Similar", 0.58),
    ("Somewhat similar", 0.50),
)
NO_LEVEL = "Not similar"
SAME_IDEA = 0.92
SAME_IDEA_BAND = "Very similar (likely same idea)"
SAME_CONCEPT_BAND = "Similar (different idea, same concept)"
VERDICTS = (("Strong", 19), ("Promising", 13))


def ladder(col: Column, steps, default: str) -> Column:
    """First label whose floor the value reaches, steps given highest first."""
    out = F.when(col >= steps[0][1], steps[0][0])
    for label, floor in steps[1:]:
        out = out.when(col >= floor, label)
    return out.otherwise(default)


def similarity_level(col: Column) -> Column:
    return ladder(col, DOCUMENT_LEVELS, NO_LEVEL)


def query_level(col: Column) -> Column:
    return ladder(col, QUERY_LEVELS, NO_LEVEL)


def relation_band(col: Column) -> Column:
    return ladder(col, ((SAME_IDEA_BAND, SAME_IDEA),), SAME_CONCEPT_BAND)


def verdict(total: Column) -> Column:
    return F.when(total.isNull(), "Insufficient Evidence").otherwise(ladder(total, VERDICTS, "Weak"))


def clean_cohort(col: Column) -> Column:
    text = F.lower(col)
    return (
        F.when(col.isNull(), None)
        .when(text.contains("arab"), "Arabic")
        .when(text.contains("eng"), "English")
        .otherwise(strip(col))
    )


def clean_applicant_type(col: Column) -> Column:
    """Individual or Team where recognised, else title case (word starts after blanks)."""
    plain = F.replace(strip(col), F.lit("_"), F.lit(" "))
    text = F.lower(plain)
    return (
        F.when(col.isNull(), None)
        .when(text.contains("solo") | text.contains("individual") | (text == "ind"), "Individual")
        .when(text.contains("team") | text.contains("group"), "Team")
        .otherwise(F.initcap(plain))
    )


def to_year(col: Column) -> Column:
    """Whole year, also from '2024.0'; anything unreadable is null."""
    return col.try_cast("double").try_cast("int")


def is_missing_group(col: Column) -> Column:
    text = col.cast("string")
    return text.isNull() | F.lower(strip(text)).isin(*MISSING_GROUPS)


def is_missing_label(col: Column) -> Column:
    """A label that stands for 'no answer'; null is not a label and gives null."""
    return F.lower(strip(col.cast("string"))).isin(*MISSING_LABELS)


def missing_label(col: Column) -> Column:
    return F.when(is_missing_label(col), NOT_SPECIFIED).otherwise(col)


def clean_slash_label(col: Column) -> Column:
    last = strip(F.element_at(F.split(col, "/"), -1))
    return F.when(col.contains("/") & (last != ""), last).otherwise(col)


def team_size_bucket(col: Column) -> Column:
    """'2'..'5', '5+' or 'Not Specified'; one-person teams give null and are left out."""
    text = strip(col.cast("string"))
    size = text.try_cast("double")
    return (
        F.when(text.isNull() | text.isin(*NO_TEAM_SIZE), NOT_SPECIFIED)
        .when(text == "5+", "5+")
        .when(size.isNull() | F.isnan(size) | (size <= 0), NOT_SPECIFIED)
        .when(size < 2, None)
        .when(size > 5, "5+")
        .otherwise(size.try_cast("int").cast("string"))
    )


def age_rank(col: Column) -> Column:
    """Sort key: known groups youngest first, unknown ones after them."""
    known = F.array_position(F.array(*[F.lit(a) for a in AGE_ORDER]), col)
    return F.when(known > 0, known).otherwise(F.lit(len(AGE_ORDER) + 1))


def cohort_year(col: Column) -> Column:
    """Year prefix of an id such as '2024-1', else null."""
    year = F.regexp_extract(strip(col.cast("string")), r"^(\d{4})-\d+$", 1)
    return F.when(year != "", year)


def cohort_label(col: Column) -> Column:
    text = strip(col.cast("string"))
    number = F.regexp_extract(text, r"^\d{4}-(\d+)$", 1)
    out = F.when(F.lit(False), text)
    for value, language in COHORT_LANGUAGES.items():
        out = out.when(number == value, F.concat(text, F.lit(f" ({language})")))
    return out.otherwise(text)


def value_label(col: Column, percent: bool) -> Column:
    if percent:
        return F.format_string("%.1f%%", col)
    return col.cast("long").cast("string")


def missing_note(missing: Column, total: Column, percent: bool) -> Column:
    """'3 Not Specified' or '7.1% Not Specified'; null when nothing is missing."""
    if percent:
        text = F.format_string("%.1f%% " + NOT_SPECIFIED, missing / total * 100)
    else:
        text = F.concat(missing.cast("string"), F.lit(" " + NOT_SPECIFIED))
    return F.when(missing > 0, text)
