"""Idea documents: building, reading back, identifying and hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ARABIC_WIDE, clean_text, has_script, text_value

# The sections of an idea document, (label, English column, original column).
DOCUMENT_FIELDS = (
    ("Project", "project_name", None),
    ("Problem", "problem_en", "problem"),
    ("Solution", "solution_en", "solution"),
    ("Differentiation", "differentiation_en", "differentiation"),
    ("Impact", "impact_en", "impact"),
    ("Inspiration", "inspiration_en", "inspiration"),
    ("Keywords", "keywords", None),
)
DOCUMENT_LABELS = tuple(label for label, _, _ in DOCUMENT_FIELDS)
EMPTY_DOCUMENT = "Unnamed idea"
ID_FIELDS = ("year", "cohort_id", "project_name", "problem", "solution")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def make_document(
    df: DataFrame,
    fields=DOCUMENT_FIELDS,
    name: str = "document",
    original_script: str = ARABIC_WIDE,
) -> DataFrame:
    """Add one text with a 'Label: text' line per filled field, equal texts once."""
    parts = []
    for label, english_col, original_col in fields:
        english = clean_text(F.col(english_col)) if english_col in df.columns else F.lit("")
        if original_col in df.columns:
            original = clean_text(F.col(original_col))
            shown = F.when((original != english) & has_script(original, original_script), original)
            text = (
                F.when(english == "", original)
                .when(shown.isNotNull(), F.concat(english, F.lit(" Original: "), shown))
                .otherwise(english)
            )
        else:
            text = english
        parts.append(F.struct(F.lit(label).alias("label"), text.alias("text")))
    out = df.withColumn("_parts", F.array(*parts))
    out = out.withColumn("_texts", F.transform("_parts", lambda p: p.text))
    kept = F.filter(
        F.col("_parts"),
        lambda p, i: (p.text != "") & (F.array_position("_texts", p.text) == i + 1),
    )
    lines = F.array_join(F.transform(kept, lambda p: F.concat(p.label, F.lit(": "), p.text)), "\n")
    return out.withColumn(
        name, F.when(lines == "", EMPTY_DOCUMENT).otherwise(lines)
    ).drop("_parts", "_texts")


def document_lines(col: Column) -> Column:
    return F.transform(F.split(F.coalesce(col, F.lit("")), LINE_BREAK), clean_text)


def section(lines: Column, label: str) -> Column:
    """Text after 'Label:' in the last line that carries the label, null if none does."""
    mark = label + ":"
    found = F.filter(lines, lambda line: line.startswith(mark))
    return F.when(
        F.size(found) > 0,
        F.ltrim(F.substr(F.try_element_at(found, F.lit(-1)), F.lit(len(mark) + 1))),
    )


def document_sections(col: Column) -> Column:
    """Label to text map of a document, the last line winning for a repeated label."""

    def sections(lines: Column) -> Column:
        entries = F.array(
            *[F.struct(F.lit(x).alias("k"), section(lines, x).alias("v")) for x in DOCUMENT_LABELS]
        )
        return F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))

    # Bound to a variable, the lines are split and cleaned once, not for every use of them.
    return F.transform(F.array(document_lines(col)), sections)[0]


def with_sections(df: DataFrame, text: str, **named: str) -> DataFrame:
    """Add one column per requested section; a missing section gives ''."""
    out = df.withColumn("_lines", document_lines(F.col(text)))
    for name, label in named.items():
        out = out.withColumn(name, F.coalesce(section(F.col("_lines"), label), F.lit("")))
    return out.drop("_lines")


def idea_key(df: DataFrame) -> Column:
    """First 12 hex digits of the hash over the identifying fields."""
    key = F.concat_ws(
        "|", *[clean_text(F.col(c)) if c in df.columns else F.lit("") for c in ID_FIELDS]
    )
    return F.substring(F.sha2(key, 256), 1, 12)


def with_idea_ids(df: DataFrame, row_index: str = "row_index", name: str = "idea_id") -> DataFrame:
    """Unique ids: the first row of a key keeps it, later ones get their row number appended.

    The first rows come from a grouped minimum joined back on the row number, so a key
    shared by many copies never gathers in one task.
    """
    keyed = df.withColumn("_key", idea_key(df))
    first = keyed.groupBy("_key").agg(F.min(row_index).alias(row_index)).select(
        row_index, F.lit(True).alias("_first")
    )
    number = F.col(row_index).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return (
        keyed.join(first, row_index, "left")
        .withColumn(
            name,
            F.when(F.col("_first"), F.col("_key")).otherwise(
                F.concat("_key", F.lit("-"), padded)
            ),
        )
        .drop("_key", "_first")
    )


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def idea_text(df: DataFrame) -> Column:
    """Prompt text of an idea: English where given, else the original."""

    def value(c: str) -> Column:
        return text_value(F.col(c)) if c in df.columns else F.lit("")

    def best(english: str, original: str) -> Column:
        return F.when(value(english) != "", value(english)).otherwise(value(original))

    return F.concat(
        F.lit("Project: "), value("project_name"),
        F.lit("\nProblem: "), best("problem_en", "problem"),
        F.lit("\nDescription: "), best("solution_en", "solution"),
    )
