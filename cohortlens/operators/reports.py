"""Dashboard reports: KPIs, distributions, cross-tabs, attendance and the analyst snapshot.

Every report groups once; anything derived (shares, notes, tops) works on the grouped
counts. Totals are scalar subqueries over those counts, never a window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

# Defaults of the analyst snapshot.
CATEGORY_COLUMNS = ("Sector", "outcome_clean", "Business Stage", "applicant_type", "cohort", "cohort_id")
COHORT_YEARS = ("2023", "2024", "2025")
HOME_NATION = "bahrain"


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, halves rounded to even; 0 of nothing."""
    return F.bround(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def accepted() -> Column:
    return F.count_if(F.col("outcome_clean") == L.ACCEPTED)


def kpis(df: DataFrame) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("total"), accepted().alias("accepted"))
    return out.withColumn("rate", share(F.col("accepted"), F.col("total")))


def distribution(
    df: DataFrame,
    column: str,
    top: int | None = None,
    percent: bool = False,
    label: Column | None = None,
) -> DataFrame:
    """Bars of one column: label, count, share of the shown bars, text, and the missing note.

    Nulls are no answer and no row of the note; 'Not Specified' style labels leave the
    bars and make up the note, whose share is of all rows.
    """
    value = label if label is not None else F.col(f"`{column}`")
    counts = df.groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shown = counts.filter(~L.is_missing_label(F.col("label")))
    if top is not None:
        shown = shown.orderBy(F.desc("n"), "label").limit(top)
    total = counts.agg(F.sum("n"))
    missing = counts.agg(
        F.coalesce(F.sum(F.when(L.is_missing_label(F.col("label")), F.col("n"))), F.lit(0))
    )
    out = shown.withColumn("pct", share(F.col("n"), shown.agg(F.sum("n")).scalar()))
    return out.withColumns(
        {
            "text": L.value_label(F.col("pct") if percent else F.col("n"), percent),
            "note": L.missing_note(missing.scalar(), total.scalar(), percent),
        }
    )


def age_distribution(df: DataFrame, percent: bool = False) -> DataFrame:
    """Distribution of age groups, youngest first."""
    out = distribution(df, "Age Group", percent=percent)
    return out.withColumn("position", L.age_rank(F.col("label"))).orderBy("position", "label")


def crosstab(
    df: DataFrame,
    first: str,
    second: str,
    percent: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Counts per pair of values, with the share inside the first; nulls are left out.

    ``top`` keeps the most frequent first values, ranked without missing labels.
    """
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    if top is not None:
        ranked = (
            df.filter(a.isNotNull() & ~L.is_missing_label(a))
            .groupBy(a.alias("_top"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), "_top")
            .limit(top)
        )
        df = df.join(ranked, a == F.col("_top"), "left_semi")
    counts = df.filter(a.isNotNull() & b.isNotNull()).groupBy(a.alias("a"), b.alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = F.sum("n").over(Window.partitionBy("a"))  # over grouped counts
    out = counts.withColumn("pct", share(F.col("n"), whole))
    return out.withColumn("text", L.value_label(F.col("pct") if percent else F.col("n"), percent))


def per_year(df: DataFrame, outcome: str | None = None) -> DataFrame:
    """Applications per year, with the axis bound of the chart (largest year + 15 %)."""
    if outcome is not None:
        df = df.filter(F.col("outcome_clean") == outcome)
    counts = df.filter(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    bound = counts.agg(F.max("total") * 1.15).scalar()
    return counts.withColumn("axis_max", F.round(bound, 2))


def team_size_column(df: DataFrame) -> str | None:
    choices = ("team_member_count", "team_size_from_attendance", "attendance_member_rows")
    return next((c for c in choices if c in df.columns), None)


def team_size_distribution(df: DataFrame, percent: bool = False) -> DataFrame:
    """All five size buckets, also empty ones; single applicants count nowhere."""
    column = team_size_column(df)
    spark = df.sparkSession
    if column is None:
        return spark.createDataFrame([], "label string, n bigint, pct double, text string, note string")
    bucket = L.team_size_bucket(F.col(column))
    flags = [F.count_if(F.col("_b") == b).alias(b) for b in L.TEAM_BUCKETS]
    totals = df.select(bucket.alias("_b")).agg(
        *flags, F.count_if(F.col("_b") == L.NOT_SPECIFIED).alias("_missing")
    )
    pairs = F.array(
        *[F.struct(F.lit(b).alias("label"), F.col(f"`{b}`").alias("n")) for b in L.TEAM_BUCKETS]
    )
    shown = sum((F.col(f"`{b}`") for b in L.TEAM_BUCKETS), F.lit(0))
    out = totals.select(shown.alias("_shown"), "_missing", F.explode(pairs).alias("_p")).select(
        "_p.label", "_p.n", "_shown", "_missing"
    )
    out = out.withColumn("pct", share(F.col("n"), F.col("_shown")))
    return out.select(
        "label", "n", "pct",
        L.value_label(F.col("pct") if percent else F.col("n"), percent).alias("text"),
        L.missing_note(F.col("_missing"), F.col("_shown") + F.col("_missing"), percent).alias("note"),
    )


def cohort_sizes(df: DataFrame) -> DataFrame:
    """Rows per cohort with the share of all rows, null cohorts included in the whole."""
    counts = df.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col("cohort").isNotNull()).withColumn("pct", share(F.col("n"), total))


def cohort_scope(df: DataFrame, years: Sequence[str] = COHORT_YEARS) -> DataFrame:
    """Limit to cohort ids of the given years, but only when every id has a year.

    ``cohort_key`` holds the id, or the cohort where no id is filled in.
    """
    if "cohort_id" in df.columns:
        any_id = df.agg(F.count("cohort_id") > 0).scalar()
        key = F.when(any_id, F.col("cohort_id")).otherwise(F.col("cohort"))
    else:
        key = F.col("cohort")
    keyed = df.withColumn("cohort_key", key)
    year = L.cohort_year(F.col("cohort_key"))
    unparsed = keyed.agg(F.count_if(F.col("cohort_key").isNotNull() & year.isNull())).scalar()
    return keyed.filter((unparsed > 0) | year.isin(*years)).withColumn(
        "cohort_name", L.cohort_label(F.col("cohort_key"))
    )


def _attendance_numbers(df: DataFrame) -> DataFrame:
    def number(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))

    return df.withColumns(
        {
            "_sessions": number("sessions_scheduled"),
            "_slots": number("sessions_scheduled") * number("attendance_member_rows"),
            "_attended": number("member_days_present") + number("member_days_virtual"),
        }
    ).filter(F.col("_slots") > 0)


def _has_attendance(df: DataFrame, by: str | None = None) -> bool:
    needed = {"sessions_scheduled", "attendance_member_rows", "member_days_present", "member_days_virtual"}
    return needed <= set(df.columns) and (by is None or by in df.columns)


def attendance_summary(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Member attendance per group: attended member-days over member-session slots.

    Rows without a group are left out and counted in the note. ``top`` keeps the
    highest rates.
    """
    if not _has_attendance(df, by):
        return df.sparkSession.createDataFrame(
            [],
            "label string, projects bigint, sessions double, opportunities double, attended double, "
            "rate double, missing bigint, note string",
        )
    group = F.col(f"`{by}`")
    counts = (
        _attendance_numbers(df)
        .groupBy(F.when(~L.is_missing_group(group), group).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("projects"),
            F.sum("_sessions").alias("sessions"),
            F.sum("_slots").alias("opportunities"),
            F.sum("_attended").alias("attended"),
        )
    )
    missing = counts.agg(
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("projects"))), F.lit(0))
    ).scalar()
    out = counts.filter(F.col("label").isNotNull()).withColumns(
        {
            "rate": F.round(F.col("attended") / F.col("opportunities") * 100, 1),
            "missing": missing,
        }
    )
    out = out.withColumn("note", L.missing_note(F.col("missing"), F.lit(None), False))
    return out if top is None else out.orderBy(F.desc("rate"), "label").limit(top)


def attendance_overall(df: DataFrame, by: str = "year") -> DataFrame:
    """Projects and overall rate over the groups that are not missing."""
    summed = _attendance_numbers(df).filter(~L.is_missing_group(F.col(by))).agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum("_slots").alias("opportunities"),
        F.sum("_attended").alias("attended"),
    )
    return summed.withColumn(
        "rate", F.round(F.try_divide(F.col("attended") * 100, F.col("opportunities")), 1)
    )


def attendance_pct(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rates as percentages: the whole column is scaled when its largest value is at most 1."""
    value = F.col(column).try_cast("double")
    largest = df.agg(F.max(value)).scalar()
    return df.withColumn(name or column, F.when(largest <= 1.0, value * 100).otherwise(value))


def attendance_mean(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Fallback report: mean rate per group."""
    column = next(c for c in ("member_attendance_rate", "team_attendance_rate") if c in df.columns)
    scaled = attendance_pct(df, column, "_rate")
    group = F.col(f"`{by}`")
    kept = scaled.filter(~L.is_missing_group(group))
    if top is not None:
        kept = kept.filter(F.col("_rate").isNotNull())
    out = kept.groupBy(group.alias("label")).agg(F.round(F.avg("_rate"), 1).alias("rate"))
    return out if top is None else out.orderBy(F.desc("rate"), "label").limit(top)


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, null count and distinct count of all (or the named) columns.

    Exact counts melt the columns and group twice: values combine map-side before the
    one shuffle. ``approximate`` needs no shuffle of values at all.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    if approximate:
        pairs = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"),
                    F.approx_count_distinct(f"`{c}`").alias("distinct_values"),
                )
                for c in columns
            ]
        )
        counted = df.agg(pairs.alias("_p")).select(F.inline("_p"))
    else:
        melted = df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
                        for c in columns
                    ]
                )
            ).alias("_m")
        ).select("_m.column", "_m.v")
        per_value = melted.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        counted = per_value.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("v").alias("distinct_values"),
        )
    dtype = F.when(F.lit(False), "")
    for c in columns:
        dtype = dtype.when(F.col("column") == c, types[c])
    return counted.withColumn("dtype", dtype)


def analyst_kpis(df: DataFrame) -> DataFrame:
    """One row: totals, accepted, home-nation and team shares, and the years present."""
    def optional(column: str, flag: Column) -> Column:
        return F.count_if(flag) if column in df.columns else F.lit(0)

    out = df.agg(
        F.count(F.lit(1)).alias("applications"),
        optional("outcome_clean", F.col("outcome_clean") == L.ACCEPTED).alias("accepted"),
        optional("nationality", F.lower("nationality").contains(HOME_NATION)).alias("home"),
        optional("applicant_type", F.col("applicant_type") == "Team").alias("teams"),
        (F.array_sort(F.collect_set("year")) if "year" in df.columns else F.array()).alias("years"),
    )
    whole = F.col("applications")
    return out.withColumns(
        {
            "acceptance_rate_pct": share(F.col("accepted"), whole),
            "home_share_pct": share(F.col("home"), whole),
            "team_share_pct": share(F.col("teams"), whole),
            "years": F.array_join(F.transform("years", lambda y: y.cast("string")), ","),
        }
    )


def top_categories(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent values, null counted as 'Not Specified'."""
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    text = F.col(f"`{column}`").cast("string")
    value = F.when(text.isNull() | text.isin("nan", "None"), L.NOT_SPECIFIED).otherwise(text)
    return (
        df.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(n)
    )


def yearly(df: DataFrame) -> DataFrame:
    out = df.filter(F.col("year").isNotNull()).groupBy("year").agg(
        F.count(F.lit(1)).alias("applications"), accepted().alias("accepted")
    )
    return out.withColumn("acceptance_rate_pct", share(F.col("accepted"), F.col("applications")))


def snapshot(df: DataFrame, attendance: DataFrame | None = None) -> DataFrame:
    """Everything an analyst is given, as (section, key, position, value) rows."""
    def rows(frame: DataFrame, section: str, key: Column, value: Column, position: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            key.cast("string").alias("key"),
            position.cast("int").alias("position"),
            value.cast("string").alias("value"),
        )

    kpi = analyst_kpis(df)
    parts = [
        rows(
            kpi.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                            for c in kpi.columns
                        ]
                    )
                ).alias("e")
            ),
            "kpis", F.col("e.k"), F.col("e.v"), F.lit(0),
        ),
        rows(yearly(df), "yearly", F.col("year"), F.concat_ws("/", "applications", "accepted", "acceptance_rate_pct"), F.lit(0)),
        rows(profile(df), "schema", F.col("column"), F.concat_ws("/", "dtype", "nulls", "distinct_values"), F.lit(0)),
    ]
    wanted = [(f"top {c}", c, 5) for c in CATEGORY_COLUMNS if c in df.columns]
    if "keywords" in df.columns:
        wanted.append(("top keywords", "keywords", 8))
    for section, column, n in wanted:
        ranked = Window.orderBy(F.desc("n"), "value")  # over at most n rows
        top = top_categories(df, column, n).withColumn("position", F.row_number().over(ranked))
        parts.append(rows(top, section, F.col("value"), F.col("n"), F.col("position")))
    if attendance is not None:
        counted = attendance.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
        parts.append(rows(counted, "attendance", F.lit("records"), F.col("n"), F.lit(0)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def narrative(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Deterministic summary and insight lines, in order; ``limit`` keeps the first of them."""
    kpi = analyst_kpis(df)
    summary = kpi.select(
        F.lit(0).alias("position"),
        F.format_string(
            "The dashboard contains %d application records. Acceptance rate is %s%%; "
            "%s%% are Bahraini and %s%% are teams.",
            "applications", F.col("acceptance_rate_pct").cast("string"),
            F.col("home_share_pct").cast("string"), F.col("team_share_pct").cast("string"),
        ).alias("line"),
    )
    parts = []
    for column in [c for c in CATEGORY_COLUMNS if c in df.columns]:
        entry = F.struct(F.negative("n").alias("o"), "value", F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.t), ", ")
        parts.append(
            top_categories(df, column, 3).agg(listed.alias("_l")).filter(F.col("_l") != "").select(
                F.lit(len(parts) + 1).alias("position"),
                F.concat(F.lit(f"Top {column}: "), F.col("_l"), F.lit(".")).alias("line"),
            )
        )
    years = yearly(df)
    years = (years if limit is None else years.orderBy("year").limit(limit)).select(
        (F.row_number().over(Window.orderBy("year")) + len(parts)).alias("position"),
        F.format_string(
            "%d: %d applications, %s%% accepted.", "year", "applications",
            F.col("acceptance_rate_pct").cast("string"),
        ).alias("line"),
    )
    out = summary.unionByName(years)
    for part in parts:
        out = out.unionByName(part)
    return (out if limit is None else out.filter(F.col("position") <= limit)).orderBy("position")
