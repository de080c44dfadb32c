"""Loading, cleaning, filtering, joining and reporting queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import labels as L
from ..operators import filters, joins, reports
from ..operators.repeats import repeat_submissions
from ..session import shared_folder
from ..sources import index as I
from ..sources import roles as R
from ..sources import tables as T
from . import register
from .role_sql import APPS, ATT, INDEX, JOINED, RAW, applicant_type

NOTE = "CASE WHEN {m} > 0 THEN {m} || ' Not Specified' END"


def _missing(c: str) -> str:
    return f"lower(trim({c})) IN ('not specified', 'blanks')"


# --- loading -------------------------------------------------------------------------

APP_COLUMNS = 'row_id, year, cohort, cohort_id, "Sector", outcome_clean, "Business Stage", "Age Group", team_member_count, employment_status, has_commercial_registration, education, major, nationality, project_name, individual_or_team'


@register("narrow_applications", f'WITH {RAW} SELECT {APP_COLUMNS.replace("row_id, ", "")} FROM raw')
def narrow_applications(spark, d):
    return T.narrow(R.applications_raw(spark, d), [*T.APPLICATION_COLUMNS, *T.APPLICATION_EXTRAS])


@register("load_applications", f"WITH {APPS} SELECT {APP_COLUMNS}, applicant_type FROM apps")
def load_applications(spark, d):
    return T.load_applications(R.applications_raw(spark, d), keep=["row_id"])


ATT_COLUMNS = "sessions_scheduled, member_attendance_rate, attendance_member_rows, member_days_present, member_days_virtual, year, cohort, matched_project_name, matched_application_id"


@register("load_attendance", f"WITH {ATT} SELECT {ATT_COLUMNS} FROM att")
def load_attendance(spark, d):
    return T.load_attendance(R.attendance_raw(spark, d))


@register("index_complete", f"""
SELECT doc_id AS row_index, 'vector' AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'metadata' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def index_complete(spark, d):
    return I.index_gaps(R.idea_documents(spark, d), R.idea_vectors(spark, d))


_SLICES = ", ".join(
    f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT), 0)" for i in range(8)
)
_PAIR_HASH = "sha256(row_index || ':' || sha256(text))"


@register("index_manifest", f"""WITH {INDEX}
SELECT 'given' AS model, (SELECT CAST(max(len(u)) AS INTEGER) FROM idx) AS dimensions, 'document' AS input_type,
  sha256(concat_ws(',', {_SLICES})) AS content_hash, count(*) AS rows,
  'Project,Problem,Solution,Differentiation,Impact,Inspiration,Keywords' AS text_fields
FROM (SELECT {_PAIR_HASH} AS h FROM idx)""")
def index_manifest(spark, d):
    return I.manifest(R.idea_index(spark, d), "given")


@register("content_hash", f"""WITH {INDEX}
SELECT sha256(concat_ws(',', {_SLICES})) AS content_hash, count(*) AS rows FROM (SELECT {_PAIR_HASH} AS h FROM docs)""")
def content_hash(spark, d):
    docs = R.idea_documents(spark, d).withColumn("text_hash", F.sha2("text", 256))
    return I.content_hash(docs)


@register("index_round_trip", f"WITH {INDEX} SELECT row_index, sector, sha256(text) AS text_hash, CAST(len(u) AS INTEGER) AS dimensions FROM idx")
def index_round_trip(spark, d):
    """The index as loaded from its second snapshot."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = R.idea_index(spark, d)
    I.write_index(index.withColumn("text", F.lower("text")), folder, "given")
    I.write_index(index, folder, "given")
    return I.load_index(spark, folder).select("row_index", "sector", "text_hash", F.size("vec").alias("dimensions"))


@register("read_written", f"WITH {RAW} SELECT row_id, project_name, year, \"Sector\", nationality, outcome_clean FROM raw")
def read_written(spark, d):
    """Applications written as CSV and JSON, read again with a schema, and joined."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    raw = R.applications_raw(spark, d)
    T.write_result(raw.select("row_id", "project_name", "Sector", "nationality"), f"{folder}/a.csv")
    T.write_result(raw.select("row_id", "year", "outcome_clean"), f"{folder}/b.json")
    typed = StructType([StructField("row_id", LongType())])
    left = T.read_table(spark, f"{folder}/a.csv", typed, multi_line=False)
    right = T.read_table(spark, f"{folder}/b.json", StructType([*typed.fields, *(StructField(c, StringType()) for c in ("year", "outcome_clean"))]), multi_line=False)
    return left.join(right, "row_id").select("row_id", "project_name", "year", "Sector", "nationality", "outcome_clean")


@register("read_strings", f"WITH {RAW} SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(\"Sector\", '') AS \"Sector\", coalesce(nationality, '') AS nationality, coalesce(year, '') AS year FROM raw")
def read_strings(spark, d):
    path = f"{shared_folder(spark)}/strings-{uuid.uuid4().hex}.csv"
    T.write_result(R.applications_raw(spark, d).select("row_id", "Sector", "nationality", "year"), path)
    return T.read_strings(spark, path)


@register("recognised_table", f"WITH {RAW} SELECT row_id, \"Sector\" FROM raw")
def recognised_table(spark, d):
    """The first of several tables that looks like applications."""
    raw = R.applications_raw(spark, d)
    frames = [R.read(spark, d, "nation"), R.attendance_raw(spark, d), raw]
    return T.match_dataset(frames, [c for c in T.APPLICATION_COLUMNS if c not in ("year", "cohort")]).select("row_id", "Sector")


@register("stale_documents", f"""WITH {INDEX}
SELECT row_index, sha256(text) AS text_hash FROM docs WHERE sha256(text) NOT IN (SELECT sha256(text) FROM idx)""")
def stale_documents(spark, d):
    docs = R.idea_documents(spark, d).select("row_index", F.sha2("text", 256).alias("text_hash"))
    stored = R.idea_index(spark, d).select(F.sha2("text", 256).alias("text_hash"))
    return I.stale_rows(docs, stored).select("row_index", "text_hash")


@register("merge_cache", """
WITH cache AS (SELECT event_id AS identity, CASE WHEN event_id % 4 <> 0 AND event_type <> 'view' THEN value END AS score FROM events),
fresh AS (SELECT event_id + 1000 AS identity, value * 2 AS score FROM events)
SELECT * FROM cache WHERE score IS NOT NULL
UNION ALL SELECT * FROM fresh WHERE identity NOT IN (SELECT identity FROM cache WHERE score IS NOT NULL)
UNION ALL SELECT * FROM cache WHERE score IS NULL AND identity NOT IN (SELECT identity FROM fresh)""")
def merge_cache(spark, d):
    events = R.read(spark, d, "events")
    key, scored = F.col("event_id"), (F.col("event_id") % 4 != 0) & (F.col("event_type") != "view")
    cache = events.select(key.alias("identity"), F.when(scored, F.col("value")).alias("score"))
    fresh = events.select((key + 1000).alias("identity"), (F.col("value") * 2).alias("score"))
    return T.merge_cache(cache, fresh)


# --- labels ----------------------------------------------------------------------------

@register("clean_cohort", f"WITH {APPS} SELECT raw.cohort AS cohort, apps.cohort AS cleaned, count(*) AS n FROM raw JOIN apps USING (row_id) GROUP BY 1, 2")
def clean_cohort(spark, d):
    return R.applications_raw(spark, d).groupBy("cohort", L.clean_cohort(F.col("cohort")).alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@register("clean_type", f"WITH {RAW} SELECT individual_or_team, {applicant_type('individual_or_team')} AS cleaned, count(*) AS n FROM raw GROUP BY 1, 2")
def clean_type(spark, d):
    raw = R.applications_raw(spark, d)
    return raw.groupBy("individual_or_team", L.clean_applicant_type(F.col("individual_or_team")).alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@register("to_year", f"WITH {RAW} SELECT year, CAST(TRY_CAST(year AS DOUBLE) AS INTEGER) AS cleaned, count(*) AS n FROM raw GROUP BY 1, 2")
def to_year(spark, d):
    return R.applications_raw(spark, d).groupBy("year", L.to_year(F.col("year")).alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@register("missing_groups", f"""WITH {RAW}
SELECT "Sector", "Sector" IS NULL OR lower(trim("Sector")) IN ('', 'nan', 'none', 'null', 'not specified', 'blanks', 'blank') AS missing, count(*) AS n
FROM raw GROUP BY 1, 2""")
def missing_groups(spark, d):
    return R.applications_raw(spark, d).groupBy("Sector", L.is_missing_group(F.col("Sector")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


_SLASH = "CASE WHEN {c} LIKE '%/%' AND trim(string_split({c}, '/')[-1]) <> '' THEN trim(string_split({c}, '/')[-1]) ELSE {c} END"


@register("slash_label", f"WITH {RAW} SELECT education, major, {_SLASH.format(c='education')} AS education_label, {_SLASH.format(c='major')} AS major_label, count(*) AS n FROM raw GROUP BY ALL")
def slash_label(spark, d):
    return R.applications_raw(spark, d).groupBy(
        "education", "major",
        L.clean_slash_label(F.col("education")).alias("education_label"),
        L.clean_slash_label(F.col("major")).alias("major_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


_BUCKET = """CASE WHEN team_member_count IS NULL OR trim(team_member_count) IN ('', '-', 'nan', 'None', 'null') THEN 'Not Specified'
  WHEN trim(team_member_count) = '5+' THEN '5+' WHEN coalesce(TRY_CAST(team_member_count AS DOUBLE), 0) <= 0 THEN 'Not Specified'
  WHEN CAST(team_member_count AS DOUBLE) < 2 THEN NULL WHEN CAST(team_member_count AS DOUBLE) > 5 THEN '5+'
  ELSE CAST(CAST(CAST(team_member_count AS DOUBLE) AS INTEGER) AS VARCHAR) END"""


@register("team_size_bucket", f"WITH {RAW} SELECT team_member_count, {_BUCKET} AS bucket, count(*) AS n FROM raw GROUP BY 1, 2")
def team_size_bucket(spark, d):
    return R.applications_raw(spark, d).groupBy("team_member_count", L.team_size_bucket(F.col("team_member_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("cohort_labels", f"""WITH {RAW} SELECT cohort_id, nullif(regexp_extract(cohort_id, '^(\\d{{4}})-\\d+$', 1), '') AS cohort_year,
  CASE regexp_extract(cohort_id, '^\\d{{4}}-(\\d+)$', 1) WHEN '1' THEN cohort_id || ' (EN)' WHEN '2' THEN cohort_id || ' (AR)' ELSE cohort_id END AS cohort_label, count(*) AS n
FROM raw GROUP BY ALL""")
def cohort_labels(spark, d):
    return R.applications_raw(spark, d).groupBy(
        "cohort_id", L.cohort_year(F.col("cohort_id")).alias("cohort_year"), L.cohort_label(F.col("cohort_id")).alias("cohort_label")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- filters -----------------------------------------------------------------------------

SELECTED = dict(years=[1996, 1997, 1998], cohorts=["English"], outcomes=["Accepted", "Rejected"], sectors=["BUILDING", "MACHINERY"], types=["Team"])
FILTERED = """year IN (1996, 1997, 1998) AND cohort = 'English' AND outcome_clean IN ('Accepted', 'Rejected')
  AND "Sector" IN ('BUILDING', 'MACHINERY') AND applicant_type = 'Team'"""


@register("filtered_applications", f'WITH {APPS} SELECT row_id, year, cohort, outcome_clean, "Sector", applicant_type FROM apps WHERE {FILTERED}')
def filtered_applications(spark, d):
    return filters.apply_filters(R.applications(spark, d), **SELECTED).select("row_id", "year", "cohort", "outcome_clean", "Sector", "applicant_type")


@register("filtered_raw", f"""WITH {RAW} SELECT row_id, outcome_clean, "Sector", individual_or_team FROM raw
WHERE outcome_clean = 'Accepted' AND "Sector" = 'BUILDING' AND individual_or_team IN ('Team', 'group_project')""")
def filtered_raw(spark, d):
    return filters.apply_filters(
        R.applications_raw(spark, d), strict=False, outcomes=["Accepted"], sectors=["BUILDING"], types=["Team", "group_project"]
    ).select("row_id", "outcome_clean", "Sector", "individual_or_team")


@register("filter_options", f'WITH {APPS} SELECT DISTINCT "Sector" FROM apps WHERE "Sector" IS NOT NULL')
def filter_options(spark, d):
    return filters.filter_options(R.applications(spark, d), "Sector")


@register("strip_outcomes", f"WITH {APPS} SELECT row_id, year, cohort_id FROM apps")
def strip_outcomes(spark, d):
    stripped = filters.strip_outcomes(R.applications(spark, d).select("row_id", "year", "cohort_id", "outcome_clean"))
    filters.assert_no_leak(stripped.columns)
    return stripped


@register("scope_years", f"WITH {APPS} SELECT row_id, year FROM apps WHERE year IN (1999, 2000)")
def scope_years(spark, d):
    return filters.scope_years(R.applications(spark, d), (1999, 2000)).select("row_id", "year")


# --- reports -----------------------------------------------------------------------------

@register("kpis", f"""WITH {APPS} SELECT count(*) AS total, count(*) FILTER (outcome_clean = 'Accepted') AS accepted,
  round_even(count(*) FILTER (outcome_clean = 'Accepted') * 100.0::DOUBLE / count(*), 1) AS rate FROM apps""")
def kpis(spark, d):
    return reports.kpis(R.applications(spark, d))


def dist_sql(label: str, top: int | None = None, percent: bool = False) -> str:
    limit = f"ORDER BY n DESC, label LIMIT {top}" if top else ""
    text = "printf('%.1f%%', pct)" if percent else "CAST(n AS VARCHAR)"
    note = "CASE WHEN m > 0 THEN printf('%.1f%% Not Specified', m / t::DOUBLE * 100) END" if percent else NOTE.format(m="m")
    return f"""WITH {APPS}, counts AS (SELECT {label} AS label, count(*) AS n FROM apps GROUP BY 1),
shown AS (SELECT * FROM counts WHERE label IS NOT NULL AND NOT ({_missing("label")}) {limit}),
shares AS (SELECT label, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct FROM shown),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS t, CAST(coalesce(sum(n) FILTER ({_missing("label")}), 0) AS BIGINT) AS m FROM counts)
SELECT label, n, pct, {text} AS text, {note} AS note FROM shares, totals"""


def _distribution(name: str, column: str, top=None, percent=False, slash=False):
    quoted = f'"{column}"'
    label = _SLASH.format(c=quoted) if slash else quoted

    @register(name, dist_sql(label, top, percent))
    def run(spark, d):
        value = L.clean_slash_label(F.col(column)) if slash else None
        return reports.distribution(R.applications(spark, d), column, top, percent, value)


_distribution("dist_type", "applicant_type")
_distribution("dist_nationality", "nationality", top=5)
_distribution("dist_stage", "Business Stage", percent=True)
_distribution("dist_outcome", "outcome_clean")
_distribution("dist_registration", "has_commercial_registration", percent=True)
_distribution("dist_employment", "employment_status")
_distribution("dist_education", "education", top=6, slash=True)
_distribution("dist_major", "major", top=6, slash=True)
_distribution("dist_sector", "Sector", top=5, percent=True)


@register("age_distribution", f"""SELECT *, CASE label WHEN '18-24' THEN 1 WHEN '25-34' THEN 2 WHEN '35-44' THEN 3 WHEN '45+' THEN 4 ELSE 6 END AS position
FROM ({dist_sql('"Age Group"')})""")
def age_distribution(spark, d):
    return reports.age_distribution(R.applications(spark, d))


def xt_sql(a: str, b: str, percent: bool = False, source: str = APPS, table: str = "apps", extra: str = "") -> str:
    text = "printf('%.1f%%', pct)" if percent else "CAST(n AS VARCHAR)"
    return f"""WITH {source} SELECT *, {text} AS text FROM (
  SELECT a, b, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY a), 1) AS pct FROM (
    SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {extra} GROUP BY 1, 2))"""


def _crosstab(name: str, a: str, b: str, percent=False):
    @register(name, xt_sql(f'"{a}"', f'"{b}"', percent))
    def run(spark, d):
        return reports.crosstab(R.applications(spark, d), a, b, percent)


_crosstab("xt_type_outcome", "applicant_type", "outcome_clean", percent=True)
_crosstab("xt_cohort_outcome", "cohort", "outcome_clean")
_crosstab("xt_year_cohort", "year", "cohort")
_crosstab("xt_year_type", "year", "applicant_type")
_crosstab("xt_cohort_type", "cohort", "applicant_type", percent=True)


@register("xt_top_sector_outcome", xt_sql('"Sector"', "outcome_clean", True, extra=f"""AND "Sector" IN (
  SELECT "Sector" FROM apps WHERE "Sector" IS NOT NULL AND NOT ({_missing('"Sector"')}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"""))
def xt_top_sector_outcome(spark, d):
    return reports.crosstab(R.applications(spark, d), "Sector", "outcome_clean", True, top=3)


@register("xt_cohortid_outcome", xt_sql("cohort_id", "outcome_clean", extra="AND cohort_id[:4] IN ('1996', '1997', '2001')"))
def xt_cohortid_outcome(spark, d):
    scoped = reports.cohort_scope(R.applications(spark, d), ("1996", "1997", "2001"))
    return reports.crosstab(scoped, "cohort_key", "outcome_clean")


def _per_year_sql(extra: str) -> str:
    return f"WITH {APPS} SELECT year, n AS total, round(max(n) OVER () * 1.15::DOUBLE, 2) AS axis_max FROM (SELECT year, count(*) AS n FROM apps WHERE year IS NOT NULL {extra} GROUP BY 1)"


@register("apps_per_year", _per_year_sql(""))
def apps_per_year(spark, d):
    return reports.per_year(R.applications(spark, d))


@register("accepted_per_year", _per_year_sql("AND outcome_clean = 'Accepted'"))
def accepted_per_year(spark, d):
    return reports.per_year(R.applications(spark, d), "Accepted")


@register("team_size_distribution", f"""WITH {RAW}, b AS (SELECT {_BUCKET} AS bucket FROM raw),
shown AS (SELECT label, count(bucket) AS n FROM (SELECT unnest(['2', '3', '4', '5', '5+']) AS label) LEFT JOIN b ON bucket = label GROUP BY 1),
totals AS (SELECT count(*) FILTER (bucket = 'Not Specified') AS m FROM b)
SELECT label, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct, printf('%.1f%%', round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1)) AS text,
  CASE WHEN m > 0 THEN printf('%.1f%% Not Specified', m / CAST(m + sum(n) OVER () AS DOUBLE) * 100) END AS note FROM shown, totals""")
def team_size_distribution(spark, d):
    return reports.team_size_distribution(R.applications(spark, d), percent=True)


@register("cohort_sizes", f"WITH {APPS} SELECT cohort, n, round_even(n * 100.0::DOUBLE / (SELECT count(*) FROM apps), 1) AS pct FROM (SELECT cohort, count(*) AS n FROM apps GROUP BY 1) WHERE cohort IS NOT NULL")
def cohort_sizes(spark, d):
    return reports.cohort_sizes(R.applications(spark, d))


# --- attendance ----------------------------------------------------------------------------

JOINED_COLUMNS = 'attendance_id, sessions_scheduled, member_days_present, year, cohort, matched_project_name, cohort_id, "Sector", outcome_clean, applicant_type'


def _joined(spark, d):
    return joins.join_attendance(R.attendance_raw(spark, d), R.applications(spark, d), "row_id")


@register("join_attendance", f"WITH {JOINED} SELECT {JOINED_COLUMNS} FROM joined")
def join_attendance(spark, d):
    return _joined(spark, d).select(*[c.strip().strip('"') for c in JOINED_COLUMNS.split(",")])


@register("matched_count", f'WITH {JOINED} SELECT count("Sector") AS matched, count(*) AS rows FROM joined')
def matched_count(spark, d):
    return joins.matched_count(_joined(spark, d))


def att_sql(by: str, top: int | None = None) -> str:
    limit = f"ORDER BY rate DESC, label LIMIT {top}" if top else ""
    gone = f"{by} IS NULL OR lower(trim(CAST({by} AS VARCHAR))) IN ('', 'nan', 'none', 'null', 'not specified', 'blanks', 'blank')"
    return f"""WITH {JOINED}, a AS (SELECT CASE WHEN NOT ({gone}) THEN {by} END AS label, CAST(sessions_scheduled AS DOUBLE) AS s,
  CAST(sessions_scheduled AS DOUBLE) * attendance_member_rows AS o, CAST(member_days_present + member_days_virtual AS DOUBLE) AS p FROM joined WHERE sessions_scheduled * attendance_member_rows > 0),
missing AS (SELECT count(*) AS m FROM a WHERE label IS NULL)
SELECT label, projects, sessions, opportunities, attended, round(attended / opportunities * 100, 1) AS rate, m AS missing, {NOTE.format(m="m")} AS note
FROM (SELECT label, count(*) AS projects, sum(s) AS sessions, sum(o) AS opportunities, sum(p) AS attended FROM a WHERE label IS NOT NULL GROUP BY 1), missing {limit}"""


@register("att_by_year", att_sql("year"))
def att_by_year(spark, d):
    return reports.attendance_summary(_joined(spark, d), "year")


@register("att_by_cohort", att_sql("cohort_id"))
def att_by_cohort(spark, d):
    return reports.attendance_summary(_joined(spark, d), "cohort_id")


@register("att_by_sector", att_sql('"Sector"', 3))
def att_by_sector(spark, d):
    return reports.attendance_summary(_joined(spark, d), "Sector", top=3)


@register("att_overall", f"""WITH {ATT} SELECT count(*) AS projects, sum(o) AS opportunities, sum(p) AS attended, round(sum(p) * 100 / sum(o), 1) AS rate
FROM (SELECT CAST(sessions_scheduled AS DOUBLE) * attendance_member_rows AS o, CAST(member_days_present + member_days_virtual AS DOUBLE) AS p FROM att WHERE year IS NOT NULL)""")
def att_overall(spark, d):
    return reports.attendance_overall(R.attendance(spark, d))


@register("attendance_pct", f"WITH {ATT} SELECT matched_application_id, round(member_attendance_rate * CASE WHEN max(member_attendance_rate) OVER () <= 1 THEN 100 ELSE 1 END, 6) AS pct FROM att")
def attendance_pct(spark, d):
    out = reports.attendance_pct(R.attendance(spark, d), "member_attendance_rate", "pct")
    return out.select("matched_application_id", F.round("pct", 6).alias("pct"))


@register("att_mean_by_cohort", f"WITH {ATT} SELECT cohort AS label, round(avg(member_attendance_rate * 100), 1) AS rate FROM att GROUP BY 1")
def att_mean_by_cohort(spark, d):
    return reports.attendance_mean(R.attendance(spark, d), "cohort")


# --- analyst snapshot ------------------------------------------------------------------------

_PROFILE_TYPES = {"row_id": "bigint", "submitted_at": "timestamp_ntz", "year": "int"}
_PROFILE_COLUMNS = ["row_id", "applicant_name", "date_of_birth", "submitted_at", "year", "cohort", "cohort_id", "Sector", "outcome_clean", "Business Stage", "Age Group", "team_member_count", "employment_status", "has_commercial_registration", "education", "major", "nationality", "project_name", "individual_or_team", "applicant_type"]
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls, count(DISTINCT "{c}") AS distinct_values, '{_PROFILE_TYPES.get(c, "string")}' AS dtype FROM apps"""
    for c in _PROFILE_COLUMNS
)


@register("profile", f"WITH {APPS} {_PROFILE}")
def profile(spark, d):
    return reports.profile(R.applications(spark, d))


_KPI = """SELECT count(*) AS applications, count(*) FILTER (outcome_clean = 'Accepted') AS accepted,
  count(*) FILTER (lower(nationality) LIKE '%bahrain%') AS home, count(*) FILTER (applicant_type = 'Team') AS teams,
  array_to_string(list_sort(list(DISTINCT year) FILTER (year IS NOT NULL)), ',') AS years,
  round_even(count(*) FILTER (outcome_clean = 'Accepted') * 100.0::DOUBLE / count(*), 1) AS acceptance_rate_pct,
  round_even(count(*) FILTER (lower(nationality) LIKE '%bahrain%') * 100.0::DOUBLE / count(*), 1) AS home_share_pct,
  round_even(count(*) FILTER (applicant_type = 'Team') * 100.0::DOUBLE / count(*), 1) AS team_share_pct FROM apps"""


@register("analyst_kpis", f"WITH {APPS} {_KPI}")
def analyst_kpis(spark, d):
    return reports.analyst_kpis(R.applications(spark, d))


def top_sql(column: str, n: int) -> str:
    return f"""SELECT coalesce(CAST({column} AS VARCHAR), 'Not Specified') AS value, count(*) AS n FROM apps GROUP BY 1 ORDER BY n DESC, value LIMIT {n}"""


@register("top_categories", f"""WITH {APPS} {top_sql('"Sector"', 5)}""")
def top_categories(spark, d):
    return reports.top_categories(R.applications(spark, d), "Sector")


_YEARLY = """SELECT year, count(*) AS applications, count(*) FILTER (outcome_clean = 'Accepted') AS accepted,
  round_even(count(*) FILTER (outcome_clean = 'Accepted') * 100.0::DOUBLE / count(*), 1) AS acceptance_rate_pct FROM apps WHERE year IS NOT NULL GROUP BY 1"""


@register("yearly_breakdown", f"WITH {APPS} {_YEARLY}")
def yearly_breakdown(spark, d):
    return reports.yearly(R.applications(spark, d))


_KPI_ROWS = " UNION ALL ".join(
    f"SELECT 'kpis' AS section, '{c}' AS key, 0 AS position, CAST({c} AS VARCHAR) AS value FROM kpi"
    for c in ("applications", "accepted", "home", "teams", "years", "acceptance_rate_pct", "home_share_pct", "team_share_pct")
)
_TOP_ROWS = " UNION ALL ".join(
    f"""SELECT 'top {c}', value, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER), CAST(n AS VARCHAR) FROM ({top_sql(f'"{c}"', 5)})"""
    for c in reports.CATEGORY_COLUMNS
)


@register("snapshot", f"""WITH {APPS}, kpi AS ({_KPI}), prof AS ({_PROFILE}), yearly AS ({_YEARLY}), {ATT}
{_KPI_ROWS} UNION ALL SELECT 'yearly', CAST(year AS VARCHAR), 0, concat_ws('/', applications, accepted, acceptance_rate_pct) FROM yearly
UNION ALL SELECT 'schema', "column", 0, concat_ws('/', dtype, nulls, distinct_values) FROM prof
UNION ALL {_TOP_ROWS} UNION ALL SELECT 'attendance', 'records', 0, CAST(count(*) AS VARCHAR) FROM att""")
def snapshot(spark, d):
    return reports.snapshot(R.applications(spark, d), R.attendance(spark, d))


_LINES = " UNION ALL ".join(
    f"""SELECT {i}, 'Top {c}: ' || string_agg(value || ' (' || n || ')', ', ' ORDER BY n DESC, value) || '.' FROM ({top_sql(f'"{c}"', 3)})"""
    for i, c in enumerate(reports.CATEGORY_COLUMNS, 1)
)


@register("narrative", f"""WITH {APPS}, kpi AS ({_KPI})
SELECT 0 AS position, 'The dashboard contains ' || applications || ' application records. Acceptance rate is ' || acceptance_rate_pct || '%; ' || home_share_pct || '% are Bahraini and ' || team_share_pct || '% are teams.' AS line FROM kpi
UNION ALL {_LINES} UNION ALL SELECT {len(reports.CATEGORY_COLUMNS)} + row_number() OVER (ORDER BY year), year || ': ' || applications || ' applications, ' || acceptance_rate_pct || '% accepted.' FROM ({_YEARLY})""")
def narrative(spark, d):
    return reports.narrative(R.applications(spark, d))


# --- repeat submissions ----------------------------------------------------------------------

def _repeat_sql(where: str = "") -> str:
    return f"""WITH {APPS}, r AS (
  SELECT year, trim(applicant_name) || '|' || coalesce(date_of_birth, '') AS identity, cohort_id, row_id, applicant_name AS name,
    coalesce("Sector", '') AS sector, coalesce("Business Stage", '') AS stage, coalesce(outcome_clean, '') AS outcome, coalesce(applicant_type, '') AS kind FROM apps),
g AS (SELECT year, identity, arg_min(r, (cohort_id, row_id)) AS f, arg_max(r, (cohort_id, row_id)) AS l FROM r GROUP BY 1, 2 HAVING count(DISTINCT cohort_id) > 1)
SELECT f.name AS project_name, year, f.cohort_id AS cohort_1, l.cohort_id AS cohort_2, f.sector AS sector_1, l.sector AS sector_2,
  f.stage AS stage_1, l.stage AS stage_2, f.outcome AS outcome_1, l.outcome AS outcome_2, l.kind AS applicant_type, '' AS idea_text FROM g {where}"""


def _repeat_rows(spark, d):
    apps = R.applications(spark, d).drop("project_name")
    return apps.withColumnRenamed("applicant_name", "project_name")


@register("repeat_submissions", _repeat_sql())
def repeats(spark, d):
    return repeat_submissions(_repeat_rows(spark, d), "row_id")


@register("repeat_submissions_filtered", _repeat_sql("WHERE year IN (1997, 1998) AND l.sector = 'BUILDING' AND l.outcome = 'Accepted' AND l.kind IN ('Individual', 'Team')"))
def repeats_filtered(spark, d):
    return repeat_submissions(_repeat_rows(spark, d), "row_id", years=[1997, 1998], sectors=["BUILDING"], outcomes=["Accepted"], types=["Individual", "Team"])


@register("keep_first", f"WITH {RAW} SELECT min(row_id) AS row_id, applicant_name FROM raw GROUP BY 2")
def keep_first(spark, d):
    return joins.first_per_key(R.applications_raw(spark, d).select("row_id", "applicant_name"), "applicant_name", "row_id")
