"""SQL twins of the role tables, as common table expressions."""

from __future__ import annotations

from ..sources import roles


def cycle(key: str, labels) -> str:
    arms = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {key} % {len(labels) + 1} {arms} END"


RAW = f"""raw AS (
  SELECT o_orderkey AS row_id, 'Project ' || o_orderkey AS project_name, c_name AS applicant_name,
    CASE WHEN o_custkey % 13 <> 0 THEN CAST(DATE '1970-01-01' + CAST(o_custkey % 12000 AS INTEGER) AS VARCHAR) END AS date_of_birth,
    CASE WHEN o_orderkey % 50 = 7 THEN 'n/a' ELSE year(o_orderdate) || '.0' END AS year,
    year(o_orderdate) || '-' || CASE WHEN month(o_orderdate) <= 6 THEN '1' ELSE '2' END AS cohort_id,
    CASE WHEN o_orderkey % 2 = 0 THEN ' ARABIC ' WHEN o_orderkey % 31 = 5 THEN ' Mixed ' ELSE 'english cohort' END AS cohort,
    CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Not Specified' ELSE c_mktsegment END END AS "Sector",
    CASE o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'O' THEN 'Rejected' ELSE 'Not Specified' END AS outcome_clean,
    CASE WHEN o_orderkey % 19 = 3 THEN 'joint_venture' WHEN o_orderpriority = '1-URGENT' THEN 'solo founder'
      WHEN o_orderpriority = '2-HIGH' THEN 'Team' WHEN o_orderpriority = '3-MEDIUM' THEN 'group_project'
      WHEN o_orderpriority = '5-LOW' THEN ' ind ' END AS individual_or_team,
    CASE WHEN o_orderkey % 9 = 0 THEN '-' WHEN o_orderkey % 9 = 7 THEN '5+' WHEN o_orderkey % 9 < 7 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS team_member_count,
    CASE WHEN o_orderkey % 5 = 1 THEN 'Bahrain' WHEN o_orderkey % 5 <> 0 THEN n_name END AS nationality,
    {cycle("o_orderkey", roles.STAGES)} AS "Business Stage",
    {cycle("o_orderkey", roles.AGES)} AS "Age Group",
    {cycle("o_orderkey", roles.EDUCATION)} AS education,
    {cycle("o_orderkey", roles.MAJORS)} AS major,
    {cycle("o_orderkey", roles.EMPLOYMENT)} AS employment_status,
    CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS has_commercial_registration,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS submitted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def applicant_type(column: str) -> str:
    plain = f"replace(trim({column}), '_', ' ')"
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN lower({plain}) LIKE '%solo%' OR lower({plain}) LIKE '%individual%' "
        f"OR lower({plain}) = 'ind' THEN 'Individual' WHEN lower({plain}) LIKE '%team%' OR lower({plain}) LIKE '%group%' "
        f"THEN 'Team' ELSE array_to_string(list_transform(string_split({plain}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"
    )


COHORT = (
    "CASE WHEN cohort IS NULL THEN NULL WHEN lower(cohort) LIKE '%arab%' THEN 'Arabic' "
    "WHEN lower(cohort) LIKE '%eng%' THEN 'English' ELSE trim(cohort) END"
)

APPS = f"""{RAW}, apps AS (
  SELECT * REPLACE (CAST(TRY_CAST(year AS DOUBLE) AS INTEGER) AS year, {COHORT} AS cohort),
    {applicant_type("individual_or_team")} AS applicant_type FROM raw)"""

ATT = """att AS (
  SELECT l_orderkey AS attendance_id, sessions_scheduled, attendance_member_rows,
    CAST(q % (CAST(sessions_scheduled AS BIGINT) * attendance_member_rows + 1) AS INTEGER) AS member_days_present,
    CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS member_days_virtual,
    CASE WHEN l_orderkey % 6 <> 0 THEN (q % 101) / 100.0::DOUBLE END AS member_attendance_rate,
    year, CASE WHEN l_orderkey % 2 = 0 THEN 'Arabic' ELSE 'English' END AS cohort,
    CASE WHEN l_orderkey % 7 <> 0 THEN '  PROJECT ' || l_orderkey END AS matched_project_name,
    CAST(l_orderkey AS VARCHAR) AS matched_application_id
  FROM (SELECT l_orderkey, CAST(max(l_linenumber) AS INTEGER) AS sessions_scheduled, CAST(count(*) AS INTEGER) AS attendance_member_rows,
    CAST(floor(sum(l_quantity)) AS BIGINT) AS q, CAST(year(min(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1))"""

JOINED = f"""{APPS}, {ATT}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(project_name)) ORDER BY row_id) AS rn FROM apps),
joined AS (
  SELECT att.*, cohort_id, "Sector", outcome_clean, "Business Stage", applicant_type
  FROM att LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) a ON lower(trim(matched_project_name)) = lower(trim(project_name)))"""


def clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({column} AS VARCHAR), ''), '\\s+', ' ', 'g'))"


def norm_name(column: str) -> str:
    return f"trim(regexp_replace(lower({clean(column)}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def snippet(column: str) -> str:
    c = clean(column)
    return f"CASE WHEN length({c}) <= 160 THEN {c} ELSE rtrim(substr({c}, 1, 159)) || '...' END"


def section(column: str, label: str) -> str:
    lines = f"list_transform(string_split({column}, chr(10)), lambda x: {clean('x')})"
    mine = f"list_filter({lines}, lambda x: starts_with(x, '{label}:'))"
    return f"coalesce(ltrim(substr({mine}[-1], {len(label) + 2})), '')"


DOCS = f"""docs AS (
  SELECT row_index, CASE WHEN row_index % 23 <> 0 THEN opening ELSE '' END AS project_name, year, cohort_id, sector,
    'Project: ' || opening || chr(10) || 'Problem: ' || {clean("head")} || chr(10) || 'Solution: ' || {clean("tail")} AS text
  FROM (SELECT doc_id AS row_index, CAST(2023 + doc_id % 3 AS INTEGER) AS year,
    (2023 + doc_id % 3) || '-' || (1 + doc_id % 2) AS cohort_id, source AS sector,
    array_to_string(string_split({clean("text")}, ' ')[1:3], ' ') AS opening,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS head,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS tail
  FROM documents))"""

UNITS = """units AS (
  SELECT vec_id AS row_index, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""

INDEX = f"""{DOCS}, {UNITS}, idx AS (SELECT docs.*, u FROM docs JOIN units USING (row_index))"""
ALL_IDEAS = f"""{DOCS}, {UNITS}, idx AS (SELECT docs.*, u FROM docs LEFT JOIN units USING (row_index))"""

_FIELDS = ",\n    ".join(
    f"nullif(array_to_string(list_filter(lines, lambda x, i: (i - 1) % 9 = {i} AND length(x) > 0), ' '), '') AS {role}"
    for i, role in enumerate(roles.TEXT_ROLES)
)
_ENGLISH = ",\n    ".join(
    f"CASE lang WHEN 'en' THEN {r} WHEN 'fr' THEN translate({r}, '{roles.ACCENTED}', '{roles.PLAIN}') END AS {r}_en"
    for r in roles.TEXT_ROLES
)


def listed(labels, step: int, separator: str) -> str:
    items = ", ".join(f"'{x}'" for x in labels)
    return f"array_to_string(list_filter([{items}], lambda x, i: (row_id // {step} + i - 1) % 3 = 0), '{separator}')"


FULL = f"""{APPS}, field_docs AS (
  SELECT row_id, lang, subsector, CASE WHEN row_id % 11 = 0 THEN words || ', Uncategorized' WHEN row_id % 7 <> 0 THEN words END AS keywords, {_FIELDS}
  FROM (SELECT doc_id AS row_id, lang, source AS subsector, string_split(text, chr(10)) AS lines,
    array_to_string(string_split(lower(string_split(text, chr(10))[1]), ' ')[1:(1 + doc_id % 5)], '; ') AS words FROM documents)),
full_docs AS (SELECT *, {_ENGLISH} FROM field_docs),
full_apps AS (
  SELECT apps.*, full_docs.* EXCLUDE (row_id),
    {cycle("row_id", ("Female", "Male"))} AS gender,
    {cycle("row_id", ("Instagram", "Word of Mouth / Referral", "Email"))} AS how_heard,
    {cycle("row_id", ("Yes", "No"))} AS prior_program_experience,
    {cycle("row_id", ("No", "Yes", "Unsure"))} AS previous_participant,
    CASE WHEN row_id % 4 = 0 THEN (1990 + row_id % 12) || '.0' END AS previous_participant_year,
    CAST(row_id % 8 = 0 AS INTEGER) AS in_two_cohorts,
    "Business Stage" AS stage_raw, "Sector" AS sector_raw,
    {listed(roles.LIST_SECTORS, 1, "; ")} AS sector_all,
    {listed(roles.LIST_SECTORS, 2, ",")} AS subsector_all,
    CASE WHEN row_id % 9 <> 0 THEN {listed(roles.LIST_CHANNELS, 1, "; ")} END AS how_heard_all,
    {listed(roles.LIST_CHANNELS, 5, " ; ")} AS prior_program_experience_all,
    CASE WHEN row_id % 3 = 0 THEN 'Women' END AS target_customers,
    CASE WHEN row_id % 4 <> 0 THEN {listed(roles.LIST_TARGETS, 1, "; ")} END AS target_customers_all,
    CASE WHEN row_id % 6 = 0 THEN 'Students' END AS target_customers_normalized
  FROM apps LEFT JOIN full_docs USING (row_id))"""

SCORED = """scored AS (
  SELECT doc_id AS row_id, source || '|' || (doc_id % 300) AS identity, CAST(2023 + doc_id % 3 AS INTEGER) AS year,
    quality AS label, (n_chars % 1000) / 1000.0::DOUBLE AS model_prob,
    CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id * 7 % 26 AS DOUBLE) END AS agent_score
  FROM labels JOIN documents USING (doc_id))"""

_SPELLED = ", ".join(
    "'" + (name if i % 2 else name.upper().replace(" / ", "-")) + "'" for i, name in enumerate(roles.DIMENSIONS)
)
REVIEWS = f"""reviews AS (
  SELECT review_id, slot, CASE WHEN (review_id + slot) % 13 = 0 THEN 'Something Else' ELSE dimension END AS dimension,
    CASE WHEN number % 29 = 0 THEN 'n/a' ELSE CAST(CAST(number / 10.0 - 0.5 AS DECIMAL(6,1)) AS VARCHAR) END AS score,
    CASE WHEN review_id % 10 <> 0 THEN 'because of ' || event_type END AS rationale
  FROM (SELECT event_id AS review_id, slot, ([{_SPELLED}])[slot + 1] AS dimension, event_type,
      (event_id * (slot + 3)) % 67 AS number
    FROM events, (SELECT CAST(unnest(range(5)) AS INTEGER) AS slot)))"""

SOURCES = """sources AS (
  SELECT page_id // 12 AS idea_id, page_id % 12 AS position,
    CASE WHEN page_id % 9 = 0 THEN regexp_replace(url, '^http', 'ftp') WHEN page_id % 5 = 1 THEN 'https://shared.example.com/' || (page_id % 2) ELSE string_split(url, '?')[1] END AS url,
    CASE WHEN page_id % 5 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, html AS content
  FROM pages)"""
