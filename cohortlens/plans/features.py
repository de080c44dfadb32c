"""Feature queries over the wide applicant table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import FOR_YEARS, SINCE_YEAR
from ..operators import features as K
from ..sources import roles as R
from . import register
from .role_sql import FULL

QUESTION = "|"  # stands for the question mark, which the documents lack


def _int(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER)"


def _full(spark, d):
    return R.full_applicants(spark, d)


def _rounded(df, *columns: str):
    kinds = dict(df.dtypes)
    return df.select("row_id", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


_YEARED = f"{FULL}, f AS (SELECT *, year AS app_year FROM full_apps)"


@register("feat_identity", f"WITH {FULL} SELECT row_id, project_name || '|' || coalesce(date_of_birth, '') AS identity, {_int(chr(39).join(['outcome_clean = ', 'Accepted', '']))} AS y, year AS app_year FROM full_apps")
def feat_identity(spark, d):
    return K.feat_identity(_full(spark, d)).select("row_id", "identity", "y", "app_year")


_SIZE = "TRY_CAST(CASE WHEN team_member_count = '5+' THEN '6' ELSE team_member_count END AS DOUBLE)"
_AGE = "year - CAST(year(TRY_CAST(date_of_birth AS DATE)) AS INTEGER)"
_UNKNOWN = {"gender_f": "gender", "employment_f": "employment_status", "education_f": "education", "how_heard_f": "how_heard", "prior_program_f": "prior_program_experience", "prev_participant_f": "previous_participant", "cohort_f": "cohort"}
_TEAM = _int("individual_or_team = 'Team'")


@register("feat_demographic", f"""WITH {FULL} SELECT row_id, {_AGE} AS age, {_SIZE} AS team_member_count_num, {_TEAM} AS is_team,
  CASE WHEN nationality = 'Bahrain' THEN 'Bahrain' ELSE 'Other' END AS nationality_bin, {", ".join(f"coalesce({c}, 'Unknown') AS {n}" for n, c in _UNKNOWN.items())},
  CAST({_AGE} IS NULL AS INTEGER) AS age_missing_flag, CAST({_SIZE} IS NULL AS INTEGER) AS team_missing_flag FROM full_apps""")
def feat_demographic(spark, d):
    out = K.feat_demographic(K.feat_identity(_full(spark, d)))
    return out.select("row_id", "age", "team_member_count_num", "is_team", "nationality_bin", *_UNKNOWN, "age_missing_flag", "team_missing_flag")


_CR = _int("has_commercial_registration = 'Yes'")
_PREV = "TRY_CAST(previous_participant_year AS DOUBLE)"


@register("feat_registration", f"""WITH {FULL} SELECT row_id, {_CR} AS cr, {_CR} * {_TEAM} AS cr_and_team, in_two_cohorts,
  CASE WHEN {_PREV} IS NOT NULL AND year IS NOT NULL THEN greatest(0, year - {_PREV}) END AS prev_year_recency, CAST({_PREV} IS NULL AS INTEGER) AS prev_year_missing_flag FROM full_apps""")
def feat_registration(spark, d):
    out = K.feat_registration(K.feat_demographic(K.feat_identity(_full(spark, d))))
    return out.select("row_id", "cr", "cr_and_team", "in_two_cohorts", "prev_year_recency", "prev_year_missing_flag")


_MATURITY = "CASE \"Business Stage\" WHEN 'Idea' THEN 0 WHEN 'MVP' THEN 1 WHEN 'Revenue Generating' THEN 2 WHEN 'Operating' THEN 3 ELSE -1 END"


@register("feat_stage", f"""WITH {FULL} SELECT row_id, coalesce("Business Stage", 'Not Specified') AS stage_f, coalesce("Sector", 'Not Specified') AS sector_f, coalesce("Age Group", 'Not Specified') AS age_group_f,
  CAST(sector_raw IS NULL AS INTEGER) AS sector_missing_flag, CAST(stage_raw IS NULL AS INTEGER) AS stage_missing_flag, {_MATURITY} AS stage_maturity, {_CR} * CAST({_MATURITY} >= 1 AS INTEGER) AS cr_established FROM full_apps""")
def feat_stage(spark, d):
    out = K.feat_stage(_base(spark, d))
    return out.select("row_id", "stage_f", "sector_f", "age_group_f", "sector_missing_flag", "stage_missing_flag", "stage_maturity", "cr_established")


def _base(spark, d):
    return K.feat_registration(K.feat_demographic(K.feat_identity(_full(spark, d))))


def _list(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '')"


@register("split_list", f"WITH {FULL} SELECT row_id, array_to_string({_list('sector_all')}, '/') AS parts FROM full_apps")
def split_list(spark, d):
    from ..functions.text import split_list as split

    return _full(spark, d).select("row_id", F.array_join(split(F.col("sector_all")), "/").alias("parts"))


_COMMON = "[" + ", ".join(f"'{s}'" for s in K.COMMON_SECTORS) + "]"
_SECTOR_FLAGS = {f"sector_flag_{K.slug(s)}": s for s in K.COMMON_SECTORS}
_LIST_COLUMNS = ("sector_count", "subsector_count", "how_heard_count", "target_count", "prior_program_count", "sector_all_tech", "sector_all_common", "is_common_sector", "sector_tech_named", *_SECTOR_FLAGS)
_COUNTED = {"sector": "sector_all", "subsector": "subsector_all", "how_heard": "how_heard_all", "target": "target_customers_all", "prior_program": "prior_program_experience_all"}


@register("feat_sector_lists", f"""WITH {FULL}, p AS (SELECT *, {_list("sector_all")} AS parts FROM full_apps)
SELECT row_id, {", ".join(f"CAST(len({_list(c)}) AS INTEGER) AS {n}_count" for n, c in _COUNTED.items())},
  CAST(len(list_filter(parts, lambda x: contains(x, 'Technology & IT'))) > 0 AS INTEGER) AS sector_all_tech, CAST(list_has_any(parts, {_COMMON}) AS INTEGER) AS sector_all_common,
  CAST(coalesce(list_contains({_COMMON}, "Sector"), false) OR list_has_any(parts, {_COMMON}) AS INTEGER) AS is_common_sector, {_int('"Sector" = ' + "'Technology & IT'")} AS sector_tech_named,
  {", ".join(f"CAST(list_contains(parts, '{s}') AS INTEGER) AS {n}" for n, s in _SECTOR_FLAGS.items())} FROM p""")
def feat_sector_lists(spark, d):
    return K.feat_sector_lists(K.feat_stage(_base(spark, d))).select("row_id", *_LIST_COLUMNS)


def _flags(prefix: str, labels) -> dict[str, str]:
    return {f"{prefix}_{K.slug(x)}": x for x in labels}


def _flag_sql(columns, prefix: str, labels) -> str:
    joined = " || ';' || ".join(f"coalesce({c}, '')" for c in columns)
    return ", ".join(f"CAST(contains({joined}, '{x}') AS INTEGER) AS {n}" for n, x in _flags(prefix, labels).items())


@register("feat_targets", f"WITH {FULL} SELECT row_id, 1 AS has_target_customers, {_flag_sql(('target_customers_all', 'target_customers_normalized'), 'target_flag', K.SEGMENTS)} FROM full_apps")
def feat_targets(spark, d):
    return K.feat_targets(_full(spark, d)).select("row_id", "has_target_customers", *_flags("target_flag", K.SEGMENTS))


@register("feat_channels", f"WITH {FULL} SELECT row_id, {_flag_sql(('how_heard_all', 'how_heard'), 'channel_flag', K.CHANNELS)} FROM full_apps")
def feat_channels(spark, d):
    return K.feat_channels(_full(spark, d)).select("row_id", *_flags("channel_flag", K.CHANNELS))


@register("submission_timing", f"""WITH {FULL} SELECT row_id, CAST(dayofyear(submitted_at) AS INTEGER) AS submission_dayofyear, CAST(isodow(submitted_at) - 1 AS INTEGER) AS submission_weekday,
  CAST(hour(submitted_at) AS INTEGER) AS submission_hour, 0 AS submission_missing_flag, date_sub('day', min(submitted_at) OVER (PARTITION BY cohort_id), submitted_at) AS days_since_round_start FROM full_apps""")
def submission_timing(spark, d):
    return K.submission_timing(_full(spark, d)).select(
        "row_id", "submission_dayofyear", "submission_weekday", "submission_hour", "submission_missing_flag", "days_since_round_start"
    )


# Business ages hardly occur in generated prose: the query appends such phrases by key.
_PHRASE = "CASE row_id % 6 WHEN 0 THEN ' founded in 2019' WHEN 1 THEN ' operating for 3 years' WHEN 2 THEN ' selling over 45 years' WHEN 3 THEN ' since 1999' ELSE '' END"
_AGE_TEXT = f"lower(project_name || ' | ' || coalesce(keywords, '') || {_PHRASE} || ' | ' || coalesce(problem_en, '') || coalesce(solution_en, '') || coalesce(impact_en, ''))"


@register("business_age", f"""WITH {FULL}, t AS (SELECT row_id, year, regexp_extract({_AGE_TEXT}, '{SINCE_YEAR}', 1) AS a, TRY_CAST(regexp_extract({_AGE_TEXT}, '{FOR_YEARS}', 1) AS INTEGER) AS b FROM full_apps),
v AS (SELECT row_id, CASE WHEN a <> '' THEN CASE WHEN year IS NOT NULL THEN greatest(0, year - CAST(a AS INTEGER)) END WHEN b <= 30 THEN b END AS age FROM t)
SELECT row_id, age AS business_age_regex, CAST(age IS NULL AS INTEGER) AS business_age_missing_flag FROM v""")
def business_age(spark, d):
    key = F.col("row_id")
    phrase = F.when(key % 6 == 0, " founded in 2019").when(key % 6 == 1, " operating for 3 years").when(key % 6 == 2, " selling over 45 years").when(key % 6 == 3, " since 1999").otherwise("")
    df = K.feat_identity(_full(spark, d)).withColumn("keywords", F.concat(F.coalesce("keywords", F.lit("")), phrase))
    return K.feat_business_age(df).select("row_id", "business_age_regex", "business_age_missing_flag")


def _wc(c: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda x: x <> '')) AS INTEGER)"


def _mw(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, 'nan')), '[A-Za-z0-9\\x{{0600}}-\\x{{06FF}}]+')"


def _unique(c: str) -> str:
    return f"round(CASE WHEN len({_mw(c)}) = 0 THEN 0.0 ELSE len(list_distinct({_mw(c)}))::DOUBLE / len({_mw(c)}) END, 6)"


_STATS = ", ".join(
    f"{_int(f'{t}_en IS NOT NULL')} AS {t}_en_has, {_wc(t + '_en')} AS {t}_en_words, {_unique(t + '_en')} AS {t}_en_unique, {_wc(t)} AS {t}_raw_words"
    for t in K.TEXTS
)


def _sum(suffix: str) -> str:
    return " + ".join(f"{t}{suffix}" for t in K.TEXTS)


STATS = f"stats AS (SELECT row_id, {_STATS} FROM full_apps)"


@register("text_stats", f"WITH {FULL}, {STATS} SELECT *, {_sum('_en_words')} AS text_word_total, {_sum('_raw_words')} AS text_raw_total, {_sum('_en_has')} AS n_text_fields_present FROM stats")
def text_stats(spark, d):
    names = [f"{t}{s}" for t in K.TEXTS for s in ("_en_has", "_en_words", "_en_unique", "_raw_words")]
    return _rounded(K.text_stats(_full(spark, d)), *names, "text_word_total", "text_raw_total", "n_text_fields_present")


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_mw(a)})", f"list_distinct({_mw(b)})"
    return f"round(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END, 6)"


@register("token_jaccard", f"WITH {FULL} SELECT row_id, {_jaccard('problem_en', 'solution_en')} AS problem_solution_jaccard, {_jaccard('impact_en', 'inspiration_en')} AS impact_inspiration_jaccard FROM full_apps")
def token_jaccard(spark, d):
    return _rounded(K.token_jaccard(_full(spark, d)), "problem_solution_jaccard", "impact_inspiration_jaccard")


@register("feat_text_marks", f"""WITH {FULL} SELECT row_id, CAST(regexp_matches(coalesce(solution_en, ''), '\\d') AS INTEGER) AS solution_has_numbers,
  CAST(regexp_matches(lower(coalesce(solution_en, '')), '\\b(bhd|dinar|dinars|bd|usd|\\$)\\b') AS INTEGER) AS solution_has_currency, CAST(contains(coalesce(problem_en, ''), '{QUESTION}') AS INTEGER) AS problem_has_question FROM full_apps""")
def feat_text_marks(spark, d):
    return K.feat_text_marks(_full(spark, d), QUESTION).select("row_id", "solution_has_numbers", "solution_has_currency", "problem_has_question")


FREQUENCY = f"""kw AS (SELECT row_id, lower(unnest({_list("keywords")})) AS keyword FROM full_apps),
freq AS (SELECT keyword, count(*) AS n FROM kw WHERE keyword <> 'uncategorized' GROUP BY 1)"""


@register("keyword_frequency", f"WITH {FULL}, {FREQUENCY} SELECT keyword, n FROM freq ORDER BY n DESC, keyword LIMIT 30")
def keyword_frequency(spark, d):
    return K.keyword_frequency(_full(spark, d)).orderBy(F.desc("n"), "keyword").limit(K.KEYWORD_FLAGS)


# Column names of the top-keyword flags depend on the data; here they are one digit string.
@register("feat_keywords", f"""WITH {FULL}, {FREQUENCY}, top AS (SELECT list(keyword ORDER BY n DESC, keyword) AS words FROM (SELECT * FROM freq ORDER BY n DESC, keyword LIMIT 30)),
per AS (SELECT row_id, avg(coalesce(n, 0)) AS m, min(coalesce(n, 0)) AS lo, avg(CAST(coalesce(n, 0) <= 3 AS INTEGER)) AS s FROM kw LEFT JOIN freq USING (keyword) GROUP BY 1)
SELECT row_id, CAST(len({_list("keywords")}) AS INTEGER) AS keyword_count, CAST(contains(lower(coalesce(keywords, '')), 'uncategorized') AS INTEGER) AS keywords_uncategorized,
  round(coalesce(m, 0), 6) AS kw_mean_freq, coalesce(lo, 0) AS kw_min_freq, round(coalesce(s, 0), 6) AS kw_novel_share,
  array_to_string(list_transform(words, lambda w: CAST(contains(lower(coalesce(keywords, '')), w) AS INTEGER)), '') AS flags
FROM full_apps LEFT JOIN per USING (row_id), top""")
def feat_keywords(spark, d):
    df = _full(spark, d).select("row_id", "keywords")
    frequency = K.keyword_frequency(df)
    top = K.top_keywords(frequency)
    out = K.feat_keywords(df, frequency=frequency, top=top)
    out = out.withColumn("flags", F.concat_ws("", *[F.col(c).cast("string") for c in K.keyword_columns(top)]))
    return _rounded(out, "keyword_count", "keywords_uncategorized", "kw_mean_freq", "kw_min_freq", "kw_novel_share", "flags")


def _terms(text: str, terms) -> str:
    alternatives = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(set(terms), key=len, reverse=True))
    return f"CAST(regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{alternatives})($|[^\\p{{L}}\\p{{N}}_])') AS INTEGER)"


_ALL = "lower(concat_ws(' | ', coalesce(keywords, ''), coalesce(problem_en, ''), coalesce(solution_en, ''), coalesce(project_name, ''), coalesce(impact_en, '')))"
# The generated prose has almost no English business words; its keywords get some by key.
_SEED = "CASE row_id % 8 WHEN 0 THEN '; smart food' WHEN 1 THEN '; Real Estate, data' WHEN 2 THEN '; artificial intelligence' WHEN 3 THEN '; jobs, hire; export' WHEN 4 THEN '; social  media' WHEN 5 THEN '; e-commerce; loan' WHEN 6 THEN ', local.community' ELSE '' END"
SEEDED = f"{FULL}, seeded AS (SELECT * REPLACE (coalesce(keywords, '') || {_SEED} AS keywords) FROM full_apps)"


def seeded(spark, d):
    key = F.col("row_id")
    words = ("; smart food", "; Real Estate, data", "; artificial intelligence", "; jobs, hire; export", "; social  media", "; e-commerce; loan", ", local.community")
    extra = F.lit("")
    for i, w in enumerate(words):
        extra = F.when(key % 8 == i, w).otherwise(extra)
    return _full(spark, d).withColumn("keywords", F.concat(F.coalesce("keywords", F.lit("")), extra))


THEME_SQL = ", ".join(f"{_terms('t', terms)} AS theme_{n}" for n, terms in K.THEMES.items())


@register("theme_flags", f"WITH {SEEDED}, t AS (SELECT row_id, {_ALL} AS t FROM seeded), f AS (SELECT row_id, {THEME_SQL} FROM t) SELECT *, {' + '.join('theme_' + n for n in K.THEMES)} AS theme_count FROM f")
def theme_flags(spark, d):
    return K.theme_flags(seeded(spark, d)).select("row_id", *[f"theme_{n}" for n in K.THEMES], "theme_count")


@register("feat_signals", f"WITH {SEEDED}, t AS (SELECT row_id, {_ALL} AS t FROM seeded) SELECT row_id, {', '.join(f'{_terms(chr(116), terms)} AS {n}' for n, terms in K.SIGNALS.items())} FROM t")
def feat_signals(spark, d):
    return K.feat_signals(seeded(spark, d)).select("row_id", *K.SIGNALS)


_TECH = " OR ".join(
    f"{_terms(f'lower({t})', K.TECH_TERMS)} = 1"
    for t in ("coalesce(keywords, '')", "coalesce(problem_en, '') || coalesce(solution_en, '')", "coalesce(project_name, '')")
)
TECH = f"""tech AS (SELECT row_id, CAST(contains(coalesce(sector_all, ''), 'Technology & IT') OR {_TECH} AS INTEGER) AS tech_coupled,
  CAST(coalesce(list_contains({_COMMON}, "Sector"), false) OR list_has_any({_list("sector_all")}, {_COMMON}) AS INTEGER) AS common, {_wc("impact_en")} AS iw, {_TEAM} AS team, {_MATURITY} AS maturity FROM seeded)"""


@register("feat_tech", f"""WITH {SEEDED}, {TECH} SELECT row_id, tech_coupled, CAST(common = 1 AND tech_coupled = 0 AS INTEGER) AS common_sector_without_tech,
  iw * tech_coupled AS impact_tech_proxy, tech_coupled * team AS tech_and_team, tech_coupled * (maturity + 1) AS tech_and_stage FROM tech""")
def feat_tech(spark, d):
    df = seeded(spark, d)
    for step in (K.feat_identity, K.feat_demographic, K.feat_registration, K.feat_stage, K.feat_sector_lists, K.text_stats, K.feat_tech):
        df = step(df)
    return df.select("row_id", "tech_coupled", "common_sector_without_tech", "impact_tech_proxy", "tech_and_team", "tech_and_stage")


_KW_COUNT, _NOVEL = "keyword_count", "novel"
CRITERIA = f"""{FREQUENCY}, per AS (SELECT row_id, avg(CAST(coalesce(n, 0) <= 3 AS INTEGER)) AS novel FROM kw LEFT JOIN freq USING (keyword) GROUP BY 1),
ages AS (SELECT row_id, regexp_extract({_AGE_TEXT.replace(" || " + _PHRASE, "")}, '{SINCE_YEAR}', 1) <> '' AND year IS NOT NULL OR coalesce(TRY_CAST(regexp_extract({_AGE_TEXT.replace(" || " + _PHRASE, "")}, '{FOR_YEARS}', 1) AS INTEGER) <= 30, false) AND regexp_extract({_AGE_TEXT.replace(" || " + _PHRASE, "")}, '{SINCE_YEAR}', 1) = '' AS aged FROM full_apps),
crit AS (SELECT row_id, {_int(_wc("problem_en") + " >= 20")} + {_int(_wc("problem_en") + " >= 60")} + {_int("contains(problem_en, '?')")} + {_int(_unique("problem_en") + " >= 0.5")} AS crit_problem,
  {_int(_wc("solution_en") + " >= 20")} + {_int(_wc("solution_en") + " >= 60")} + {_int("regexp_matches(solution_en, '[0-9]')")} + {_int(_jaccard("problem_en", "solution_en") + " >= 0.35")} AS crit_solution,
  {_int("differentiation_en IS NOT NULL")} + {_int(_wc("differentiation_en") + " >= 15")} + {_int("novel >= 0.5")} + {_int(f"len({_list('keywords')}) >= 4")} AS crit_innovation,
  1 + {_int(f"len({_list('target_customers_all')}) >= 1")} + CAST(coalesce(list_contains({_COMMON}, "Sector"), false) OR list_has_any({_list("sector_all")}, {_COMMON}) AS INTEGER) + {_int(_wc("impact_en") + " >= 15")} AS crit_market,
  {_CR} + {_int(_MATURITY + " >= 1")} + {_int(_SIZE + " >= 2")} + CAST(aged AS INTEGER) AS crit_feasibility FROM full_apps LEFT JOIN per USING (row_id) JOIN ages USING (row_id))"""


@register("feat_criteria", f"""WITH {FULL}, {CRITERIA}, {TECH.replace("FROM seeded", "FROM full_apps")}
SELECT crit.*, crit_problem + crit_solution + crit_innovation + crit_market + crit_feasibility AS crit_total, crit_solution * crit_feasibility AS crit_solution_feasibility,
  crit_market * tech_coupled AS crit_tech_market FROM crit JOIN tech USING (row_id)""")
def feat_criteria(spark, d):
    return K.engineer_features(_full(spark, d)).select("row_id", *K.NUMERIC["criteria_proxy"])


@register("feat_name", f"WITH {FULL} SELECT row_id, CAST(length(project_name) AS INTEGER) AS name_len, CAST(regexp_matches(project_name, '[0-9]') AS INTEGER) AS name_has_digit, CAST(regexp_matches(project_name, '[\\x{{0600}}-\\x{{06FF}}]') AS INTEGER) AS name_has_arabic FROM full_apps")
def feat_name(spark, d):
    return K.feat_name(_full(spark, d)).select("row_id", "name_len", "name_has_digit", "name_has_arabic")


@register("pos_weight", f"WITH {FULL} SELECT round(count(*) FILTER (outcome_clean <> 'Accepted')::DOUBLE / greatest(1, count(*) FILTER (outcome_clean = 'Accepted')), 6) AS pos_weight FROM full_apps")
def pos_weight(spark, d):
    from ..operators.learning import pos_weight as weight

    return weight(K.feat_identity(_full(spark, d))).select(F.round("pos_weight", 6).alias("pos_weight"))
