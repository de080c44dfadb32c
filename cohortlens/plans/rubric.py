"""Rubric, research and report-check queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import reports, rubric
from ..sources import roles as R
from . import register
from .role_sql import APPS, REVIEWS, SOURCES

# --- criteria: hand-edited rubrics of up to eight rows each, taken from the event table ---

CRITERIA = """crit AS (SELECT event_id // 8 AS rubric_id, CAST(event_id % 8 + 1 AS INTEGER) AS position,
  CASE WHEN event_id % 37 = 0 THEN ' ' ELSE event_type || CASE WHEN event_id % 4 = 0 THEN ' A' ELSE ' b' || (event_id % 8) END END AS name,
  CASE WHEN event_id % 3 <> 0 THEN ' about ' || event_type END AS guidance,
  CASE event_id % 41 WHEN 1 THEN 'n/a' WHEN 2 THEN '-0.5' WHEN 3 THEN '1.5' WHEN 4 THEN NULL ELSE CAST((event_id % 10) / 10.0 AS VARCHAR) END AS weight FROM events)"""


def criteria(spark, d):
    key = F.col("event_id")
    return R.read(spark, d, "events").select(
        F.floor(key / 8).alias("rubric_id"),
        (key % 8 + 1).cast("int").alias("position"),
        F.when(key % 37 == 0, " ").otherwise(
            F.concat("event_type", F.when(key % 4 == 0, " A").otherwise(F.concat(F.lit(" b"), (key % 8).cast("string"))))
        ).alias("name"),
        F.when(key % 3 != 0, F.concat(F.lit(" about "), "event_type")).alias("guidance"),
        F.when(key % 41 == 1, "n/a").when(key % 41 == 2, "-0.5").when(key % 41 == 3, "1.5").when(key % 41 != 4, ((key % 10) / 10).cast("string")).alias("weight"),
    )


NORMAL = f"""{CRITERIA}, w AS (SELECT rubric_id, position, trim(name) AS name, trim(coalesce(guidance, '')) AS guidance,
  CASE WHEN TRY_CAST(weight AS DOUBLE) >= 0 THEN CAST(weight AS DOUBLE) ELSE 0 END AS v FROM crit WHERE trim(name) <> ''),
normal AS (SELECT rubric_id, position, name, guidance, round(CASE WHEN sum(v) OVER (PARTITION BY rubric_id) > 0 THEN v / sum(v) OVER (PARTITION BY rubric_id)
  ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY rubric_id) END, 6) AS weight FROM w)"""


@register("normalise_weights", f"WITH {NORMAL} SELECT * FROM normal")
def normalise_weights(spark, d):
    return rubric.normalise_weights(criteria(spark, d), ["rubric_id"])


@register("validate_criteria", f"""WITH {CRITERIA}, c AS (SELECT *, trim(name) AS n, min(position) OVER (PARTITION BY rubric_id, lower(trim(name))) AS first, TRY_CAST(weight AS DOUBLE) AS v FROM crit),
m AS (SELECT *, CASE WHEN n = '' THEN 'Row ' || position || ': criterion name is required.' WHEN position > first THEN 'Row ' || position || ': duplicate criterion ''' || n || '''.'
  WHEN v IS NULL THEN 'Row ' || position || ': ''' || n || ''' needs a weight between 0% and 100%.'
  WHEN v < 0 OR v > 1 THEN 'Row ' || position || ': ''' || n || ''' weight must be between 0% and 100%.' END AS msg FROM c)
SELECT rubric_id, count(msg) = 0 AS valid, coalesce(arg_min(msg, position) FILTER (msg IS NOT NULL), '') AS message FROM m GROUP BY 1""")
def validate_criteria(spark, d):
    return rubric.validate_criteria(criteria(spark, d), ["rubric_id"])


_SLICES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)" for i in range(8))


@register("criteria_signature", f"""WITH {NORMAL}, s AS (SELECT rubric_id, sha256(concat_ws(chr(31), position, name, guidance, printf('%.6f', weight))) AS h FROM normal)
SELECT rubric_id, sha256(concat_ws(',', {_SLICES})) AS signature FROM s GROUP BY 1""")
def criteria_signature(spark, d):
    return rubric.criteria_signature(criteria(spark, d), ["rubric_id"])


@register("criteria_table", f"""WITH {NORMAL} SELECT rubric_id, position, name, guidance, round(round(weight * 100, 1) / 100, 6) AS weight FROM normal""")
def criteria_table(spark, d):
    normal = rubric.normalise_weights(criteria(spark, d), ["rubric_id"])
    back = rubric.criteria_from_table(rubric.criteria_to_table(normal))
    return back.withColumn("weight", F.round("weight", 6))


# --- scores ---------------------------------------------------------------------------------

_KEYS = ", ".join(
    f"({i}, '{c.name}', '{rubric._letters(c.name)}', {c.weight})" for i, c in enumerate(rubric.DEFAULT_CRITERIA)
)
SCORES = f"""{REVIEWS}, rub(i, name, letters, weight) AS (VALUES {_KEYS}),
answered AS (SELECT review_id, regexp_replace(lower(dimension), '[^a-z]+', '', 'g') AS letters, arg_min(coalesce(TRY_CAST(score AS DOUBLE), 0), slot) AS score,
  arg_min(trim(coalesce(rationale, '')), slot) AS rationale FROM reviews GROUP BY 1, 2),
dims AS (SELECT ids.review_id, i, name, weight::DOUBLE AS weight, CASE WHEN a.letters IS NULL THEN 0 ELSE greatest(0, least(5, round_even(score, 1))) END AS score,
  CASE WHEN a.letters IS NULL THEN '{rubric.MISSING_DIMENSION}' ELSE rationale END AS rationale
  FROM (SELECT DISTINCT review_id FROM reviews) ids CROSS JOIN rub LEFT JOIN answered a ON a.review_id = ids.review_id AND a.letters = rub.letters),
totals AS (SELECT review_id, round_even(5 * list_sum(list(score * weight ORDER BY i)), 1) AS total_score, array_to_string(list(score ORDER BY i), ',') AS scores,
  array_to_string(list(rationale ORDER BY i), '/') AS rationales FROM dims GROUP BY 1),
scores AS (SELECT *, CASE WHEN total_score >= 19 THEN 'Strong' WHEN total_score >= 13 THEN 'Promising' ELSE 'Weak' END AS verdict FROM totals)"""


def _flat(scored):
    return scored.select(
        "review_id", "total_score", "verdict",
        F.array_join(F.transform("dimensions", lambda x: x["score"].cast("string")), ",").alias("scores"),
        F.array_join(F.transform("dimensions", lambda x: x["rationale"]), "/").alias("rationales"),
    )


@register("rubric_scores", f"WITH {SCORES} SELECT review_id, total_score, verdict, scores, rationales FROM scores")
def rubric_scores(spark, d):
    return _flat(rubric.score_payloads(R.review_scores(spark, d)))


def answer_text(flat) -> Column:
    """The flat scores of one review as the JSON text a reviewer would send."""
    entry = F.concat(
        F.lit('"'), "dimension", F.lit('": {"score": "'), "score", F.lit('", "rationale": "'),
        F.coalesce("rationale", F.lit("")), F.lit('", "evidence": ["{see} \\"note\\""]}'),
    )
    listed = F.array_sort(F.collect_list(F.struct("slot", entry.alias("e"))))
    return F.concat(F.lit('{"dimensions": {'), F.array_join(F.transform(listed, lambda x: x["e"]), ", "), F.lit("}}"))


_ENTRY = """'"' || dimension || '": {"score": "' || score || '", "rationale": "' || coalesce(rationale, '') || '", "evidence": ["{see} \\"note\\""]}'"""
ANSWERS = f"""{REVIEWS}, answers AS (SELECT review_id, '{{"dimensions": {{' || array_to_string(list({_ENTRY} ORDER BY slot), ', ') || '}}}}' AS json FROM reviews GROUP BY 1)"""


def answers(spark, d):
    """Noisy answers: fenced, chatty, or cut off in the middle."""
    packed = R.review_scores(spark, d).groupBy("review_id").agg(answer_text(None).alias("json"))
    noisy = (
        F.when(F.col("review_id") % 7 == 0, F.concat(F.lit("Sure {not json"), "json"))
        .when(F.col("review_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "json", F.lit("\n```\nHope that helps }")))
        .otherwise(F.concat("json", F.lit(" and {more}")))
    )
    return packed.select("review_id", noisy.alias("answer"))


@register("extract_json", f"WITH {ANSWERS} SELECT review_id, CASE WHEN review_id % 7 <> 0 THEN json END AS json FROM answers")
def extract_json(spark, d):
    return answers(spark, d).select("review_id", rubric.extract_json(F.col("answer")).alias("json"))


@register("rubric_scores_text", f"WITH {SCORES} SELECT review_id, total_score, verdict, scores, rationales FROM scores WHERE review_id % 7 <> 0")
def rubric_scores_text(spark, d):
    parsed = answers(spark, d).select("review_id", rubric.extract_json(F.col("answer")).alias("json")).filter("json IS NOT NULL")
    # as many answers as went into the texts, or fewer: counted there, so that no text is parsed twice
    tasks = -(-R.review_scores(spark, d).count() // rubric.ANSWERS_PER_TASK) or 1
    return _flat(rubric.score_payloads(rubric.payload_dimensions(parsed, "json", "review_id"), tasks=tasks))


_STORED = "CASE WHEN review_id % 2 = 0 THEN round(review_id % 26, 1)::DOUBLE ELSE total_score END"


@register("rescore", f"""WITH {SCORES}, st AS (SELECT review_id, {_STORED} AS total_score, CASE WHEN review_id % 5 = 0 THEN 'Weak' END AS given FROM scores)
SELECT review_id, total_score, coalesce(given, CASE WHEN total_score >= 19 THEN 'Strong' WHEN total_score >= 13 THEN 'Promising' ELSE 'Weak' END) AS verdict FROM st""")
def rescore(spark, d):
    key = F.col("review_id")
    stored = rubric.score_dimensions(R.review_scores(spark, d), rubric.DEFAULT_CRITERIA).withColumns(
        {"total_score": F.when(key % 2 == 0, (key % 26).cast("double")), "verdict": F.when(key % 5 == 0, "Weak").otherwise(" ")}
    )
    return rubric.rescore(stored).select("review_id", "total_score", "verdict")


@register("dimension_rows", f"WITH {SCORES} SELECT review_id, name AS dimension, CAST(score AS VARCHAR) || ' / 5' AS score, '20%' AS weight, rationale, '' AS evidence FROM dims")
def dimension_rows(spark, d):
    return rubric.dimension_rows(rubric.score_dimensions(R.review_scores(spark, d), rubric.DEFAULT_CRITERIA))


@register("low_evidence", f"""WITH {SCORES}, {SOURCES}, n AS (SELECT idea_id, count(*) AS c FROM sources GROUP BY 1)
SELECT review_id, coalesce(c, 0) AS source_count, c IS NULL AS low_evidence, CASE WHEN c IS NULL THEN '{rubric.LOW_EVIDENCE_NOTE}' ELSE '' END AS evidence_note,
  '{rubric.DEFAULT_RISK}' AS risk FROM scores LEFT JOIN n ON idea_id = review_id""")
def low_evidence(spark, d):
    scored = rubric.score_payloads(R.review_scores(spark, d))
    cited = R.research_sources(spark, d).withColumnRenamed("idea_id", "review_id")
    empty = F.array().cast("array<string>")
    out = rubric.with_evidence(scored, cited, "review_id").withColumns({"risks": empty, "recommendations": empty})
    return rubric.with_default_advice(out).select(
        "review_id", "source_count", "low_evidence", "evidence_note", F.col("risks")[0].alias("risk")
    )


# --- research ---------------------------------------------------------------------------------

_SHORT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_QUERIES = ", ".join("replace('" + t + "', '%s', " + _SHORT + ")" for t in rubric.QUERY_TEMPLATES)


@register("search_queries", f"SELECT doc_id, CAST(p AS INTEGER) AS position, ([{_QUERIES}])[p + 1] AS query FROM documents, (SELECT unnest(range(6)) AS p)")
def search_queries(spark, d):
    return rubric.search_queries(R.read(spark, d, "documents"), "text", "doc_id")


DEDUPED = f"""{SOURCES}, ded AS (SELECT idea_id, position, trim(url) AS url, CASE WHEN length(coalesce(title, '')) > 0 THEN title ELSE trim(url) END AS title, content AS snippet
  FROM sources WHERE regexp_matches(lower(trim(url)), '^https?://') QUALIFY row_number() OVER (PARTITION BY idea_id, trim(url) ORDER BY position) = 1)"""


@register("dedupe_sources", f"WITH {DEDUPED} SELECT * FROM ded")
def dedupe_sources(spark, d):
    return rubric.dedupe_sources(R.research_sources(spark, d))


PREFIX = f"""{DEDUPED}, bl AS (SELECT *, '- ' || title || chr(10) || '  URL: ' || url || chr(10) || '  Excerpt: ' || snippet AS block FROM ded),
pre AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY idea_id ORDER BY position) AS BIGINT) AS used FROM bl)"""


@register("context_prefix", f"WITH {PREFIX} SELECT idea_id, position, url, length(block) AS chars, used FROM pre WHERE used <= 12000")
def context_prefix(spark, d):
    kept = rubric.context_prefix(rubric.dedupe_sources(R.research_sources(spark, d)), 12_000)
    return kept.select("idea_id", "position", "url", "chars", "used")


@register("research_context", f"WITH {PREFIX} SELECT idea_id, array_to_string(list(block ORDER BY position), chr(10)) AS context FROM pre WHERE used <= 9000 GROUP BY 1")
def research_context(spark, d):
    return rubric.research_context(rubric.dedupe_sources(R.research_sources(spark, d)))


@register("build_prompts", f"""WITH {PREFIX}, ctx AS (SELECT idea_id, array_to_string(list(block ORDER BY position), chr(10)) AS context FROM pre WHERE used <= 9000 GROUP BY 1)
SELECT doc_id AS idea_id, sha256('Idea: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'Research, ' || length(coalesce(context, '')) || ' characters:' || chr(10)
  || CASE WHEN coalesce(context, '') = '' THEN 'no results' ELSE context END) AS user_hash, 5 AS rubric_lines FROM documents LEFT JOIN ctx ON idea_id = doc_id""")
def build_prompts(spark, d):
    context = rubric.research_context(rubric.dedupe_sources(R.research_sources(spark, d)))
    ideas = R.read(spark, d, "documents").select(F.col("doc_id").alias("idea_id"), "text")
    prompts = rubric.build_prompts(ideas, context)
    lines = F.size(F.filter(F.split("system", "\n"), lambda line: line.startswith("- ")))
    return prompts.select("idea_id", F.sha2("user", 256).alias("user_hash"), lines.alias("rubric_lines"))


# --- checks -----------------------------------------------------------------------------------

KPIS = "kpi AS (SELECT count(*) AS total, round_even(count(*) FILTER (outcome_clean = 'Accepted') * 100.0::DOUBLE / count(*), 1) AS rate FROM apps)"


def _reports(spark, d):
    key = F.col("review_id")
    kpis = reports.kpis(R.applications(spark, d))
    scored = rubric.score_payloads(R.review_scores(spark, d))
    total, rate = kpis.select("total").scalar(), kpis.select("rate").scalar()
    built = scored.select(
        "review_id",
        F.when(key % 19 != 0, F.col("dimensions")).alias("dimensions"),
        (F.col("total_score") + F.when(key % 11 == 0, 2.0).otherwise(0.5)).alias("total_score"),
        F.when(key % 6 == 0, F.array().cast("array<string>")).when(key % 7 == 0, F.array(F.lit("ftp://x"))).otherwise(F.array(F.lit("HTTPS://a.example"))).alias("urls"),
        F.when(key % 17 != 0, F.concat(F.lit("There are many applications: "), F.when(key % 4 != 0, total.cast("string")).otherwise("?"))).alias("summary"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("insights"),
        (total + F.when(key % 13 == 0, 1).otherwise(0)).alias("kpi_applications"),
        rate.alias("kpi_rate"),
        F.when(key % 23 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    return built, kpis


CHECKED = f"""{APPS}, {KPIS}, {SCORES}, complete AS (SELECT review_id, bool_and(length(rationale) > 0 AND NOT contains(lower(rationale), 'did not provide')) AS argued FROM dims GROUP BY 1),
checked AS (SELECT s.review_id, s.review_id % 19 <> 0 AND s.review_id % 17 <> 0 AS report_parse, s.review_id % 19 <> 0 AND argued AS dimensions_complete,
  s.review_id % 19 <> 0 AS scores_in_range, s.review_id % 19 <> 0 AND s.review_id % 11 <> 0 AS weighted_consistent,
  s.review_id % 19 <> 0 AND s.review_id % 6 <> 0 AND s.review_id % 7 <> 0 AS sources_valid, s.review_id % 17 <> 0 AND s.review_id % 5 <> 0 AS dashboard_nonempty,
  s.review_id % 17 <> 0 AND s.review_id % 13 <> 0 AS dashboard_kpis_match, s.review_id % 17 <> 0 AND s.review_id % 4 <> 0 AS dashboard_narrative_grounded,
  s.review_id % 23 <> 0 AS no_errors FROM scores s JOIN complete c ON s.review_id = c.review_id)"""


@register("check_reports", f"WITH {CHECKED} SELECT * FROM checked")
def check_reports(spark, d):
    return rubric.check_reports(*_reports(spark, d)).select("review_id", *rubric.CHECKS)


_PASS = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER ({c}) AS passed, count(*) AS total FROM checked" for c in rubric.CHECKS)


@register("pass_rates", f"WITH {CHECKED}, p AS ({_PASS}) SELECT *, passed || '/' || total AS rate FROM p")
def pass_rates(spark, d):
    return rubric.pass_rates(rubric.check_reports(*_reports(spark, d)))


@register("control_direction", f"""WITH {SCORES}, e AS (SELECT review_id, total_score, CASE review_id % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'strong' ELSE 'edge' END AS expected FROM scores)
SELECT *, CASE expected WHEN 'weak' THEN total_score <= 12 WHEN 'strong' THEN total_score >= 19 ELSE review_id % 4 = 0 END AS direction_expected FROM e""")
def control_direction(spark, d):
    key = F.col("review_id")
    scored = rubric.score_payloads(R.review_scores(spark, d)).withColumns(
        {
            "expected": F.when(key % 3 == 0, "weak").when(key % 3 == 1, "strong").otherwise("edge"),
            "report_parse": key % 4 == 0,
        }
    )
    return rubric.control_direction(scored).select("review_id", "total_score", "expected", "direction_expected")


@register("latency_summary", "SELECT round(avg(value), 2) AS mean, round(median(value), 2) AS p50, max(value) AS max FROM events")
def latency_summary(spark, d):
    return rubric.latency_summary(R.read(spark, d, "events"), "value")
