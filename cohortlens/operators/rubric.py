"""Selection rubrics: criteria tables, score payloads, research sources and report checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import verdict
from ..functions.text import clean_text, strip


@dataclass(frozen=True)
class Criterion:
    """One rubric dimension; the weight is a fraction of 1."""

    name: str
    guidance: str = ""
    weight: float = 0.0


# The default rubric, scales, notes and limits.
DEFAULT_CRITERIA = (
    Criterion("Problem / Need", "Is there a clear and relevant problem being addressed?", 0.2),
    Criterion("Solution / Idea", "Is the proposed solution clear and does it effectively address the problem?", 0.2),
    Criterion("Innovation / Differentiation", "Is the idea innovative, different, or offering a new approach?", 0.2),
    Criterion("Market Potential", "Is there a clear target customer/market and potential for the idea to grow?", 0.2),
    Criterion("Feasibility", "Is the idea realistic and achievable, considering the technology, resources, regulations in Bahrain and capabilities required?", 0.2),
)
MAX_SCORE = 5.0
MAX_CRITERIA = 10_000  # a rubric is read by the driver
ANSWERS_PER_TASK = 500_000
MISSING_DIMENSION = "The model did not provide a score for this dimension."
NO_DIMENSION_MARK = "did not provide"
LOW_EVIDENCE_NOTE = (
    "Web research returned no usable sources, so this score is low-confidence and should be "
    "treated as a first-pass estimate."
)
DEFAULT_RISK = "The model did not identify specific risks; treat this score as a rough first pass."
DEFAULT_RECOMMENDATION = "Validate demand with target customers before building."
QUERY_TEMPLATES = (
    '"%s" startup OR product',
    '"%s" competitors OR similar existing solutions',
    '"%s" market size OR market demand OR problem',
    '"%s" trend OR innovation OR emerging 2024 2025',
    '"%s" Bahrain market OR local demand',
    '"Bahrain" "%s" regulation OR policy OR national strategy',
)
CONTEXT_CHARS = 9000
TOTAL_TOLERANCE = 0.6
WEAK_TOTAL, STRONG_TOTAL = 12, 19


# --- criteria ------------------------------------------------------------------------------

def _weight(col: Column) -> Column:
    """Readable, finite and non-negative, else 0."""
    value = col.try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(good, value).otherwise(0.0)


def normalise_weights(criteria: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Named criteria with weights summing to 1 per rubric; all-zero weights become equal."""
    named = criteria.withColumns({"name": strip(F.col("name")), "_w": _weight(F.col("weight"))}).filter(
        F.col("name") != ""
    )
    totals = named.groupBy(*by).agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_n"))
    if by:
        joined = named.join(totals, list(by))
    else:
        joined = named.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    weight = F.when(F.col("_total") > 0, F.col("_w") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    return joined.withColumns(
        {"weight": F.round(weight, 6), "guidance": strip(F.coalesce("guidance", F.lit("")))}
    ).drop("_w", "_total", "_n")


def load_criteria(source: DataFrame | str | None = None, spark: SparkSession | None = None) -> list[Criterion]:
    """Criteria of a table or JSON file in row order, weights normalised; defaults when
    there are none."""
    if isinstance(source, str):
        try:
            source = spark.read.json(source, multiLine=True)
        except Exception as error:  # an absent file means the built-in rubric
            if "PATH_NOT_FOUND" not in str(error):
                raise
            source = None
    if source is None or "name" not in source.columns:
        return list(DEFAULT_CRITERIA)
    for c in ("guidance", "weight"):
        if c not in source.columns:
            source = source.withColumn(c, F.lit(None).cast("string"))
    table = source.filter(F.col("name").isNotNull())
    rows = normalise_weights(table).select("name", "guidance", "weight").limit(MAX_CRITERIA + 1).collect()
    if len(rows) > MAX_CRITERIA:
        raise ValueError(f"a rubric has at most {MAX_CRITERIA} criteria")
    return [Criterion(r.name, r.guidance, r.weight) for r in rows] or list(DEFAULT_CRITERIA)


def save_criteria(criteria: DataFrame, path: str) -> None:
    if criteria.isEmpty():
        raise ValueError("at least one criterion is required")
    normalise_weights(criteria).coalesce(1).write.mode("overwrite").json(path)


def validate_criteria(criteria: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(valid, message) per rubric; the message is that of the first bad row."""
    name = strip(F.coalesce("name", F.lit("")))
    rows = criteria.withColumns({"_name": name, "_folded": F.lower(name)})
    first = rows.groupBy(*by, "_folded").agg(F.min("position").alias("_first"))
    joined = rows.join(first, [*by, "_folded"])
    value = F.col("weight").try_cast("double")
    outside = F.isnan(value) | (value < 0) | (value > 1)
    message = (
        F.when(F.col("_name") == "", F.format_string("Row %d: criterion name is required.", "position"))
        .when(F.col("position") > F.col("_first"), F.format_string("Row %d: duplicate criterion '%s'.", "position", "_name"))
        .when(value.isNull(), F.format_string("Row %d: '%s' needs a weight between 0%% and 100%%.", "position", "_name"))
        .when(outside, F.format_string("Row %d: '%s' weight must be between 0%% and 100%%.", "position", "_name"))
    )
    failing = F.when(message.isNotNull(), F.struct("position", message.alias("m")))
    out = joined.groupBy(*by).agg(F.min(failing).alias("_f"), F.count(F.lit(1)).alias("_n"))
    none = F.when(F.col("_n") == 0, "Add at least one selection criterion.")
    text = F.coalesce(none, F.col("_f.m"), F.lit(""))
    return out.select(*by, (text == "").alias("valid"), text.alias("message"))


def criteria_signature(criteria: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One hash per rubric that changes with any name, guidance, weight or order."""
    line = F.concat_ws("\x1f", F.col("position").cast("string"), "name", "guidance", F.format_string("%.6f", "weight"))
    hashed = normalise_weights(criteria, by).withColumn("_h", F.sha2(line, 256))
    slices = [
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")).cast("string") for i in range(8)
    ]
    return hashed.groupBy(*by).agg(F.sha2(F.concat_ws(",", *slices), 256).alias("signature"))


def criteria_to_table(criteria: DataFrame) -> DataFrame:
    return criteria.select(
        *[c for c in criteria.columns if c not in ("name", "guidance", "weight")],
        F.col("name").alias("Name"), F.col("guidance").alias("Guidance"),
        F.round(F.col("weight") * 100, 1).alias("Weight (%)"),
    )


def criteria_from_table(table: DataFrame) -> DataFrame:
    """Edited table back to criteria; nameless rows go, unreadable weights become NaN."""
    name = strip(F.coalesce("Name", F.lit("")))
    return table.filter(name != "").select(
        *[c for c in table.columns if c not in ("Name", "Guidance", "Weight (%)")],
        name.alias("name"), strip(F.coalesce("Guidance", F.lit(""))).alias("guidance"),
        F.coalesce(F.col("`Weight (%)`").try_cast("double") / 100, F.lit(float("nan"))).alias("weight"),
    )


# --- payloads --------------------------------------------------------------------------------

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_MARK = re.compile(r'"(?:\\.|[^"\\])*"|["{}]', re.DOTALL)


def _first_object(text: str | None) -> str | None:
    """First balanced {...} outside of strings, inside a code fence if there is one."""
    if not text:
        return None
    fenced = _FENCE.search(text)
    body = fenced.group(1) if fenced else text
    start = body.find("{")
    depth = 0
    for mark in _MARK.finditer(body, max(start, 0)) if start >= 0 else ():
        if mark.group() == "{":
            depth += 1
        elif mark.group() == "}":
            depth -= 1
            if depth == 0:
                return body[start : mark.end()]
        elif mark.group() == '"':
            return None  # a string that never ends
    return None


@F.pandas_udf(T.StringType())
def _balanced(text: pd.Series) -> pd.Series:
    return text.map(_first_object)


def extract_json(col: Column) -> Column:
    """JSON object text inside a noisy answer, null when there is none or it is broken.

    Balanced braces need a scan no built-in offers; validity is checked natively.
    """
    found = _balanced(col)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def payload_dimensions(df: DataFrame, json: str, key: str) -> DataFrame:
    """(key, slot, dimension, score, rationale, evidence): one row per answered dimension.

    An answer without any keeps one row with an empty dimension, so it is still scored.
    """
    parsed = F.from_json(F.col(json), "dimensions map<string,string>")
    rows = df.select(key, F.posexplode_outer(parsed["dimensions"]).alias("slot", "_name", "_value"))
    inner = rows.withColumns(
        {
            "dimension": F.when(F.col("_value").startswith("{"), F.col("_name")).otherwise(""),
            "_v": F.from_json("_value", "score string, rationale string, evidence string"),
        }
    )
    listed = F.from_json(F.col("_v.evidence"), "array<string>")
    single = F.when(F.length(F.coalesce("_v.evidence", F.lit(""))) > 0, F.array("_v.evidence")).otherwise(F.array().cast("array<string>"))
    evidence = F.when(F.col("_v.evidence").startswith("["), listed).otherwise(single)
    return inner.select(key, "slot", "dimension", "_v.score", "_v.rationale", evidence.alias("evidence"))


def _letters(text: str) -> str:
    return re.sub(r"[^a-z]+", "", text.lower())


def score_dimensions(flat: DataFrame, criteria: Sequence[Criterion], key: str = "review_id", tasks: int | None = None) -> DataFrame:
    """(key, dimensions): an array with one scored struct per criterion, in rubric order.

    Names match on letters only and the first answer for a criterion counts. Scores are
    rounded to one digit (halves to even) and clamped to 0..5; an unanswered criterion scores 0. One
    grouped pass with a conditional minimum per criterion, so nothing is multiplied out. A minimum of
    structs is taken over sorted rows, so rows are dealt by key first: before the shuffle one task
    would sort all the answers that its part of a file unfolds to. They are dealt over ``tasks``
    tasks; without it ``flat`` is counted, and a task gets ANSWERS_PER_TASK rows at any table size.
    """
    letters = F.regexp_replace(F.lower("dimension"), "[^a-z]+", "")
    asked = list(dict.fromkeys(_letters(c.name) for c in criteria))
    number = F.when(F.lit(False), 0)
    for i, name in enumerate(asked):
        number = number.when(letters == name, i)
    cited = "evidence" in flat.columns
    none = F.array().cast("array<string>")
    row = F.struct(
        "slot",
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
        strip(F.coalesce("rationale", F.lit(""))).alias("rationale"),
        *(["evidence"] if cited else []),
    )
    rows = flat.select(key, number.alias("_key"), F.when(number.isNotNull(), row).alias("_row"))
    picks = [F.min(F.when(F.col("_key") == asked.index(_letters(c.name)), F.col("_row"))).alias(f"_c{i}") for i, c in enumerate(criteria)]
    tasks = tasks or -(-flat.count() // ANSWERS_PER_TASK) or 1
    grouped = rows.repartition(tasks, key).groupBy(key).agg(*picks)
    scored = []
    for i, c in enumerate(criteria):
        pick = F.col(f"_c{i}")
        missing = pick.isNull()
        score = F.greatest(F.lit(0.0), F.least(F.lit(MAX_SCORE), F.bround(pick["score"], 1)))
        scored.append(
            F.struct(
                F.lit(c.name).alias("name"),
                F.when(missing, 0.0).otherwise(score).alias("score"),
                F.when(missing, MISSING_DIMENSION).otherwise(pick["rationale"]).alias("rationale"),
                (F.when(missing, none).otherwise(pick["evidence"]) if cited else none).alias("evidence"),
            )
        )
    return grouped.select(key, F.array(*scored).alias("dimensions"))


def weighted_total(dimensions: Column, criteria: Sequence[Criterion]) -> Column:
    """Weighted scores scaled to 25, one digit. Weights are those of a normalised rubric."""
    weights = F.array(*[F.lit(float(c.weight)) for c in criteria])
    parts = F.zip_with(dimensions, weights, lambda d, w: d["score"] * w)
    return F.bround(5 * F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 1)


def score_payloads(
    flat: DataFrame, criteria: Sequence[Criterion] = DEFAULT_CRITERIA, key: str = "review_id", tasks: int | None = None
) -> DataFrame:
    """Scored dimensions, total out of 25 and verdict per answer."""
    out = score_dimensions(flat, criteria, key, tasks)
    return out.withColumn("total_score", weighted_total(F.col("dimensions"), criteria)).withColumn(
        "verdict", verdict(F.col("total_score"))
    )


def with_evidence(scored: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Number of sources per answer, the low-evidence flag and its note."""
    counts = sources.groupBy(key).agg(F.count(F.lit(1)).alias("source_count"))
    out = scored.join(counts, key, "left").fillna({"source_count": 0})
    low = F.col("source_count") == 0
    return out.withColumns(
        {"low_evidence": low, "evidence_note": F.when(low, LOW_EVIDENCE_NOTE).otherwise("")}
    )


def with_default_advice(df: DataFrame) -> DataFrame:
    """Fill empty risk and recommendation lists with the standing advice."""
    def filled(c: str, text: str) -> Column:
        return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, F.array(F.lit(text))).otherwise(F.col(c))

    return df.withColumns(
        {"risks": filled("risks", DEFAULT_RISK), "recommendations": filled("recommendations", DEFAULT_RECOMMENDATION)}
    )


def rescore(stored: DataFrame, criteria: Sequence[Criterion] = DEFAULT_CRITERIA) -> DataFrame:
    """Complete stored scores: a given total stays, a blank verdict follows from the total."""
    total = F.coalesce("total_score", weighted_total(F.col("dimensions"), criteria))
    given = strip(F.coalesce("verdict", F.lit("")))
    out = stored.withColumn("total_score", total)
    return out.withColumn("verdict", F.when(given != "", given).otherwise(verdict(F.col("total_score"))))


def dimension_rows(scored: DataFrame, criteria: Sequence[Criterion] = DEFAULT_CRITERIA, key: str = "review_id") -> DataFrame:
    """Readable table: one row per answer and dimension."""
    weight = F.when(F.lit(False), "")
    for c in criteria:
        weight = weight.when(F.col("d.name") == c.name, F.lit(f"{c.weight:.0%}"))
    return scored.select(key, F.explode("dimensions").alias("d")).select(
        key,
        F.col("d.name").alias("dimension"),
        F.concat(F.col("d.score").cast("string"), F.lit(" / 5")).alias("score"),
        weight.otherwise("0%").alias("weight"),
        F.col("d.rationale").alias("rationale"),
        F.array_join("d.evidence", " | ").alias("evidence"),
    )


# --- research ----------------------------------------------------------------------------------

def compact_idea(col: Column, chars: int | None = None) -> Column:
    """Cleaned text of an idea; ``chars`` keeps its opening only."""
    return clean_text(col) if chars is None else F.substring(clean_text(col), 1, chars)


def search_queries(df: DataFrame, text: str, key: str, chars: int | None = None) -> DataFrame:
    """Six search queries per idea; a search engine that bounds its queries sets ``chars``."""
    short = compact_idea(F.col(text), chars)
    queries = F.array(*[F.format_string(t, short) for t in QUERY_TEMPLATES])
    return df.select(key, F.posexplode(queries).alias("position", "query"))


def dedupe_sources(
    hits: DataFrame, key: str = "idea_id", order: str = "position", chars: int | None = None
) -> DataFrame:
    """Web sources of an idea: http(s) only and the first hit per url.

    ``order`` numbers the hits of an idea. Excerpts are whole contents unless ``chars`` bounds them.
    """
    url = strip(F.coalesce("url", F.lit("")))
    usable = hits.withColumn("url", url).filter(F.lower("url").rlike("^https?://"))
    first = usable.groupBy(key, "url").agg(F.min(order).alias(order)).select(key, order)
    title = F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.col("title")).otherwise(F.col("url"))
    content = F.coalesce("content", F.lit(""))
    return usable.join(first, [key, order], "left_semi").select(
        key, order, "url", title.alias("title"),
        (content if chars is None else F.substring(content, 1, chars)).alias("snippet"),
    )


def source_block(df: DataFrame) -> Column:
    return F.concat(
        F.lit("- "), "title", F.lit("\n  URL: "), "url", F.lit("\n  Excerpt: "), "snippet"
    )


def context_prefix(sources: DataFrame, budget: int = CONTEXT_CHARS, key: str = "idea_id", order: str = "position") -> DataFrame:
    """Leading sources of each idea whose blocks fit the character budget together.

    Blocks are never empty, so a row number above the budget can be ruled out up front;
    Spark applies that bound before the shuffle and no group outgrows it.
    """
    mark = len("- \n  URL: \n  Excerpt: ")
    mine = Window.partitionBy(key).orderBy(order)
    few = sources.withColumn("_n", F.row_number().over(mine)).filter(F.col("_n") <= budget // mark)
    running = F.sum("chars").over(mine.rowsBetween(Window.unboundedPreceding, 0))
    blocks = few.withColumn("block", source_block(few)).withColumn("chars", F.length("block").cast("long"))
    return blocks.withColumn("used", running).filter(F.col("used") <= budget).drop("_n")


def research_context(sources: DataFrame, budget: int = CONTEXT_CHARS, key: str = "idea_id", order: str = "position") -> DataFrame:
    """(key, context): the fitting blocks as one text, bounded by the budget."""
    kept = context_prefix(sources, budget, key, order)
    listed = F.array_sort(F.collect_list(F.struct(order, "block")))
    return kept.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["block"]), "\n").alias("context"))


def build_prompts(
    ideas: DataFrame, contexts: DataFrame, criteria: Sequence[Criterion] = DEFAULT_CRITERIA,
    key: str = "idea_id", text: str = "text", chars: int | None = None,
) -> DataFrame:
    """(key, system, user): rubric instructions and the idea with its research.

    Ideas are whole unless ``chars`` bounds them.
    """
    lines = "\n".join(
        f"- {c.name} (max 5, weight {c.weight:.0%}): {c.guidance or 'Apply the usual reading of this criterion.'}"
        for c in criteria
    )
    system = (
        "Rate this startup idea against the rubric, using only the research given. Answer with one JSON "
        "object: dimensions (per criterion: score 0-5, rationale, evidence), total_score (0-25), verdict "
        "(Strong from 19, Promising from 13, else Weak), risks, recommendations.\n" + lines
    )
    context = F.coalesce("context", F.lit(""))
    user = F.concat(
        F.lit("Idea: "), compact_idea(F.col(text), chars),
        F.lit("\nResearch, "), F.length(context).cast("string"), F.lit(" characters:\n"),
        F.when(context == "", "no results").otherwise(context),
    )
    return ideas.join(contexts, key, "left").select(key, F.lit(system).alias("system"), user.alias("user"))


# --- checks --------------------------------------------------------------------------------------

CHECKS = (
    "report_parse", "dimensions_complete", "scores_in_range", "weighted_consistent", "sources_valid",
    "dashboard_nonempty", "dashboard_kpis_match", "dashboard_narrative_grounded", "no_errors",
)


def check_reports(reports: DataFrame, kpis: DataFrame, criteria: Sequence[Criterion] = DEFAULT_CRITERIA) -> DataFrame:
    """Nine pass/fail checks per report.

    ``reports`` has dimensions, total_score, urls, summary, insights, kpi_applications,
    kpi_rate and errors; null dimensions mean no score and a null summary no dashboard.
    ``kpis`` is one row with the recomputed total and rate.
    """
    applications, rate = kpis.select("total").scalar(), kpis.select("rate").scalar()
    names = F.array(*[F.lit(c.name) for c in criteria])
    dims, urls = F.col("dimensions"), F.col("urls")
    found = F.transform(dims, lambda d: d["name"])
    scored, shown = dims.isNotNull(), F.col("summary").isNotNull()
    same = (F.size(F.array_except(found, names)) == 0) & (F.size(F.array_except(names, found)) == 0)
    argued = F.forall(
        dims, lambda d: (F.length(d["rationale"]) > 0) & ~F.lower(d["rationale"]).contains(NO_DIMENSION_MARK)
    )
    drift = F.abs(F.col("total_score") - weighted_total(dims, criteria))
    story = F.concat_ws(" ", F.col("summary"), F.array_join("insights", " "))
    tests = {
        "report_parse": scored & shown,
        "dimensions_complete": scored & same & argued,
        "scores_in_range": scored & F.forall(dims, lambda d: d["score"].between(0, MAX_SCORE)),
        "weighted_consistent": scored & (F.size(dims) > 0) & (F.round(drift, 6) <= TOTAL_TOLERANCE),
        "sources_valid": scored & (F.size(urls) > 0) & F.forall(urls, lambda u: F.lower(u).rlike("^https?://")),
        "dashboard_nonempty": shown & (F.length("summary") > 20) & (F.size("insights") > 0),
        "dashboard_kpis_match": shown & (F.col("kpi_applications") == applications) & (F.col("kpi_rate") == rate),
        "dashboard_narrative_grounded": shown & (story.contains(applications.cast("string")) | story.contains(rate.cast("string"))),
        "no_errors": F.size("errors") == 0,
    }
    return reports.withColumns({n: F.coalesce(tests[n], F.lit(False)) for n in CHECKS})


def control_direction(df: DataFrame) -> DataFrame:
    """Did a control case land where it should: weak at most 12, strong at least 19?"""
    total = F.col("total_score")
    good = (
        F.when(F.col("expected") == "weak", total <= WEAK_TOTAL)
        .when(F.col("expected") == "strong", total >= STRONG_TOTAL)
        .otherwise(F.col("report_parse"))
    )
    return df.withColumn("direction_expected", F.coalesce(good, F.lit(False)))


def pass_rates(checked: DataFrame, checks: Sequence[str] = CHECKS) -> DataFrame:
    """(check, passed, total, rate as 'k/n') from one aggregation."""
    totals = checked.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in checks])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in checks])
    return totals.select("_n", F.explode(rows).alias("r")).select(
        "r.check", "r.passed", F.col("_n").alias("total"),
        F.concat_ws("/", F.col("r.passed").cast("string"), F.col("_n").cast("string")).alias("rate"),
    )


def latency_summary(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Mean, median and maximum. The median comes from counts per distinct value, so it
    is exact and never sorts all rows in one task."""
    from .ordering import running_sums

    counts = df.filter(F.col(seconds).isNotNull()).groupBy(F.col(seconds).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, [F.asc("_v")], ["_n"])
    whole = counts.agg(F.sum("_n")).scalar()
    low, high = F.floor((whole - 1) / 2), F.floor(whole / 2)

    def holds(position: Column) -> Column:
        return (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))

    middle = placed.agg(
        ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("m")
    ).scalar()
    return df.agg(
        F.round(F.avg(seconds), 2).alias("mean"),
        F.round(middle, 2).alias("p50"),
        F.coalesce(F.max(seconds), F.lit(0.0)).alias("max"),
    )
