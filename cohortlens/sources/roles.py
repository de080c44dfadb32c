"""Role tables: applicant-shaped views over the benchmark's star schema.

Operators work on role columns (project_name, cohort_id, text, vec ...). These adapters
derive such columns from the given tables with integer-key rules, so the same rules can
be stated in SQL. Every row of the driving table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..session import spread
from .tables import load_applications, load_attendance

# Label cycles of the derived columns.
STAGES = ("Idea", "MVP", "Revenue Generating", "Operating", "Not Specified")
AGES = ("18-24", "25-34", "35-44", "45+", "Not Specified", "under 18")
EDUCATION = ("University / Higher Education", "Secondary School", "Diploma / ", "School / Vocational Training", "Not Specified")
MAJORS = ("Engineering / Computer Science", "Business", "Design / ", "Medicine", "Law", "Arts / Music", "Physics", "Blanks")
EMPLOYMENT = ("Student", "Employed", "Self-employed", "Not Specified")
ACCENTED = "àâäçèéêëîïôöùûüñáíóúß"
PLAIN = "aaaceeeeiioouuunaious"
ACCENT_SCRIPT = "[À-ÿ]"
LIST_SECTORS = ("Food & Beverage", "Technology & IT", "Services & Consulting", "Tourism & Hospitality", "Education")
LIST_TARGETS = ("Women", "Students", "General Public", "Youth & Teens", "Investors & Funders")
LIST_CHANNELS = ("Instagram", "Email", "Friends & Family", "LinkedIn", "TikTok")
TEXT_ROLES = (
    "problem", "solution", "differentiation", "sales_approach", "impact", "inspiration",
    "why_join", "program_expectations", "team_fit",
)


TEXT_HEAVY = ("documents", "orders", "events", "pages")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_HEAVY else df


def cycle(key: Column, labels) -> Column:
    """Label number ``key % (n + 1)``; the slot after the last label is null."""
    slot = key % (len(labels) + 1)
    out = F.when(slot == 0, labels[0])
    for i, label in enumerate(labels[1:], 1):
        out = out.when(slot == i, label)
    return out


def applications_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One application per order, labels as messy as an uploaded sheet."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    # Files of customers are far smaller than the rows in them, so Spark would broadcast millions.
    joined = (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    year = F.year("o_orderdate")
    half = F.when(F.month("o_orderdate") <= 6, "1").otherwise("2")
    size = key % 9
    return joined.select(
        key.alias("row_id"),
        F.concat(F.lit("Project "), key.cast("string")).alias("project_name"),
        F.col("c_name").alias("applicant_name"),
        F.when(customer % 13 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (customer % 12000).cast("int")).cast("string")).alias("date_of_birth"),
        F.when(key % 50 == 7, "n/a").otherwise(F.concat(year.cast("string"), F.lit(".0"))).alias("year"),
        F.concat(year.cast("string"), F.lit("-"), half).alias("cohort_id"),
        F.when(key % 2 == 0, " ARABIC ").when(key % 31 == 5, " Mixed ").otherwise("english cohort").alias("cohort"),
        F.when(key % 17 != 0, F.when(F.col("c_mktsegment") == "FURNITURE", "Not Specified").otherwise(F.col("c_mktsegment"))).alias("Sector"),
        F.when(F.col("o_orderstatus") == "F", "Accepted").when(F.col("o_orderstatus") == "O", "Rejected").otherwise("Not Specified").alias("outcome_clean"),
        F.when(key % 19 == 3, "joint_venture")
        .when(F.col("o_orderpriority") == "1-URGENT", "solo founder")
        .when(F.col("o_orderpriority") == "2-HIGH", "Team")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "group_project")
        .when(F.col("o_orderpriority") == "5-LOW", " ind ").alias("individual_or_team"),
        F.when(size == 0, "-").when(size == 7, "5+").when(size < 7, size.cast("string")).alias("team_member_count"),
        F.when(key % 5 == 1, "Bahrain").when(key % 5 != 0, F.col("n_name")).alias("nationality"),
        cycle(key, STAGES).alias("Business Stage"),
        cycle(key, AGES).alias("Age Group"),
        cycle(key, EDUCATION).alias("education"),
        cycle(key, MAJORS).alias("major"),
        cycle(key, EMPLOYMENT).alias("employment_status"),
        F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "No").alias("has_commercial_registration"),
        F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate")).alias("submitted_at"),
    )


KEPT = ("row_id", "applicant_name", "date_of_birth", "submitted_at")


def applications(spark: SparkSession, folder: str) -> DataFrame:
    return load_applications(applications_raw(spark, folder), keep=KEPT)


def attendance_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One attendance row per order that has line items."""
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").cast("int").alias("sessions_scheduled"),
        F.count(F.lit(1)).cast("int").alias("attendance_member_rows"),
        F.floor(F.sum("l_quantity")).cast("long").alias("_quantity"),
        F.year(F.min("l_shipdate")).alias("year"),
    )
    key = F.col("l_orderkey")
    slots = F.col("sessions_scheduled") * F.col("attendance_member_rows")
    return lines.select(
        key.alias("attendance_id"),
        "sessions_scheduled",
        "attendance_member_rows",
        (F.col("_quantity") % (slots + 1)).cast("int").alias("member_days_present"),
        F.when(key % 4 == 0, 1).otherwise(0).alias("member_days_virtual"),
        F.when(key % 6 != 0, (F.col("_quantity") % 101) / 100).alias("member_attendance_rate"),
        F.when(key % 10 < 5, F.col("year")).otherwise(F.col("year")).alias("year"),
        F.when(key % 2 == 0, "Arabic").otherwise("English").alias("cohort"),
        F.when(key % 7 != 0, F.concat(F.lit("  PROJECT "), key.cast("string"))).alias("matched_project_name"),
        key.cast("string").alias("matched_application_id"),
    )


def attendance(spark: SparkSession, folder: str) -> DataFrame:
    return load_attendance(attendance_raw(spark, folder))


def idea_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One idea per document: the first line is its problem, the rest its solution."""
    text = F.col("text")
    first = F.substring_index(text, "\n", 1)
    rest = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1))
    opening = F.array_join(F.slice(F.split(clean_text(text), " ", 4), 1, 3), " ")
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("row_index"),
        F.when(F.col("doc_id") % 23 != 0, opening).otherwise("").alias("project_name"),
        (2023 + F.col("doc_id") % 3).cast("int").alias("year"),
        F.concat((2023 + F.col("doc_id") % 3).cast("string"), F.lit("-"), (1 + F.col("doc_id") % 2).cast("string")).alias("cohort_id"),
        F.col("source").alias("sector"),
        F.concat(
            F.lit("Project: "), opening,
            F.lit("\nProblem: "), clean_text(first),
            F.lit("\nSolution: "), clean_text(rest),
        ).alias("text"),
    )


def idea_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("embedding").alias("vec"))


def idea_index(spark: SparkSession, folder: str) -> DataFrame:
    """Ideas with a vector."""
    return idea_documents(spark, folder).join(idea_vectors(spark, folder), "row_index")


def all_ideas(spark: SparkSession, folder: str) -> DataFrame:
    """All ideas; those without an embedding have a null vector."""
    return idea_documents(spark, folder).join(idea_vectors(spark, folder), "row_index", "left")


def full_applicants(spark: SparkSession, folder: str) -> DataFrame:
    """Applications with the wide schema; an application's texts come from its document, if any.

    Line i of a document goes to text field i mod 9. French texts get an unaccented
    'English' version, English texts are their own, other languages have none.
    """
    docs = read(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", "source", F.split("text", "\n").alias("_lines")
    )

    def field(slot: int) -> Column:
        mine = F.filter("_lines", lambda line, n: (n % 9 == slot) & (F.length(line) > 0))
        joined = F.array_join(mine, " ")
        return F.when(joined != "", joined)

    raw = [field(i).alias(role) for i, role in enumerate(TEXT_ROLES)]
    opening = F.slice(F.split(F.lower(F.element_at("_lines", 1)), " "), 1, (1 + F.col("row_id") % 5).cast("int"))
    keywords = F.array_join(opening, "; ")
    docs = docs.select(
        "row_id", "lang",
        F.col("source").alias("subsector"),
        F.when(F.col("row_id") % 11 == 0, F.concat(keywords, F.lit(", Uncategorized"))).when(F.col("row_id") % 7 != 0, keywords).alias("keywords"),
        *raw,
    )
    english = [
        F.when(F.col("lang") == "en", F.col(r)).when(F.col("lang") == "fr", F.translate(r, ACCENTED, PLAIN)).alias(f"{r}_en")
        for r in TEXT_ROLES
    ]
    docs = docs.select("*", *english)
    key = F.col("row_id")

    def listed(labels, step: int, separator: str) -> Column:
        picked = F.filter(
            F.array(*[F.lit(x) for x in labels]),
            lambda x, i: (F.floor(key / step) + i) % 3 == 0,
        )
        return F.array_join(picked, separator)

    apps = load_applications(applications_raw(spark, folder), keep=KEPT)
    return apps.join(docs, "row_id", "left").withColumns(
        {
            "gender": cycle(key, ("Female", "Male")),
            "how_heard": cycle(key, ("Instagram", "Word of Mouth / Referral", "Email")),
            "prior_program_experience": cycle(key, ("Yes", "No")),
            "previous_participant": cycle(key, ("No", "Yes", "Unsure")),
            "previous_participant_year": F.when(key % 4 == 0, F.concat((1990 + key % 12).cast("string"), F.lit(".0"))),
            "in_two_cohorts": (key % 8 == 0).cast("int"),
            "stage_raw": F.col("Business Stage"),
            "sector_raw": F.col("Sector"),
            "sector_all": listed(LIST_SECTORS, 1, "; "),
            "subsector_all": listed(LIST_SECTORS, 2, ","),
            "how_heard_all": F.when(key % 9 != 0, listed(LIST_CHANNELS, 1, "; ")),
            "prior_program_experience_all": listed(LIST_CHANNELS, 5, " ; "),
            "target_customers": F.when(key % 3 == 0, "Women"),
            "target_customers_all": F.when(key % 4 != 0, listed(LIST_TARGETS, 1, "; ")),
            "target_customers_normalized": F.when(key % 6 == 0, "Students"),
        }
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled ideas with a model probability and, for two thirds, a review score."""
    docs = read(spark, folder, "documents").select("doc_id", "n_chars", "text", "source")
    joined = read(spark, folder, "labels").join(docs, "doc_id")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.col("source"), F.lit("|"), (F.col("doc_id") % 300).cast("string")).alias("identity"),
        (2023 + F.col("doc_id") % 3).cast("int").alias("year"),
        F.col("quality").alias("label"),
        ((F.col("n_chars") % 1000) / 1000).alias("model_prob"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") * 7 % 26).cast("double")).alias("agent_score"),
    )


# Names of the default scoring dimensions, in order.
DIMENSIONS = (
    "Problem / Need", "Solution / Idea", "Innovation / Differentiation", "Market Potential", "Feasibility",
)


def review_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Flat review answers: five dimension scores per event, names spelled loosely, some of none of the rubric."""
    key = F.col("event_id")
    spelled = F.array(
        *[F.lit(name if i % 2 else name.upper().replace(" / ", "-")) for i, name in enumerate(DIMENSIONS)]
    )
    events = read(spark, folder, "events").select(
        key.alias("review_id"), "ts", "user_id", "event_type", "value",
        F.posexplode(spelled).alias("slot", "dimension"),
    )
    number = (F.col("review_id") * (F.col("slot") + 3)) % 67
    unasked = (F.col("review_id") + F.col("slot")) % 13 == 0
    return events.select(
        "review_id", "slot",
        F.when(unasked, "Something Else").otherwise(F.col("dimension")).alias("dimension"),
        F.when(number % 29 == 0, "n/a").otherwise((number / 10 - 0.5).cast("decimal(6,1)").cast("string")).alias("score"),
        F.when(F.col("review_id") % 10 != 0, F.concat(F.lit("because of "), F.col("event_type"))).alias("rationale"),
    )


def research_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits: one per page, twelve to an idea, numbered within it; some urls repeat.

    Urls are cut before the query string.
    """
    page = F.col("page_id")
    return read(spark, folder, "pages").select(
        F.floor(page / 12).alias("idea_id"),
        (page % 12).alias("position"),
        F.when(page % 9 == 0, F.regexp_replace("url", "^http", "ftp"))
        .when(page % 5 == 1, F.concat(F.lit("https://shared.example.com/"), (page % 2).cast("string")))
        .otherwise(F.substring_index("url", "?", 1)).alias("url"),
        F.when(F.col("page_id") % 5 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.col("html").alias("content"),
    )
