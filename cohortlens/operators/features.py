"""Model features from the wide applicant table.

Each ``feat_*`` adds its columns to the frame it is given; ``engineer_features`` adds
them all. Everything is a native expression. Two features look at other rows (keyword
frequencies, first submission of a round); both can be fitted on one table and applied
to another, and are taken from the scored batch itself when nothing is passed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import ACCEPTED

# Word lists, label lists and limits that features are defined by.
TECH_TERMS = (
    "tech", "ai", "artificial intelligence", "software", "app", "application", "platform",
    "digital", "online", "e-commerce", "ecommerce", "automation", "data", "cloud", "smart",
    "iot", "mobile", "fintech", "robotics", "cyber", "web", "saas", "machine learning",
    "blockchain", "system", "database", "website", "technology",
)
COMMON_SECTORS = (
    "Entertainment & Events", "Fashion, Textiles & Beauty", "Food & Beverage",
    "Media, Design & Creative", "Retail & Consumer Goods", "Services & Consulting",
    "Social & Community", "Sports & Fitness", "Tourism & Hospitality",
    "Transportation & Automotive",
)
TECH_SECTOR = "Technology & IT"
THEMES = {
    "food": ("food", "restaurant", "cafe", "coffee", "bakery", "meal", "cuisine", "catering", "recipe", "kitchen", "snack", "grocery", "beverage", "juice", "dessert", "healthy food"),
    "beauty": ("beauty", "hair", "salon", "makeup", "nail", "skincare", "cosmetic", "fashion", "clothing", "jewelry", "dress", "perfume", "apparel", "eyewear", "modest"),
    "tech": ("app", "platform", "software", "website", "online", "digital", "ai", "artificial intelligence", "data", "cloud", "automation", "mobile", "iot", "blockchain", "fintech", "cyber", "saas", "system", "technology", "smart", "application"),
    "health": ("health", "medical", "clinic", "doctor", "fitness", "wellness", "pharma", "therapy", "hospital", "nutrition", "care", "mental"),
    "education": ("education", "training", "course", "learning", "school", "teach", "academy", "workshop", "student", "elearning", "tutor", "curriculum", "skills"),
    "marketing": ("marketing", "social media", "advertising", "brand", "promotion", "content", "influencer", "media", "design", "photography", "seo", "campaign"),
    "events": ("event", "entertainment", "booking", "ticket", "festival", "concert", "tourism", "travel", "hotel", "experience", "leisure"),
    "transport": ("transport", "logistics", "delivery", "car", "vehicle", "shipping", "ride", "driver", "fleet", "auto", "mobility", "gps", "tracking"),
    "finance": ("finance", "funding", "investment", "bank", "insurance", "payment", "loan", "capital", "revenue", "profit", "money", "fintech", "financial"),
    "home": ("home", "real estate", "property", "interior", "furniture", "construction", "renovation", "rent", "housing", "clinic"),
    "environment": ("environment", "sustainability", "renewable", "solar", "recycling", "green", "energy", "waste", "agriculture", "farm", "water", "climate"),
    "services": ("service", "consulting", "maintenance", "cleaning", "repair", "support", "agency", "professional", "concierge", "managed"),
}
SIGNALS = {
    "text_local": ("bahrain", "local", "community", "kingdom", "citizens", "national"),
    "text_jobs": ("job", "employ", "hire", "workforce", "career", "recruit", "opportunities"),
    "text_finance": ("funding", "investment", "revenue", "profit", "capital", "loan", "sales", "income"),
    "text_scale": ("global", "expand", "scale", "export", "region", "gulf", "middle east", "international"),
}
SEGMENTS = (
    "Businesses & Companies", "Government & Public Sector", "General Public", "Women",
    "Parents & Families", "Youth & Teens", "Students", "Travelers & Expats",
    "Health & Medical", "Professionals & Employees", "Children & Kids", "Athletes & Fitness",
    "Car Owners & Drivers", "Property Owners & Real Estate", "Food & Beverage Customers",
    "Education Institutions", "Tech & Online Users", "Investors & Funders",
)
CHANNELS = (
    "Instagram", "Email", "Friends & Family", "Tamkeen (Direct)", "University / Education",
    "Other Online / Social Media", "Word of Mouth / Referral", "Programs & Organizations",
    "LinkedIn", "Media & Advertising", "TikTok", "Government / Ministries",
)
TEXTS = (
    "problem", "solution", "differentiation", "sales_approach", "impact", "inspiration",
    "why_join", "program_expectations", "team_fit",
)
STAGE_MATURITY = {"Idea": 0, "MVP": 1, "Revenue Generating": 2, "Operating": 3}
HOME_NATION = "Bahrain"
UNCATEGORIZED = "uncategorized"
KEYWORD_FLAGS = 30
NOVEL_FREQUENCY = 3
CURRENCY = r"\b(bhd|dinar|dinars|bd|usd|\$)\b"


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def feat_identity(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "identity": F.concat_ws("|", text_of("project_name"), text_of("date_of_birth")),
            "y": flag(F.col("outcome_clean") == ACCEPTED),
            "app_year": F.col("year").try_cast("double").try_cast("int"),
        }
    )


def feat_demographic(df: DataFrame) -> DataFrame:
    size = F.when(F.col("team_member_count") == "5+", "6").otherwise(F.col("team_member_count"))
    unknown = {
        "gender_f": "gender", "employment_f": "employment_status", "education_f": "education",
        "how_heard_f": "how_heard", "prior_program_f": "prior_program_experience",
        "prev_participant_f": "previous_participant", "cohort_f": "cohort",
    }
    out = df.withColumns(
        {
            "age": F.col("app_year") - F.year(F.col("date_of_birth").try_cast("date")),
            "team_member_count_num": size.try_cast("double"),
            "is_team": flag(F.col("individual_or_team") == "Team"),
            "nationality_bin": F.when(F.col("nationality") == HOME_NATION, HOME_NATION).otherwise("Other"),
            **{name: F.coalesce(F.col(c), F.lit("Unknown")) for name, c in unknown.items()},
        }
    )
    return out.withColumns(
        {
            "age_missing_flag": flag(F.col("age").isNull()),
            "team_missing_flag": flag(F.col("team_member_count_num").isNull()),
        }
    )


def feat_registration(df: DataFrame) -> DataFrame:
    cr = flag(F.col("has_commercial_registration") == "Yes")
    earlier = F.col("previous_participant_year").try_cast("double")
    gap = F.col("app_year") - earlier
    return df.withColumns(
        {
            "cr": cr,
            "cr_and_team": cr * F.col("is_team"),
            "in_two_cohorts": F.col("in_two_cohorts").cast("int"),
            "prev_year_recency": F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap)),
            "prev_year_missing_flag": flag(earlier.isNull()),
        }
    )


def feat_stage(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "stage_f": F.coalesce(F.col("`Business Stage`"), F.lit("Not Specified")),
            "sector_f": F.coalesce(F.col("Sector"), F.lit("Not Specified")),
            "age_group_f": F.coalesce(F.col("`Age Group`"), F.lit("Not Specified")),
            "sector_missing_flag": flag(F.col("sector_raw").isNull()),
            "stage_missing_flag": flag(F.col("stage_raw").isNull()),
        }
    )
    maturity = F.lit(-1)
    for stage, value in STAGE_MATURITY.items():
        maturity = F.when(F.col("stage_f") == stage, value).otherwise(maturity)
    return out.withColumn("stage_maturity", maturity).withColumn(
        "cr_established", flag((F.col("cr") == 1) & (F.col("stage_maturity") >= 1))
    )


def feat_sector_lists(df: DataFrame) -> DataFrame:
    lists = {
        "sector": "sector_all", "subsector": "subsector_all", "how_heard": "how_heard_all",
        "target": "target_customers_all", "prior_program": "prior_program_experience_all",
    }
    out = df.withColumn("_sectors", X.split_list(F.col("sector_all")))
    common = F.array(*[F.lit(s) for s in COMMON_SECTORS])
    parts = F.col("_sectors")
    counts = {
        f"{name}_count": F.size(parts if name == "sector" else X.split_list(F.col(c)))
        for name, c in lists.items()
    }
    in_common = flag(F.arrays_overlap(parts, common))
    return out.withColumns(
        {
            **counts,
            "sector_all_tech": flag(F.exists(parts, lambda p: p.contains(TECH_SECTOR))),
            "sector_all_common": in_common,
            "is_common_sector": flag(F.col("sector_f").isin(*COMMON_SECTORS) | (in_common == 1)),
            "sector_tech_named": flag(F.col("sector_f") == TECH_SECTOR),
            **{f"sector_flag_{slug(s)}": flag(F.array_contains(parts, s)) for s in COMMON_SECTORS},
        }
    ).drop("_sectors")


def _contained(df: DataFrame, columns: Sequence[str], prefix: str, labels: Sequence[str]) -> DataFrame:
    out = df.withColumn("_joined", F.concat_ws(";", *[text_of(c) for c in columns]))
    flags = {f"{prefix}_{slug(x)}": flag(F.col("_joined").contains(x)) for x in labels}
    return out.withColumns(flags).drop("_joined")


def feat_targets(df: DataFrame) -> DataFrame:
    """The 'has customers' flag is always 1, as in the definition it follows."""
    columns = ("target_customers_all", "target_customers_normalized")
    return _contained(df, columns, "target_flag", SEGMENTS).withColumn("has_target_customers", F.lit(1))


def feat_channels(df: DataFrame) -> DataFrame:
    return _contained(df, ("how_heard_all", "how_heard"), "channel_flag", CHANNELS)


def round_start(df: DataFrame) -> DataFrame:
    """First submission per cohort id."""
    when = F.col("submitted_at").try_cast("timestamp_ntz")
    return df.groupBy("cohort_id").agg(F.min(when).alias("round_start"))


def submission_timing(df: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    starts = round_start(df) if starts is None else starts
    when = F.col("submitted_at").try_cast("timestamp_ntz")
    out = df.join(starts, "cohort_id", "left")
    return out.withColumns(
        {
            "submission_dayofyear": F.dayofyear(when),
            "submission_weekday": F.weekday(when),
            "submission_hour": F.hour(when),
            "submission_missing_flag": flag(when.isNull()),
            "days_since_round_start": F.timestamp_diff("DAY", F.col("round_start"), when),
        }
    ).drop("round_start")


def feat_business_age(df: DataFrame) -> DataFrame:
    text = F.concat(
        text_of("project_name"), F.lit(" | "), text_of("keywords"), F.lit(" | "),
        text_of("problem_en"), text_of("solution_en"), text_of("impact_en"),
    )
    out = df.withColumn("business_age_regex", X.business_age(text, F.col("app_year")))
    return out.withColumn("business_age_missing_flag", flag(F.col("business_age_regex").isNull()))


def text_stats(df: DataFrame) -> DataFrame:
    """Presence, words and unique-word share of the nine texts; a missing text scores 1.0."""
    out = df.withColumns({f"_m_{t}": X.measured_words(F.col(f"{t}_en")) for t in TEXTS})
    columns = {}
    for t in TEXTS:
        columns[f"{t}_en_has"] = flag(F.col(f"{t}_en").isNotNull())
        columns[f"{t}_en_words"] = X.word_count(F.col(f"{t}_en"))
        columns[f"{t}_en_unique"] = X.unique_ratio(F.col(f"_m_{t}"))
        columns[f"{t}_raw_words"] = X.word_count(F.col(t))
    out = out.withColumns(columns).drop(*[f"_m_{t}" for t in TEXTS])

    def total(suffix: str) -> Column:
        return sum((F.col(f"{t}{suffix}") for t in TEXTS), F.lit(0))

    return out.withColumns(
        {
            "text_word_total": total("_en_words"),
            "text_raw_total": total("_raw_words"),
            "n_text_fields_present": total("_en_has"),
        }
    )


def token_jaccard(df: DataFrame) -> DataFrame:
    pairs = {
        "problem_solution_jaccard": ("problem_en", "solution_en"),
        "impact_inspiration_jaccard": ("impact_en", "inspiration_en"),
    }
    used = sorted({c for pair in pairs.values() for c in pair})
    out = df.withColumns({f"_j_{c}": F.array_distinct(X.measured_words(F.col(c))) for c in used})
    return out.withColumns(
        {name: X.jaccard(F.col(f"_j_{a}"), F.col(f"_j_{b}")) for name, (a, b) in pairs.items()}
    ).drop(*[f"_j_{c}" for c in used])


def feat_text_marks(df: DataFrame, question: str = "?") -> DataFrame:
    return df.withColumns(
        {
            "solution_has_numbers": flag(text_of("solution_en").rlike(r"\d")),
            "solution_has_currency": flag(F.lower(text_of("solution_en")).rlike(CURRENCY)),
            "problem_has_question": flag(text_of("problem_en").contains(question)),
        }
    )


def keyword_frequency(df: DataFrame) -> DataFrame:
    """Rows per lower-case keyword over the corpus; the placeholder keyword is left out."""
    keyword = F.explode(F.transform(X.split_list(F.col("keywords")), F.lower))
    counts = df.select(keyword.alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("keyword") != UNCATEGORIZED)


def top_keywords(frequency: DataFrame, n: int = KEYWORD_FLAGS) -> list[str]:
    """The ``n`` most frequent keywords; they name feature columns, so the driver needs them."""
    return [r.keyword for r in frequency.orderBy(F.desc("n"), "keyword").limit(n).collect()]


def keyword_columns(keywords: Sequence[str]) -> dict[str, str]:
    """Feature column per keyword; a slug already taken gets the keyword's rank appended."""
    names: dict[str, str] = {}
    for rank, keyword in enumerate(keywords, 1):
        name = "kw_" + slug(keyword)
        names[f"{name}_{rank}" if name in names else name] = keyword
    return names


def feat_keywords(
    df: DataFrame,
    key: str = "row_id",
    frequency: DataFrame | None = None,
    top: Sequence[str] | None = None,
) -> DataFrame:
    """Keyword counts, flags of the top keywords, and how common a row's keywords are."""
    frequency = keyword_frequency(df) if frequency is None else frequency
    top = top_keywords(frequency) if top is None else top
    listed = X.split_list(F.col("keywords"))
    per_row = (
        df.select(key, F.explode(F.transform(listed, F.lower)).alias("keyword"))
        .join(frequency, "keyword", "left")
        .select(key, F.coalesce("n", F.lit(0)).alias("n"))
        .groupBy(key)
        .agg(
            F.avg("n").alias("kw_mean_freq"),
            F.min("n").alias("kw_min_freq"),
            F.avg((F.col("n") <= NOVEL_FREQUENCY).cast("int")).alias("kw_novel_share"),
        )
    )
    lowered = F.lower(text_of("keywords"))
    out = df.join(per_row, key, "left").withColumns(
        {
            "keyword_count": F.size(listed),
            "keywords_uncategorized": flag(lowered.contains(UNCATEGORIZED)),
            **{name: flag(lowered.contains(k)) for name, k in keyword_columns(top).items()},
        }
    )
    return out.fillna({"kw_mean_freq": 0.0, "kw_min_freq": 0, "kw_novel_share": 0.0})


def _with_words(df: DataFrame, lists: Sequence[Sequence[str]]) -> DataFrame:
    """Joined text and those of its words that any list asks for.

    One tokenisation and one intersection serve all lists; each list then meets only the
    few words left.
    """
    fields = ("keywords", "problem_en", "solution_en", "project_name", "impact_en")
    joined = df.withColumn("_all", F.concat_ws(" | ", *[text_of(c) for c in fields]))
    asked = F.array(*[F.lit(t) for t in sorted({t for terms in lists for t in terms if t.isalnum()})])
    return joined.withColumn("_words", F.array_intersect(X.words(F.col("_all")), asked))


def theme_flags(df: DataFrame, signals: bool = False) -> DataFrame:
    """Theme flags and their number; ``signals`` adds the signal flags from the same words."""
    themes = {f"theme_{t}": terms for t, terms in THEMES.items()}
    wanted = {**themes, **(SIGNALS if signals else {})}
    out = _with_words(df, list(wanted.values())).withColumns(
        {n: flag(X.has_any(F.col("_words"), F.col("_all"), terms)) for n, terms in wanted.items()}
    )
    total = sum((F.col(n) for n in themes), F.lit(0))
    return out.withColumn("theme_count", total).drop("_all", "_words")


def feat_signals(df: DataFrame) -> DataFrame:
    return _with_words(df, list(SIGNALS.values())).withColumns(
        {n: flag(X.has_any(F.col("_words"), F.col("_all"), terms)) for n, terms in SIGNALS.items()}
    ).drop("_all", "_words")


def feat_tech(df: DataFrame) -> DataFrame:
    """Technology flag and its interactions; problem and solution are read as one text."""
    texts = {
        "_t1": text_of("keywords"),
        "_t2": F.concat(text_of("problem_en"), text_of("solution_en")),
        "_t3": text_of("project_name"),
    }
    out = df.withColumns(texts)
    out = out.withColumns({f"_w{t[2:]}": X.words(F.col(t)) for t in texts})
    coupled = F.col("sector_all_tech") == 1
    for t in texts:
        coupled = coupled | X.has_any(F.col(f"_w{t[2:]}"), F.col(t), TECH_TERMS)
    out = out.withColumn("tech_coupled", flag(coupled)).drop(*texts, "_w1", "_w2", "_w3")
    tech = F.col("tech_coupled")
    return out.withColumns(
        {
            "common_sector_without_tech": flag((F.col("is_common_sector") == 1) & (tech == 0)),
            "impact_tech_proxy": F.col("impact_en_words") * tech,
            "tech_and_team": tech * F.col("is_team"),
            "tech_and_stage": tech * (F.col("stage_maturity") + 1),
        }
    )


def points(*conditions: Column) -> Column:
    return sum((flag(c) for c in conditions), F.lit(0))


def feat_criteria(df: DataFrame) -> DataFrame:
    """Five rubric proxies of 0 to 4 points, their total and two interactions."""
    c = F.col
    out = df.withColumns(
        {
            "crit_problem": points(
                c("problem_en_words") >= 20, c("problem_en_words") >= 60,
                c("problem_has_question") == 1, c("problem_en_unique") >= 0.5,
            ),
            "crit_solution": points(
                c("solution_en_words") >= 20, c("solution_en_words") >= 60,
                c("solution_has_numbers") == 1, c("problem_solution_jaccard") >= 0.35,
            ),
            "crit_innovation": points(
                c("differentiation_en_has") == 1, c("differentiation_en_words") >= 15,
                c("kw_novel_share") >= 0.5, c("keyword_count") >= 4,
            ),
            "crit_market": points(
                c("has_target_customers") == 1, c("target_count") >= 1,
                c("is_common_sector") == 1, c("impact_en_words") >= 15,
            ),
            "crit_feasibility": points(
                c("cr") == 1, c("stage_maturity") >= 1,
                c("team_member_count_num") >= 2, c("business_age_regex").isNotNull(),
            ),
        }
    )
    parts = ("crit_problem", "crit_solution", "crit_innovation", "crit_market", "crit_feasibility")
    return out.withColumns(
        {
            "crit_total": sum((c(p) for p in parts), F.lit(0)),
            "crit_tech_market": c("crit_market") * c("tech_coupled"),
            "crit_solution_feasibility": c("crit_solution") * c("crit_feasibility"),
        }
    )


def feat_name(df: DataFrame) -> DataFrame:
    name = text_of("project_name")
    return df.withColumns(
        {
            "name_len": F.length(name),
            "name_has_digit": flag(name.rlike(r"\d")),
            "name_has_arabic": flag(name.rlike(X.ARABIC_NARROW)),
        }
    )


def engineer_features(
    df: DataFrame,
    key: str = "row_id",
    frequency: DataFrame | None = None,
    top: Sequence[str] | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """All features. Pass a fitted keyword table and round starts to score another batch."""
    out = feat_identity(df)
    for step in (feat_demographic, feat_registration, feat_stage, feat_sector_lists, feat_targets, feat_channels):
        out = step(out)
    out = submission_timing(out, starts)
    for step in (feat_business_age, text_stats, token_jaccard, feat_text_marks):
        out = step(out)
    out = feat_keywords(out, key, frequency, top)
    out = theme_flags(out, signals=True)
    for step in (feat_tech, feat_criteria, feat_name):
        out = step(out)
    return out


# --- registry ---------------------------------------------------------------------------

CATEGORICAL = (
    "year", "cohort_id", "gender_f", "employment_f", "education_f", "how_heard_f",
    "prior_program_f", "prev_participant_f", "cohort_f", "nationality_bin", "stage_f",
    "sector_f", "subsector", "age_group_f",
)
NUMERIC = {
    "base": (
        "age", "team_member_count_num", "app_year", "stage_maturity", "cr", "cr_and_team",
        "in_two_cohorts", "prev_year_recency", "name_len", "age_missing_flag",
        "team_missing_flag", "sector_missing_flag", "stage_missing_flag", "prev_year_missing_flag",
    ),
    "text": tuple(f"{t}_en_{m}" for t in TEXTS for m in ("has", "words", "unique"))
    + tuple(f"{t}_raw_words" for t in TEXTS),
    "tech": (
        "tech_coupled", "common_sector_without_tech", "impact_tech_proxy", "tech_and_team",
        "tech_and_stage", *SIGNALS, *(f"sector_flag_{slug(s)}" for s in COMMON_SECTORS),
    ),
    "criteria": (
        "business_age_regex", "business_age_missing_flag", "sector_count", "subsector_count",
        "how_heard_count", "target_count", "prior_program_count", "has_target_customers",
        "problem_solution_jaccard", "impact_inspiration_jaccard", "solution_has_numbers",
        "solution_has_currency", "problem_has_question", "text_word_total", "text_raw_total",
        "n_text_fields_present",
        *(f"target_flag_{slug(s)}" for s in SEGMENTS),
        *(f"channel_flag_{slug(s)}" for s in CHANNELS),
    ),
    "criteria_proxy": (
        "crit_problem", "crit_solution", "crit_innovation", "crit_market", "crit_feasibility",
        "crit_total", "crit_tech_market", "crit_solution_feasibility",
    ),
    "temporal": (
        "submission_dayofyear", "submission_weekday", "submission_hour",
        "days_since_round_start", "submission_missing_flag",
    ),
    "quality": ("name_has_digit", "name_has_arabic"),
}
KEYWORD_NUMERIC = (
    "keyword_count", "kw_mean_freq", "kw_min_freq", "kw_novel_share", "keywords_uncategorized",
    *(f"theme_{t}" for t in THEMES), "theme_count",
)
FEATURE_SETS = {
    "base": ("base",),
    "base_text": ("base", "text"),
    "base_keywords": ("base", "text", "keywords"),
    "base_criteria": ("base", "text", "criteria", "criteria_proxy"),
    "full": ("base", "text", "keywords", "tech", "criteria", "criteria_proxy", "temporal", "quality"),
}


def feature_set(name: str, top: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of a named set; ``top`` are the flagged keywords."""
    groups = {**NUMERIC, "keywords": (*keyword_columns(top), *KEYWORD_NUMERIC)}
    return [c for g in FEATURE_SETS[name] for c in groups[g]], list(CATEGORICAL)
