"""Text normalising and token measures as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and limits that results depend on.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"  # any whitespace run but a lone blank
ARABIC_WIDE = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"
ARABIC_NARROW = r"[\u0600-\u06FF]"
MEASURED_WORD = r"[A-Za-z0-9\u0600-\u06FF]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
SNIPPET_LIMIT = 160
MIN_NAME_WORD = 3
TOKEN_CHARS = 4


def strip(col: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.trim(col, F.lit(WHITESPACE))


def clean_text(col: Column) -> Column:
    """Null becomes '', whitespace runs become one blank."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, ODD_SPACE, " "))


def text_value(col: Column) -> Column:
    """Null, 'nan' and 'none' become ''; anything else is stripped."""
    text = strip(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text)


def has_script(col: Column, pattern: str = ARABIC_WIDE) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def normalize_text(col: Column) -> Column:
    return F.lower(clean_text(col))


def normalize_name(col: Column) -> Column:
    """Lower case, every run of non-word characters replaced by one blank."""
    return F.trim(F.regexp_replace(normalize_text(col), NON_WORD, " "))


def snippet(col: Column, limit: int = SNIPPET_LIMIT) -> Column:
    text = clean_text(col)
    short = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def names_share_identity(left: Column, right: Column) -> Column:
    """Every word of the shorter name occurs in the longer one, one word being long enough."""
    a, b = (
        F.filter(F.split(normalize_name(c), " "), lambda w: w != "") for c in (left, right)
    )
    left_is_short = F.size(a) <= F.size(b)
    short = F.when(left_is_short, a).otherwise(b)
    long = F.when(left_is_short, b).otherwise(a)
    return (
        (F.size(a) > 0)
        & (F.size(b) > 0)
        & F.exists(short, lambda w: F.length(w) >= MIN_NAME_WORD)
        & (F.size(F.array_except(short, long)) == 0)
    )


def split_list(col: Column) -> Column:
    """Split a ';' or ',' separated list; null and blank give an empty array."""
    parts = F.split(F.coalesce(col, F.lit("")), "[;,]")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def words(col: Column) -> Column:
    """Distinct word runs of the lower-cased text, for whole-word term tests."""
    return F.array_distinct(F.split(F.lower(F.coalesce(col, F.lit(""))), NON_WORD))


def has_any(word_set: Column, text: Column, terms: Sequence[str]) -> Column:
    """Any term occurs between word boundaries.

    A term made of word characters matches exactly when it equals a word run, so one
    tokenisation serves every term list; only phrases need a pattern, behind a
    cheap substring test.
    """
    single = sorted({t for t in terms if t.isalnum()})
    phrases = sorted({t for t in terms if not t.isalnum()})
    found = F.lit(False)
    if single:
        found = F.arrays_overlap(word_set, F.array(*[F.lit(t) for t in single]))
    lowered = F.lower(F.coalesce(text, F.lit("")))
    for phrase in phrases:
        pattern = rf"(^|[^\p{{L}}\p{{N}}_])\Q{phrase}\E($|[^\p{{L}}\p{{N}}_])"
        found = found | (lowered.contains(phrase) & lowered.rlike(pattern))
    return F.coalesce(found, F.lit(False))


def word_count(col: Column) -> Column:
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"[{SPACE}]+")))


def measured_words(col: Column) -> Column:
    """Latin, digit and Arabic word runs; a missing text counts as the word 'nan'."""
    found = F.regexp_extract_all(F.lower(col), F.lit(f"({MEASURED_WORD})"))
    return F.when(col.isNull(), F.array(F.lit("nan"))).otherwise(found)


def unique_ratio(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(tokens)) / n)


def jaccard(left_tokens: Column, right_tokens: Column) -> Column:
    empty = (F.size(left_tokens) == 0) | (F.size(right_tokens) == 0)
    shared = F.size(F.array_intersect(left_tokens, right_tokens))
    return F.when(empty, F.lit(0.0)).otherwise(
        shared / F.size(F.array_union(left_tokens, right_tokens))
    )


# The two phrasings that reveal how long a business has run.
SINCE_YEAR = (
    r"(?:since|from|in|est\.?|established|founded|started|operating|running|"
    r"launched|registered|opened)\s*(?:in|on|since)?\s*(20\d{2})"
)
FOR_YEARS = (
    r"(?:operating|running|in business|established|founded|started|launched|"
    r"trading|open|selling)\s*(?:for|since|over)?\s*(\d{1,2})\s*(?:years?|yrs?)\b"
)
MAX_BUSINESS_YEARS = 30


def business_age(text: Column, year: Column) -> Column:
    """Years in business: from a start year if one is named, else from a duration."""
    lowered = F.lower(F.coalesce(text, F.lit("nan")))
    start = F.regexp_extract(lowered, SINCE_YEAR, 1)
    years = F.regexp_extract(lowered, FOR_YEARS, 1)
    duration = F.when(years != "", years.try_cast("int"))
    since = year - start.try_cast("int")
    return F.when(start != "", F.when(since.isNotNull(), F.greatest(F.lit(0), since))).otherwise(
        F.when(duration <= MAX_BUSINESS_YEARS, duration)
    )


def estimated_tokens(col: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col) / TOKEN_CHARS).cast("int"))
