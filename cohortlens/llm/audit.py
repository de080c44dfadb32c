"""Filter interaction audit: what each of five filters removes, in every order of them.

Four filters look at a text alone. The fifth, repeated text, is an existential self-join:
a left-semi join on text hash, exact text and a smaller id. Its rows are united with the
failures of the other filters, and the documents are counted by part and combination of
failure bits. All orders, steps and Shapley shares follow from these at most 32 counts a
part, so the corpus is read once for them and not once an order.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .registry import register
from .tables import table

FILTERS = "ABCDE"
MIN_WORDS = 200  # A: fewer words
MIN_DISTINCT = 50  # B: a smaller percentage of different words
MAX_CAPITALS = 3  # C: a larger percentage of capitals
SIGNS = "[#$%&*|]"  # D: any of these
REPEATED = 16  # E: bit of a text that a smaller id has too
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    total = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (
        total < MIN_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < total.cast("long") * MIN_DISTINCT,
        capitals * 100 > F.length(text).cast("long") * MAX_CAPITALS,
        text.rlike(SIGNS),
    )
    return sum((F.shiftleft(f.cast("int"), k) for k, f in enumerate(fails)), F.lit(0))


def repeated(rows: DataFrame) -> DataFrame:
    """Rows of (id, text, ...) whose text a row with a smaller id has too.

    Of each text that stands more than once only the least id is on the right side of the
    semi join: some smaller id exists exactly if the least one is smaller. So a group of
    copies, however large, meets one row, and skewed copies can be split on the left.
    """
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    many = keyed.groupBy("hash", "text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(many.select(F.col("hash").alias("same_hash"), F.col("text").alias("same_text"), "first"))
    same = (F.col("hash") == F.col("same_hash")) & (F.col("text") == F.col("same_text")) & (F.col("first") < F.col("id"))
    return keyed.join(first, same, "left_semi")


def failing(docs: DataFrame) -> DataFrame:
    """(id, part, bits, n): the filters that each document fails, bit k for letter k.

    ``docs`` has doc_id, lang, text. A null text is empty, a null lang the part "". A null
    doc_id is neither smaller nor larger than another, so its row never fails E. Rows that
    repeat an id and its text count together in ``n``; other columns are left out. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.select("id", "part", F.xxhash64("text").alias("hash"), own_failures(F.col("text")).alias("bits"), F.lit(1).alias("one"))
    again = repeated(rows).select("id", "part", "hash", F.lit(REPEATED).alias("bits"), F.lit(0).alias("one"))
    united = own.unionByName(again).groupBy("id", "part", "hash")
    return united.agg(F.bit_or("bits").alias("bits"), F.sum("one").alias("n")).drop("hash")


def combinations(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents per combination of failures, and the labelled among them."""
    own = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    marked = failures.join(own, "id", "left")
    return marked.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def interactions(counts: DataFrame) -> DataFrame:
    """Counts for each part, order of the filters and step, from the result of ``combinations``."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("found"))  # 32 at most
    steps = parts.select("part", "found", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.array(*(F.lit(k + 1) for k in range(len(FILTERS))))).alias("step"))
    position = [F.locate(letter, F.col("filter_order")) for letter in FILTERS]
    bit = sum((F.shiftleft((p == F.col("step")).cast("int"), k) for k, p in enumerate(position)), F.lit(0))
    prior = sum((F.shiftleft((p < F.col("step")).cast("int"), k) for k, p in enumerate(position)), F.lit(0))
    steps = steps.select("*", bit.alias("bit"), prior.alias("prior"))

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("found", where), F.lit(0).cast("long"), lambda acc, c: acc + value(c))

    def fails(c: Column) -> Column:
        return c["bits"].bitwiseAND(F.col("bit")) != 0

    def left(c: Column) -> Column:
        return c["bits"].bitwiseAND(F.col("prior")) == 0

    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: left(c) & ~fails(c)).alias("kept"),
        total(lambda c: left(c) & fails(c)).alias("removed"),
        total(lambda c: ~left(c) & fails(c)).alias("redundant"),
        total(lambda c: c["bits"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: left(c) & fails(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: left(c) & fails(c), lambda c: c["toxic"]).alias("toxic_lost"),
        # of the orders, the share in which this filter comes before the others a document fails
        total(fails, lambda c: (c["n"] * len(ORDERS) / F.bit_count(c["bits"])).cast("long")).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM d),
lab AS (SELECT doc_id, max(quality = 1) AS g, max(toxic = 1) AS t FROM labels GROUP BY 1),
b AS (SELECT part, coalesce(g, false) AS g, coalesce(t, false) AS t,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), again] AS f
  FROM w LEFT JOIN lab USING (doc_id)),
n AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE g) AS good, count(*) FILTER (WHERE t) AS toxic FROM b GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
s AS (SELECT o, l.k AS step, o[l.k] AS own, o[1:l.k - 1] AS prior FROM o, l),
c AS (SELECT n.*, s.*, f[own] AS fails, len(list_filter(prior, lambda x: f[x])) > 0 AS gone FROM n, s),
r AS (SELECT part, o, step, own,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


@register("op13_filter_audit", SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return interactions(combinations(failing(docs), table(spark, sf_dir, "labels")))
