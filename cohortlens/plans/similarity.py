"""Text, document, vector and search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as X
from ..operators import filters, greedy, search, vectors
from ..session import shared_folder, stage
from ..sources import roles as R
from ..streaming.arrivals import check_arrivals, check_batch, checkable
from . import register
from .role_sql import ALL_IDEAS, DOCS, FULL, INDEX, UNITS, clean, norm_name, section, snippet

# The reports' own thresholds find nothing in these vectors; the queries use lower ones.
PAIR_THRESHOLD = 0.35
MERGE_THRESHOLD = 0.40
GROUP_THRESHOLD = 0.35


@register("clean_text", f"SELECT doc_id, sha256({clean('text')}) AS cleaned, length({clean('text')}) AS n FROM documents")
def clean_text(spark, d):
    docs = R.read(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("cleaned"), F.length("t").cast("long").alias("n"))


@register("normalize_name", f"SELECT doc_id, sha256({norm_name('text')}) AS name FROM documents")
def normalize_name(spark, d):
    return R.read(spark, d, "documents").select("doc_id", F.sha2(X.normalize_name(F.col("text")), 256).alias("name"))


@register("normalize_text", f"SELECT doc_id, sha256(lower({clean('text')})) AS normal FROM documents")
def normalize_text(spark, d):
    return R.read(spark, d, "documents").select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("normal"))


@register("has_script", "SELECT doc_id, regexp_matches(text, '[À-ÿ]') AS accented, regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AS arabic FROM documents")
def has_script(spark, d):
    text = F.col("text")
    return R.read(spark, d, "documents").select(
        "doc_id", X.has_script(text, R.ACCENT_SCRIPT).alias("accented"), X.has_script(text).alias("arabic")
    )


@register("snippet", f"SELECT doc_id, {snippet('text')} AS snippet FROM documents")
def snippets(spark, d):
    return R.read(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def _parts(english: str, original: str | None) -> str:
    e = clean(english)
    if original is None:
        return e
    o = clean(original)
    return f"CASE WHEN {e} = '' THEN {o} WHEN {o} <> {e} AND regexp_matches({o}, '[À-ÿ]') THEN {e} || ' Original: ' || {o} ELSE {e} END"


_DOC_PARTS = ", ".join(
    f"{{'label': '{label}', 'text': {_parts(en, orig)}}}" for label, en, orig in D.DOCUMENT_FIELDS
)
DOCUMENT_SQL = f"""WITH {FULL}, p AS (SELECT row_id, [{_DOC_PARTS}] AS parts FROM full_apps),
q AS (SELECT row_id, list_filter(parts, lambda x, i: x.text <> '' AND list_position(list_transform(parts, lambda y: y.text), x.text) = i) AS kept FROM p)
SELECT row_id, CASE WHEN len(kept) = 0 THEN 'Unnamed idea' ELSE array_to_string(list_transform(kept, lambda x: x.label || ': ' || x.text), chr(10)) END AS document FROM q"""


@register("make_document", f"SELECT row_id, sha256(document) AS document, length(document) AS n FROM ({DOCUMENT_SQL})")
def make_document(spark, d):
    built = D.make_document(R.full_applicants(spark, d), original_script=R.ACCENT_SCRIPT)
    return built.select("row_id", F.sha2("document", 256).alias("document"), F.length("document").cast("long").alias("n"))


@register("document_sections", f"""WITH {DOCS} SELECT row_index, {section("text", "Project")} AS project, sha256({section("text", "Problem")}) AS problem,
  sha256({section("text", "Solution")}) AS solution, 3 AS n FROM docs""")
def document_sections(spark, d):
    docs = R.idea_documents(spark, d).select("row_index", D.document_sections(F.col("text")).alias("s"))
    return docs.select(
        "row_index", F.col("s")["Project"].alias("project"), F.sha2(F.col("s")["Problem"], 256).alias("problem"),
        F.sha2(F.col("s")["Solution"], 256).alias("solution"), F.size("s").alias("n"),
    )


_KEY = "substr(sha256(year || '|' || cohort_id || '|' || " + clean("project_name") + " || '||'), 1, 12)"


@register("idea_ids", f"""WITH {DOCS}, k AS (SELECT row_index, {_KEY} AS key FROM docs)
SELECT row_index, CASE WHEN row_index = min(row_index) OVER (PARTITION BY key) THEN key
  ELSE key || '-' || CASE WHEN row_index < 1000 THEN lpad(CAST(row_index AS VARCHAR), 4, '0') ELSE CAST(row_index AS VARCHAR) END END AS idea_id FROM k""")
def idea_ids(spark, d):
    return D.with_idea_ids(R.idea_documents(spark, d).select("row_index", "year", "cohort_id", "project_name")).select("row_index", "idea_id")


_WORDS = "list_filter(string_split({c}, ' '), lambda w: w <> '')"


@register("shared_names", f"""WITH {DOCS}, w AS (SELECT row_index, {_WORDS.format(c=norm_name("project_name"))} AS a, {_WORDS.format(c=norm_name("substr(text, 1, instr(text, chr(10)))"))} AS b FROM docs),
s AS (SELECT row_index, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM w)
SELECT row_index, len(short) > 0 AND len(list_filter(short, lambda x: length(x) >= 3)) > 0 AND list_has_all(long, short) AS shared FROM s""")
def shared_names(spark, d):
    first_line = F.expr("substr(text, 1, instr(text, '\n'))")
    return R.idea_documents(spark, d).select(
        "row_index", X.names_share_identity(F.col("project_name"), first_line).alias("shared")
    )


def _value(c: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce({c}, '')) END"


def _best(a: str, b: str) -> str:
    return f"CASE WHEN {_value(a)} <> '' THEN {_value(a)} ELSE {_value(b)} END"


IDEA_TEXT = f"'Project: ' || {_value('project_name')} || chr(10) || 'Problem: ' || {_best('problem_en', 'problem')} || chr(10) || 'Description: ' || {_best('solution_en', 'solution')}"


@register("idea_text", f"WITH {FULL} SELECT row_id, sha256({IDEA_TEXT}) AS idea_text FROM full_apps")
def idea_text(spark, d):
    full = R.full_applicants(spark, d)
    return full.select("row_id", F.sha2(D.idea_text(full), 256).alias("idea_text"))


@register("idea_pools", f"""WITH {FULL} SELECT row_id, 'en' AS pool FROM full_apps WHERE problem_en IS NOT NULL AND solution_en IS NOT NULL
UNION ALL SELECT row_id, 'ar' FROM full_apps WHERE regexp_matches(problem, '[À-ÿ]') AND solution IS NOT NULL""")
def idea_pools(spark, d):
    return filters.idea_pools(R.full_applicants(spark, d), R.ACCENT_SCRIPT).select("row_id", "pool")


# --- vectors ---------------------------------------------------------------------------------

@register("normalized_vectors", f"WITH {UNITS} SELECT row_index, round(list_inner_product(u, u), 6) AS norm, round(u[1], 6) AS first, round(u[-1], 6) AS last FROM units")
def normalized_vectors(spark, d):
    unit = R.idea_vectors(spark, d).select("row_index", vectors.normalize_vec(F.col("vec")).alias("u"))
    return unit.select(
        "row_index", F.round(vectors.cosine(F.col("u"), F.col("u")), 6).alias("norm"),
        F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"),
    )


_LEVEL = "CASE WHEN {s} >= 0.97 THEN 'Nearly identical' WHEN {s} >= 0.92 THEN 'Very similar' WHEN {s} >= 0.87 THEN 'Similar' WHEN {s} >= 0.80 THEN 'Somewhat similar' ELSE 'Not similar' END"
_QUERY_LEVEL = "CASE WHEN {s} >= 0.65 THEN 'Very similar' WHEN {s} >= 0.58 THEN 'Similar' WHEN {s} >= 0.50 THEN 'Somewhat similar' ELSE 'Not similar' END"


@register("similar_pairs", f"""WITH {INDEX}, e AS (
  SELECT a.row_index AS l, b.row_index AS r, list_inner_product(a.u, b.u) AS s FROM idx a JOIN idx b ON a.row_index < b.row_index),
top AS (SELECT * FROM e WHERE s >= {PAIR_THRESHOLD} ORDER BY s DESC, l, r LIMIT 100)
SELECT l, r, round(round(s, 9), 6) AS sim, {_LEVEL.format(s="s")} AS level, a.project_name AS left_project_name, a.year AS left_year,
  {snippet("a.text")} AS left_snippet, b.project_name AS right_project_name, b.cohort_id AS right_cohort_id, {section("b.text", "Problem")} AS right_problem
FROM top JOIN idx a ON l = a.row_index JOIN idx b ON r = b.row_index""")
def similar_pairs(spark, d):
    pairs = vectors.similar_pairs(R.idea_index(spark, d), PAIR_THRESHOLD, 100)
    return pairs.select(
        "l", "r", F.round("sim", 6).alias("sim"), "level", "left_project_name", "left_year", "left_snippet",
        "right_project_name", "right_cohort_id", "right_problem",
    )


@register("rank_matches", f"""WITH {INDEX}, q AS (SELECT row_index AS query_id, u AS v FROM units WHERE row_index IN (SELECT min(row_index) FROM idx GROUP BY sector)),
m AS (SELECT query_id, row_index, list_inner_product(u, v) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(u, v) DESC, row_index) AS rank FROM idx, q)
SELECT query_id, CAST(rank AS INTEGER) AS rank, row_index, round(round(s, 9), 6) AS sim, {_QUERY_LEVEL.format(s="s")} AS level, project_name, {snippet("text")} AS snippet, sha256({section("text", "Solution")}) AS solution
FROM m JOIN idx USING (row_index) WHERE rank <= 3 AND s >= 0.3""")
def rank_matches(spark, d):
    index = R.idea_index(spark, d)
    firsts = index.groupBy("sector").agg(F.min("row_index").alias("row_index")).select("row_index")
    asked = R.idea_vectors(spark, d).join(firsts, "row_index", "left_semi").withColumnRenamed("row_index", "query_id")
    found = vectors.rank_matches(index, asked, 3, 0.3)
    return found.select(
        "query_id", "rank", "row_index", F.round("sim", 6).alias("sim"), "level", "project_name", "snippet",
        F.sha2("solution", 256).alias("solution"),
    )


@register("dedup_exact", f"""WITH {ALL_IDEAS}, k AS (SELECT *, lower({clean("text")}) AS t, {norm_name("project_name")} AS n, length({clean("text")}) AS len FROM idx),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY t ORDER BY row_index) = 1),
two AS (SELECT * FROM one WHERE n <> '' QUALIFY row_number() OVER (PARTITION BY n ORDER BY len DESC, year DESC, cohort_id DESC, row_index) = 1)
SELECT row_index, project_name FROM two UNION ALL SELECT row_index, project_name FROM one WHERE n = ''""")
def dedup_exact(spark, d):
    return greedy.dedup_exact(R.all_ideas(spark, d)).select("row_index", "project_name")


def greedy_drop(base: str) -> str:
    """Recursive walk over the pairs of ``base``, most similar first."""
    return f"""e AS MATERIALIZED (SELECT l, r, ll, rl, row_number() OVER (ORDER BY s DESC, l, r) AS n FROM (
    SELECT a.row_index AS l, b.row_index AS r, round(list_inner_product(a.u, b.u), 9) AS s, length({clean("a.text")}) AS ll, length({clean("b.text")}) AS rl
    FROM {base} a JOIN {base} b ON a.row_index < b.row_index AND list_inner_product(a.u, b.u) >= {MERGE_THRESHOLD} - 1e-8) WHERE s >= {MERGE_THRESHOLD}),
walk(n, dead) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT e.n, CASE WHEN list_contains(dead, l) OR list_contains(dead, r) THEN dead ELSE list_append(dead, CASE WHEN ll >= rl THEN r ELSE l END) END FROM walk JOIN e ON e.n = walk.n + 1)
SELECT row_index, project_name FROM {base} WHERE NOT list_contains((SELECT arg_max(dead, n) FROM walk), row_index)"""


@register("dedup_near", f"WITH RECURSIVE {ALL_IDEAS}, {greedy_drop('idx')}")
def dedup_near(spark, d):
    return greedy.dedup_near(R.all_ideas(spark, d), MERGE_THRESHOLD).select("row_index", "project_name")


_EXACT = f"""k AS (SELECT *, lower({clean("text")}) AS t, {norm_name("project_name")} AS n, length({clean("text")}) AS len FROM idx),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY t ORDER BY row_index) = 1),
kept AS MATERIALIZED (SELECT row_index, project_name, text, u FROM (SELECT * FROM one WHERE n <> '' QUALIFY row_number() OVER (PARTITION BY n ORDER BY len DESC, year DESC, cohort_id DESC, row_index) = 1)
  UNION ALL SELECT row_index, project_name, text, u FROM one WHERE n = '')"""


@register("dedup_index", f"WITH RECURSIVE {ALL_IDEAS}, {_EXACT}, {greedy_drop('kept')}")
def dedup_index(spark, d):
    return greedy.dedup_index(R.all_ideas(spark, d), MERGE_THRESHOLD).select("row_index", "project_name")


GROUPS = f"""pr AS MATERIALIZED (SELECT a.row_index AS v, b.row_index AS u, round(list_inner_product(a.u, b.u), 9) AS s FROM units a JOIN units b
    ON a.row_index <> b.row_index AND list_inner_product(a.u, b.u) >= {GROUP_THRESHOLD} - 1e-8 SEMI JOIN idx i ON i.row_index = a.row_index SEMI JOIN idx j ON j.row_index = b.row_index),
p AS MATERIALIZED (SELECT v, list(u ORDER BY s DESC, u) AS near, row_number() OVER (ORDER BY count(*) DESC, max(s) DESC, v) AS n FROM pr WHERE s >= {GROUP_THRESHOLD} GROUP BY v),
walk(n, used, fresh) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT n, list_concat(used, fresh), fresh FROM (SELECT p.n, used, CASE WHEN list_contains(used, v) OR len(list_filter(near, lambda x: NOT list_contains(used, x))) = 0 THEN CAST([] AS BIGINT[])
    ELSE list_prepend(v, list_filter(near, lambda x: NOT list_contains(used, x))[1:11]) END AS fresh FROM walk JOIN p ON p.n = walk.n + 1)),
members AS (SELECT cluster_id, unnest(fresh) AS row_index, fresh[1] AS anchor FROM (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS cluster_id, fresh FROM walk WHERE len(fresh) > 0)),
inside AS (SELECT a.cluster_id, a.row_index AS left_row_index, b.row_index AS right_row_index, s AS similarity,
  CASE WHEN s >= 0.92 THEN 'Very similar (likely same idea)' ELSE 'Similar (different idea, same concept)' END AS band
  FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.row_index < b.row_index JOIN pr ON v = a.row_index AND u = b.row_index WHERE s >= {GROUP_THRESHOLD})"""


@register("cluster_members", f"""WITH RECURSIVE {INDEX}, {GROUPS} SELECT cluster_id, m.row_index, anchor = m.row_index AS is_anchor, project_name, year, cohort_id, sector,
  {snippet("text")} AS snippet, {section("text", "Problem")} AS problem, {section("text", "Solution")} AS solution FROM members m JOIN idx ON idx.row_index = m.row_index""")
def cluster_members(spark, d):
    return greedy.clusters(R.idea_index(spark, d), GROUP_THRESHOLD)[0]


@register("cluster_edges", f"WITH RECURSIVE {INDEX}, {GROUPS} SELECT cluster_id, left_row_index, right_row_index, round(similarity, 6) AS similarity, band FROM inside")
def cluster_edges(spark, d):
    edges = greedy.clusters(R.idea_index(spark, d), GROUP_THRESHOLD)[1]
    return edges.withColumn("similarity", F.round("similarity", 6))


@register("closest_partner", f"""WITH RECURSIVE {INDEX}, {GROUPS}, ends AS (SELECT *, left_row_index AS row_index, right_row_index AS partner FROM inside UNION ALL SELECT *, right_row_index, left_row_index FROM inside)
SELECT cluster_id, row_index, partner, round(similarity, 6) AS similarity, string_split(band, ' (')[1] AS band FROM ends
QUALIFY row_number() OVER (PARTITION BY cluster_id, row_index ORDER BY similarity DESC, left_row_index, right_row_index) = 1""")
def closest_partner(spark, d):
    partners = greedy.closest_partner(greedy.clusters(R.idea_index(spark, d), GROUP_THRESHOLD)[1])
    return partners.withColumn("similarity", F.round("similarity", 6))


# --- search ------------------------------------------------------------------------------------

QUERY = "That the  Ou src3 nation"
_HITS = " + ".join(f"CAST(contains(hay, '{t}') AS INTEGER)" for t in search.search_terms(QUERY))
KEYWORD_SQL = f"""WITH {DOCS}, h AS (SELECT *, lower({clean("concat_ws(' ', project_name, sector, text)")}) AS hay FROM docs),
s AS (SELECT *, {_HITS} AS hits FROM h),
top AS (SELECT *, row_number() OVER (ORDER BY hits DESC, {norm_name("project_name")}, row_index) AS rank FROM s WHERE hits > 0)
SELECT row_index, hits, CAST(rank AS INTEGER) AS rank, project_name, year, cohort_id, sector, {snippet("text")} AS snippet, {section("text", "Problem")} AS problem, {section("text", "Solution")} AS solution
FROM top WHERE rank <= 10"""


@register("keyword_search", KEYWORD_SQL)
def keyword_search(spark, d):
    return search.keyword_search(R.idea_documents(spark, d), QUERY)


@register("search", f"""WITH {INDEX}, m AS (SELECT i.*, row_number() OVER (ORDER BY list_inner_product(i.u, q.u) DESC, i.row_index) AS rank, list_inner_product(i.u, q.u) AS s
  FROM idx i, (SELECT u FROM units WHERE row_index = (SELECT max(vec_id) FROM embeddings)) q)
SELECT project_name AS "Project", CAST(year AS VARCHAR) AS "Year", cohort_id AS "Cohort", sector AS "Sector", {section("text", "Problem")} AS "Problem", {section("text", "Solution")} AS "Solution"
FROM m WHERE rank <= 10 AND s >= 0.25""")
def search_fallback(spark, d):
    index = R.all_ideas(spark, d)
    vecs = R.idea_vectors(spark, d)
    last = vecs.agg(F.max("row_index")).scalar()
    asked = vecs.filter(F.col("row_index") == last).withColumnRenamed("row_index", "query_id")
    return search.search_frame(search.search(index, "zzzz-no-such-word", asked, min_score=0.25))


@register("search_keyword", f"""SELECT project_name AS "Project", CAST(year AS VARCHAR) AS "Year", cohort_id AS "Cohort", sector AS "Sector", problem AS "Problem", solution AS "Solution" FROM ({KEYWORD_SQL})""")
def search_keyword(spark, d):
    vecs = R.idea_vectors(spark, d)
    asked = vecs.filter(F.col("row_index") == vecs.agg(F.max("row_index")).scalar()).withColumnRenamed("row_index", "query_id")
    return search.search_frame(search.search(R.all_ideas(spark, d), QUERY, asked))


SPARSE = f"""{DOCS}, t AS (SELECT row_index, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS word FROM docs),
c AS (SELECT row_index, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % {search.SLOTS} AS INTEGER) AS slot, count(*) AS n FROM t GROUP BY 1, 2),
m AS (SELECT slot, count(*) AS m FROM c GROUP BY 1), w AS (SELECT row_index, slot, n * ln(((SELECT count(*) FROM docs) + 1) / (m + 1)) AS w FROM c JOIN m USING (slot)),
v AS (SELECT row_index, slot, w / sqrt(sum(w * w) OVER (PARTITION BY row_index)) AS x FROM w WHERE w > 0)"""


@register("embed_documents", f"WITH {SPARSE} SELECT row_index, slot, round(x, 6) AS x FROM v")
def embed_documents(spark, d):
    return search.embed_sparse(R.idea_documents(spark, d)).withColumn("x", F.round("x", 6))


@register("sparse_matches", f"""WITH {SPARSE}, p AS (
  SELECT q.row_index AS query_id, v.row_index, round(sum(q.x * v.x), 9) AS s FROM v q JOIN v USING (slot) WHERE q.row_index % 20 = 0 AND q.row_index <> v.row_index GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_index) AS place, row_index, round(s, 6) AS similarity FROM p WHERE s > 0 QUALIFY place <= 10""")
def sparse_matches(spark, d):
    """The ten ideas most like each idea of a number divisible by 20, by words."""
    vectors_ = search.sparse_vectors(R.idea_documents(spark, d))
    found = search.sparse_matches(vectors_, vectors_.filter("row_index % 20 = 0"), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@register("pack_batches", """WITH RECURSIVE t AS (SELECT doc_id AS row_index, greatest(1, length(text) // 4) AS tokens FROM documents),
b AS (SELECT row_index, tokens, 0 AS batch, 1 AS c, tokens AS used FROM t WHERE row_index = 0
  UNION ALL SELECT t.row_index, t.tokens, CASE WHEN c = 64 OR used + t.tokens > 20000 THEN batch + 1 ELSE batch END,
    CASE WHEN c = 64 OR used + t.tokens > 20000 THEN 1 ELSE c + 1 END, CASE WHEN c = 64 OR used + t.tokens > 20000 THEN t.tokens ELSE used + t.tokens END
  FROM b JOIN t ON t.row_index = b.row_index + 1)
SELECT row_index, tokens, batch FROM b""")
def pack_batches(spark, d):
    docs = R.read(spark, d, "documents").select(F.col("doc_id").alias("row_index"), "text")
    return search.pack_batches(docs, budget=20_000, block=500)


ARRIVALS_SQL = f"""WITH {UNITS}, d AS (SELECT doc_id AS query_id, trim(string_split(text, chr(10))[1]) AS idea, trim(text) AS description, u AS v FROM documents JOIN units ON row_index = doc_id),
f AS (SELECT min(query_id) AS query_id FROM d WHERE idea <> '' AND length(idea) + length(description) >= 15 GROUP BY idea || chr(10) || description),
m AS (SELECT d.query_id, units.row_index, list_inner_product(u, v) AS s, row_number() OVER (PARTITION BY d.query_id ORDER BY list_inner_product(u, v) DESC, units.row_index) AS rank FROM units, d JOIN f ON f.query_id = d.query_id)
SELECT query_id, row_index, round(round(s, 9), 6) AS sim, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 3 AND s >= 0.3"""


@register("arrivals", ARRIVALS_SQL)
def arrivals(spark, d):
    index = R.idea_vectors(spark, d)
    docs = R.read(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("idea"),
        F.col("text").alias("description"),
    )
    incoming = docs.join(index.withColumnRenamed("row_index", "query_id"), "query_id")
    return check_batch(incoming, index, min_score=0.3).withColumn("sim", F.round("sim", 6))


@register("arrivals_stream", ARRIVALS_SQL)
def arrivals_stream(spark, d):
    """The same check as a stream over the documents' files: state, watermark, a folder a batch.

    Equal texts come with the number and vector of the first of them, so it does not matter
    which of them the stream sees first.
    """
    index = R.idea_vectors(spark, d)
    path, folder = f"{d}/documents.parquet", f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select("doc_id", "text").schema

    def ideas(docs):
        return checkable(docs.select(F.col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("idea"), F.col("text").alias("description")))

    vectors_ = index.withColumnRenamed("row_index", "query_id")
    first = ideas(spark.read.schema(schema).parquet(path)).join(vectors_.select("query_id"), "query_id", "left_semi").groupBy("text_hash").agg(F.min("query_id").alias("query_id"))
    # as a pattern, the path may be one file or a folder of files
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("query_id") % 86_400)
    stream = ideas(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/documents.parque[t]")).drop("query_id").join(stage(first), "text_hash")
    incoming = stream.join(vectors_, "query_id").select("query_id", "idea", "description", "vec", arrived.alias("arrived_at"))
    query = check_arrivals(incoming, index, f"{folder}/out", f"{folder}/state", min_score=0.3)
    query.awaitTermination()
    found = spark.read.schema("query_id long, row_index long, sim double, rank int").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return found.withColumn("sim", F.round("sim", 6))
