"""Ranked retrieval over the whole chunk table, all queries in one job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import keywords as K
from ..functions import text as X
from ..operators import postings as P
from ..operators import ranking as R
from ..operators.numbering import number_by_id
from ..sources import tables as T
from ..sources.shared import shared_dir
from . import oracle as O
from .registry import register


@register("expand_query", f"""
WITH {O.QUERIES}, {O.SYNONYMS}, {O.EXPANDED}
SELECT q_id, string_agg(term, ' ' ORDER BY term) AS terms FROM expanded GROUP BY q_id""")
def expand_query(spark, d):
    return T.queries(spark, d).select("q_id", F.array_join(X.expand_terms(F.col("query")), " ").alias("terms"))


@register("doc_prior", f"""
WITH {O.CHUNKS} SELECT chunk_id, CASE WHEN contains(lower(doc_name), 'template') THEN 1.25 WHEN contains(lower(doc_name), 'solution') THEN 1.1
  WHEN contains(lower(doc_name), 'draft') THEN 0.95 WHEN contains(lower(doc_name), 'wip') THEN 0.9 ELSE 1.0 END::DOUBLE AS prior FROM chunks""")
def doc_prior(spark, d):
    return T.chunks(spark, d).select("chunk_id", R.doc_prior(F.col("doc_name")).alias("prior"))


@register("bm25_index", f"WITH {O.BM25} SELECT chunk_id, term, tf_h::BIGINT AS tf_h, tf_b::BIGINT AS tf_b, dl::BIGINT AS dl FROM post JOIN lens USING (chunk_id)")
def bm25_index(spark, d):
    return R.postings(T.chunks(spark, d)).select(
        "chunk_id", "term", F.col("tf_h").cast("long").alias("tf_h"), F.col("tf_b").cast("long").alias("tf_b"),
        F.col("dl").cast("long").alias("dl"))


@register("bm25_term_stats", f"""
WITH {O.BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, tot""")
def bm25_term_stats(spark, d):
    stats = R.term_statistics(R.postings(T.chunks(spark, d)))
    n = R.chunk_totals(T.chunks(spark, d)).select("n").scalar()
    return stats.select(
        "term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def rounded(df, *cols):
    return df.select(*cols, "chunk_id", "rn", F.round("score", 6).alias("score"))


def indexed(spark, chunks, *kinds):
    """The stored index of a chunk table, with the postings of some kinds."""
    return P.build(chunks, f"{shared_dir(spark)}/postings_{uuid.uuid4().hex}", kinds)


@register("bm25_search", f"WITH {O.BM25} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('scored')})")
def bm25_search(spark, d):
    return rounded(R.bm25_search(T.queries(spark, d), T.chunks(spark, d), 5), "q_id")


@register("indexed_bm25_search", f"WITH {O.BM25} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('scored')})")
def indexed_bm25_search(spark, d):
    """As `bm25_search`, from a stored index."""
    return rounded(P.bm25_search(T.queries(spark, d), indexed(spark, T.chunks(spark, d), "word"), 5), "q_id")


@register("doc_filter", f"""
WITH {O.BM25}, ok AS (SELECT s.* FROM scored s JOIN chunks c USING (chunk_id) WHERE lower(c.doc_name) IN
  (SELECT DISTINCT lower(doc_name) FROM chunks WHERE chunk_id % 60 = 0))
SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('ok')})""")
def doc_filter(spark, d):
    chunks = T.chunks(spark, d)
    allowed = chunks.filter(F.col("chunk_id") % 60 == 0).select(F.upper("doc_name").alias("doc_name"))
    return rounded(R.bm25_search(T.queries(spark, d), chunks, 5, docs=allowed), "q_id")


@register("section_filter", f"""
WITH {O.BM25}, tags AS (SELECT chunk_id, {O.classify(O.TAGGED_HAY)} AS tag FROM chunks),
ok AS (SELECT s.* FROM scored s JOIN tags t USING (chunk_id) WHERE tag = '' OR tag = '' || (q_id % 6 + 1))
SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('ok')})""")
def section_filter(spark, d):
    asked = T.queries(spark, d).withColumn("section_id", (F.col("q_id") % 6 + 1).cast("string"))
    return rounded(R.bm25_search(asked, T.keyed_chunks(spark, d), 5, section=True), "q_id")


@register("doc_search", f"""
WITH {O.BM25}, top AS ({O.ranked('scored', k=20)}), tl AS (SELECT q_id, list_sort(list(term)) AS terms FROM expanded GROUP BY q_id),
hit AS (SELECT t.q_id, t.rn, t.score, c.*, list_filter(list_transform(terms, lambda x: instr(lower(chunk_text), x)), lambda p: p > 0)[1] AS pos
        FROM top t JOIN chunks c USING (chunk_id) JOIN tl USING (q_id)),
win AS (SELECT *, greatest(0, pos - 1 - 157) AS s FROM hit)
SELECT q_id, rn, chunk_id, doc_name, section_heading AS heading_path, round(score, 6) AS score,
  CASE WHEN pos IS NULL THEN left(chunk_text, 450) || CASE WHEN length(chunk_text) > 450 THEN '…' ELSE '' END
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substring(chunk_text, CAST(s + 1 AS BIGINT), 450) ||
    CASE WHEN s + 450 < length(chunk_text) THEN '…' ELSE '' END END AS snippet FROM win""")
def doc_search(spark, d):
    return R.doc_search(T.queries(spark, d), T.chunks(spark, d), k=50)


@register("keywords_tf", f"WITH {O.CHUNKS}, {O.KEYWORDS} SELECT chunk_id, keywords FROM keyed")
def keywords_tf(spark, d):
    return T.keyed_chunks(spark, d).select("chunk_id", F.array_join("keywords", " ").alias("keywords"))


@register("classify_section", f"WITH {O.CHUNKS} SELECT chunk_id, {O.classify(O.TAGGED_HAY)} AS section FROM chunks")
def classify_section(spark, d):
    return T.keyed_chunks(spark, d).select("chunk_id", F.col("brd_section_id").alias("section"))


@register("tfidf_search", f"WITH {O.TFIDF} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('tfidf', k=6)})")
def tfidf_search(spark, d):
    return rounded(R.tfidf_search(T.queries(spark, d), T.keyed_chunks(spark, d), 6), "q_id")


@register("indexed_tfidf_search", f"WITH {O.TFIDF} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('tfidf', k=6)})")
def indexed_tfidf_search(spark, d):
    """As `tfidf_search`, from a stored index."""
    return rounded(P.tfidf_search(T.queries(spark, d), indexed(spark, T.keyed_chunks(spark, d), "piece"), 6), "q_id")


LEXICAL = f"""{O.CHUNKS}, {O.KEYWORDS}, {O.FIELDS}, {O.SECTIONS},
st AS (SELECT s.project_id, s.section_id, s.title || ' ' || coalesce(p.title, '') AS words FROM sections s
  LEFT JOIN sections p ON p.project_id = s.project_id AND contains(s.section_id, '.') AND p.section_id = split_part(s.section_id, '.', 1)),
terms AS (SELECT project_id, section_id, unnest({O.content_terms('words', fixed.LEXICAL_STOP)}) AS term FROM st),
vocab AS (SELECT DISTINCT term FROM terms),
gate AS (SELECT project_id, chunk_id, term FROM (SELECT project_id, chunk_id,
   unnest(list_distinct({O.alnum_tokens("section_heading || ' ' || keywords || ' ' || chunk_text")})) AS term FROM keyed) SEMI JOIN vocab USING (term)),
dfs AS (SELECT project_id, term, count(*) AS df FROM gate GROUP BY ALL),
ns AS (SELECT project_id, count(*) AS n FROM chunks GROUP BY ALL),
counts AS (SELECT g.project_id, g.chunk_id, g.term, len, {O.occurrences('t')} + 2 * {O.occurrences('k')} + 3 * {O.occurrences('h')} AS tf
  FROM gate g JOIN fields f USING (chunk_id)),
lexical AS (SELECT project_id, section_id, chunk_id, sum((1 + ln(tf)) * ln(1 + n / (1.0 + df))) / (1 + any_value(len) / 4000.0) AS score
  FROM counts JOIN terms USING (project_id, term) JOIN dfs USING (project_id, term) JOIN ns USING (project_id) GROUP BY ALL)"""


@register("lexical_section_rank", f"""
WITH {LEXICAL} SELECT project_id, section_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('lexical', 'project_id, section_id', 6)})""")
def lexical_section_rank(spark, d):
    return rounded(R.lexical_section_rank(T.sections(spark, d), T.keyed_chunks(spark, d)), "project_id", "section_id")


TITLE_TERMS = "SELECT section_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda z: length(z) > 3))) AS term FROM sections"


@register("token_overlap_score", f"""
WITH {O.CHUNKS}, {O.KEYWORDS}, {O.FIELDS}, {O.SECTIONS}, terms AS ({TITLE_TERMS})
SELECT section_id, chunk_id, sum(3 * CAST(contains(h, term) AS INT) + 2 * CAST(contains(k, term) AS INT) + CAST(contains(t, term) AS INT))::BIGINT AS overlap,
  sum(CAST(contains(h, term) AS INT))::BIGINT AS head_hits
FROM terms, fields WHERE contains(h, term) OR contains(k, term) OR contains(t, term) GROUP BY ALL""")
def token_overlap_score(spark, d):
    terms = T.sections(spark, d).select("section_id", F.explode(R.title_words(F.col("title"))).alias("term"))
    return R.token_overlap_score(terms, T.keyed_chunks(spark, d), ["section_id"])


@register("overlap_search", f"""
WITH {O.CHUNKS}, {O.QUERIES}, {O.OVERLAP} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('overlap', k=6)})""")
def overlap_search(spark, d):
    return rounded(R.overlap_search(T.queries(spark, d), T.chunks(spark, d), 6), "q_id")


@register("indexed_overlap_search", f"""
WITH {O.CHUNKS}, {O.QUERIES}, {O.OVERLAP} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('overlap', k=6)})""")
def indexed_overlap_search(spark, d):
    """As `overlap_search`, from a stored index."""
    return rounded(P.overlap_search(T.queries(spark, d), indexed(spark, T.chunks(spark, d), "name"), 6), "q_id")


@register("cosine_search", f"""
WITH {O.COSINE} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('(SELECT * FROM cosine WHERE score >= 0.25)', k=8)})""")
def cosine_search(spark, d):
    return rounded(R.cosine_search(T.query_vectors(spark, d), T.embedded_chunks(spark, d), 8), "q_id")


@register("cosine_search_excluding", f"""
WITH {O.COSINE} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('(SELECT * FROM cosine WHERE score >= 0.2 AND chunk_id % 3 > 0)', k=20)})""")
def cosine_search_excluding(spark, d):
    chunks = T.embedded_chunks(spark, d)
    banned = chunks.filter(F.col("chunk_id") % 3 == 0)
    return rounded(R.cosine_search(T.query_vectors(spark, d), chunks, 20, 0.2, banned), "q_id")


@register("scoped_cosine_search", f"""
WITH {O.COSINE}, seen AS (SELECT * FROM cosine WHERE score >= 0.2 AND (q_id % 3 = 0 OR (chunk_id // 20) % 10 IN (q_id % 10, (q_id + 1) % 10))
  AND NOT (q_id % 2 = 0 AND chunk_id IN (q_id, q_id + 1, q_id + 20)))
SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('seen', k=8)})""")
def scoped_cosine_search(spark, d):
    """Two of three queries see two projects only; every other query leaves out chunks of its own list."""
    q = F.col("q_id")
    name = lambda n: F.concat(F.lit("p"), (n % 10).cast("string"))
    asked = T.query_vectors(spark, d).withColumns({
        "scope": F.when(q % 3 > 0, F.array(name(q), name(q + 1))), "exclude": F.when(q % 2 == 0, F.array(q, q + 1, q + 20))})
    return rounded(R.cosine_search(asked, T.embedded_chunks(spark, d), 8, 0.2), "q_id")


@register("section_similarity", f"WITH {O.COSINE} SELECT q_id, chunk_id, round(score, 6) AS score FROM cosine")
def section_similarity(spark, d):
    scores = R.similarities(T.query_vectors(spark, d), T.embedded_chunks(spark, d), None, None)
    return scores.select("q_id", "chunk_id", F.round("score", 6).alias("score"))


@register("missing_embeddings", f"""
WITH {O.CHUNKS} SELECT project_id, count(*) FILTER (v.vec_id IS NULL) AS missing, count(v.vec_id) AS embedded
FROM chunks c LEFT JOIN embeddings v ON v.vec_id = c.chunk_id GROUP BY project_id""")
def missing_embeddings(spark, d):
    none = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return T.embedded_chunks(spark, d).groupBy("project_id").agg(
        F.count_if(none).alias("missing"), F.count_if(~none).alias("embedded"))


HYBRID = f"""{O.CHUNKS}, {O.QUERIES}, {O.OVERLAP}, {O.COSINE},
sem AS ({O.ranked('(SELECT * FROM cosine WHERE score >= 0.2)', k=6)}),
kwd AS ({O.ranked('overlap', k=6)}),
places AS (SELECT q_id, chunk_id, CASE WHEN rn <= 5 THEN 0 ELSE 2 END AS phase, rn FROM sem UNION ALL SELECT q_id, chunk_id, 1, rn FROM kwd),
hybrid AS (SELECT q_id, chunk_id, phase, row_number() OVER (PARTITION BY q_id ORDER BY phase, rn0) AS rn FROM (
  SELECT q_id, chunk_id, min(phase * 100 + rn) // 100 AS phase, min(phase * 100 + rn) AS rn0 FROM places GROUP BY q_id, chunk_id) QUALIFY rn <= 6)"""


@register("hybrid_search", f"WITH {HYBRID} SELECT q_id, chunk_id, phase::BIGINT AS phase, rn FROM hybrid")
def hybrid_search(spark, d):
    semantic = R.cosine_search(T.query_vectors(spark, d), T.embedded_chunks(spark, d), 6, 0.2)
    keyword = R.overlap_search(T.queries(spark, d), T.chunks(spark, d), 6)
    return R.hybrid_search(semantic, keyword, 6).withColumn("phase", F.col("phase").cast("long"))


@register("rank_backend", f"""
WITH {O.TFIDF}, {O.COSINE}, sem AS ({O.ranked('(SELECT * FROM cosine WHERE score >= 0.2 AND q_id % 3 > 0)', k=6)}),
kwd AS ({O.ranked('tfidf', k=6)})
SELECT q_id, chunk_id, rn, 'semantic' AS backend FROM sem UNION ALL
SELECT q_id, chunk_id, rn, 'keyword' FROM kwd WHERE q_id NOT IN (SELECT q_id FROM sem)""")
def rank_backend(spark, d):
    vectors = T.query_vectors(spark, d).filter(F.col("q_id") % 3 > 0)
    semantic = R.cosine_search(vectors, T.embedded_chunks(spark, d), 6, 0.2)
    keyword = R.tfidf_search(T.queries(spark, d), T.keyed_chunks(spark, d), 6)
    return R.rank_backend(semantic, keyword).select("q_id", "chunk_id", "rn", "backend")


@register("relevance_floor", f"""
WITH {O.COSINE}, hits AS ({O.ranked('(SELECT * FROM cosine WHERE score >= 0.2)', k=20)})
SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM hits JOIN (SELECT q_id, max(score) AS best FROM hits GROUP BY q_id) USING (q_id)
WHERE score >= greatest(0.2, 0.55 * best) OR rn <= 3""")
def relevance_floor(spark, d):
    hits = R.cosine_search(T.query_vectors(spark, d), T.embedded_chunks(spark, d), 20, 0.2)
    return rounded(R.relevance_floor(hits), "q_id")


@register("useful_keyword", f"""
WITH {O.CHUNKS}, {O.KEYWORDS} SELECT chunk_id, pos, term FROM kw
WHERE length(term) > 4 AND (contains(term, ' ') OR NOT list_contains({O.sql_list(fixed.TOPIC_NOISE)}, lower(term)))""")
def useful_keyword(spark, d):
    rows = T.keyed_chunks(spark, d).select("chunk_id", F.posexplode("keywords").alias("i", "term"))
    return rows.filter(K.useful_keyword(F.col("term"))).select("chunk_id", (F.col("i") + 1).cast("long").alias("pos"), "term")


# chunk ids that start anew in each project
INGESTED = O.CHUNKS.replace("chunks AS (", "plain AS (", 1) + """,
chunks AS (SELECT project_id || '|' || (row_number() OVER (PARTITION BY project_id ORDER BY chunk_id) - 1) AS chunk_id,
  project_id, doc_name, section_heading, chunk_text, file_id FROM plain)"""
INGESTED_BM25 = O.BM25.replace(O.CHUNKS, INGESTED)
SPLIT = "split_part(chunk_id, '|', 1) AS project_id, CAST(split_part(chunk_id, '|', 2) AS BIGINT) AS chunk_id"
BY_PROJECT = "CAST(split_part(chunk_id, '|', 2) AS BIGINT), split_part(chunk_id, '|', 1)"


def ingested(spark, d):
    """`chunks` with ids from 0 in each project, as ingest gives them."""
    rows = number_by_id(T.chunks(spark, d), ["project_id"], "chunk_id", "seq")
    return rows.withColumn("chunk_id", F.col("seq") - 1).drop("seq")


@register("ingest_then_search", f"""
WITH {INGESTED_BM25} SELECT q_id, {SPLIT}, rn, round(score, 6) AS score FROM ({O.ranked('scored', tie=BY_PROJECT)})""")
def ingest_then_search(spark, d):
    """Chunks of many projects with clashing ids, indexed and searched by (project_id, chunk_id)."""
    return rounded(P.bm25_search(T.queries(spark, d), indexed(spark, ingested(spark, d), "word"), 5), "q_id", "project_id")


@register("scoped_search", f"""
WITH {INGESTED_BM25}, seen AS (SELECT s.* FROM scored s JOIN chunks c USING (chunk_id)
  WHERE (q_id % 4 = 0 OR (q_id % 4 = 1 AND project_id IN ('p' || (q_id % 10), 'p' || ((q_id + 3) % 10)))
    OR (q_id % 4 = 2 AND CAST(substring(file_id, 2) AS INT) % 8 = q_id % 8) OR (q_id % 4 = 3 AND project_id = 'p' || (q_id % 10) AND CAST(substring(file_id, 2) AS INT) % 20 = q_id % 20))
    AND NOT (split_part(chunk_id, '|', 2)::BIGINT % 5 = q_id % 5))
SELECT q_id, {SPLIT}, rn, round(score, 6) AS score FROM ({O.ranked('seen', tie=BY_PROJECT)})""")
def scoped_search(spark, d):
    """Each query sees what its own scope allows: anything, two projects, some files, or files of one project;
    chunks it has used already are left out."""
    q, chunks = F.col("q_id"), ingested(spark, d)
    asked = T.queries(spark, d)
    file_no = F.substring("file_id", 2, 9).cast("int")
    files = chunks.select("project_id", F.upper("doc_name").alias("doc"), file_no.alias("n")).distinct()
    name = lambda n: F.concat(F.lit("p"), (n % 10).cast("string"))
    nothing = F.lit(None).cast("string")
    projects = asked.filter(q % 4 == 1).select("q_id", F.explode(F.array(name(q), name(q + 3))).alias("project_id"), nothing.alias("doc"))
    some = asked.filter(q % 4 == 2).join(files, F.col("n") % 8 == q % 8).select("q_id", nothing.alias("project_id"), "doc")
    both = asked.filter(q % 4 == 3).join(files, (F.col("n") % 20 == q % 20) & (F.col("project_id") == name(q)), "left").select(
        "q_id", F.coalesce("project_id", name(q)).alias("project_id"), F.coalesce("doc", F.lit("-")).alias("doc"))
    used = asked.join(chunks.select("project_id", "chunk_id"), F.col("chunk_id") % 5 == q % 5).select("q_id", "project_id", "chunk_id")
    found = P.bm25_search(asked, indexed(spark, chunks, "word"), 5, projects.unionByName(some).unionByName(both), used)
    return rounded(found, "q_id", "project_id")


CHANGED = O.CHUNKS.replace("chunks AS (", "plain AS (", 1) + """,
chunks AS (SELECT * REPLACE (CASE WHEN CAST(substring(file_id, 2) AS INT) % 6 = 1 THEN 'changed demand ' || chunk_text ELSE chunk_text END AS chunk_text)
  FROM plain WHERE CAST(substring(file_id, 2) AS INT) % 6 <> 2)"""


@register("index_update", f"""
WITH {O.BM25.replace(O.CHUNKS, CHANGED)} SELECT q_id, chunk_id, rn, round(score, 6) AS score FROM ({O.ranked('scored')})""")
def index_update(spark, d):
    """Build, replace some files and remove others, then search: only the groups of those files are written again."""
    chunks = T.chunks(spark, d)
    index = indexed(spark, chunks, "word")
    file_no = F.substring("file_id", 2, 9).cast("int")
    touched = chunks.filter((file_no % 6 == 1) | (file_no % 6 == 2))
    changed = touched.filter(file_no % 6 == 1).withColumn("chunk_text", F.concat(F.lit("changed demand "), "chunk_text"))
    P.update(index, touched.select("project_id", "file_id"), changed)
    return rounded(P.bm25_search(T.queries(spark, d), index, 5), "q_id")
