"""Context building: expansion, coverage, budgets, citations, blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import context as C
from ..operators import ranking as R
from ..sources import tables as T
from . import oracle as O
from .ranking_queries import LEXICAL, TITLE_TERMS
from .registry import register

OVERLAP_TOP = f"{O.CHUNKS}, {O.QUERIES}, {O.OVERLAP}, anchors AS ({O.ranked('overlap', k=12)})"


def neighbors_sql(name: str, k: int, window: int, cap: int) -> str:
    return f"""{name}_reach AS (
  SELECT a.q_id, n.chunk_id, n.doc_name, max(a.score * CASE WHEN n.chunk_id = c.chunk_id THEN 1.0 ELSE greatest(0.55, 1 - 0.07 * abs(n.chunk_id - c.chunk_id)) END) AS score
  FROM anchors a JOIN chunks c USING (chunk_id) JOIN chunks n ON n.repo_id = c.repo_id AND n.file_id = c.file_id AND abs(n.chunk_id - c.chunk_id) <= {window}
  WHERE a.rn <= {k} GROUP BY ALL),
{name} AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY doc_name, chunk_id) AS ref, chunk_id, doc_name, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM {name}_reach QUALIFY rn <= {cap}))"""


NARROW = neighbors_sql("narrow", 6, 6, 12)
WIDE = neighbors_sql("wide", 12, 8, 18)
COVERAGE = f"""asked AS (SELECT q_id, {O.content_terms('query')} AS terms FROM queries),
seen AS (SELECT q_id, count(DISTINCT chunk_id) AS n_passages, count(DISTINCT term) FILTER (contains(lower(chunk_text), term)) AS n_covered
  FROM (SELECT q_id, chunk_id, chunk_text, unnest(terms) AS term FROM narrow JOIN chunks USING (chunk_id) JOIN asked USING (q_id)) GROUP BY q_id),
coverage AS (SELECT q_id, len(terms) AS n_terms, coalesce(n_passages, 0) AS n_passages, coalesce(n_covered, 0) AS n_covered,
  len(terms) = 0 OR (coalesce(n_passages, 0) >= 2 AND coalesce(n_covered, 0) >= 0.55 * len(terms)) AS ok FROM asked LEFT JOIN seen USING (q_id))"""


def anchors(spark, d, k=12):
    return R.overlap_search(T.queries(spark, d), T.chunks(spark, d), k)


def passages(spark, d):
    return C.neighbor_expand(anchors(spark, d, 6), T.chunks(spark, d))


@register("neighbor_expand", f"WITH {OVERLAP_TOP}, {NARROW} SELECT q_id, ref, chunk_id, doc_name, round(score, 6) AS score FROM narrow")
def neighbor_expand(spark, d):
    return passages(spark, d).withColumn("score", F.round("score", 6))


@register("context_coverage", f"WITH {OVERLAP_TOP}, {NARROW}, {COVERAGE} SELECT q_id, n_terms, n_passages, n_covered, ok FROM coverage")
def context_coverage(spark, d):
    out = C.context_coverage(T.queries(spark, d), passages(spark, d), T.chunks(spark, d))
    return out.select("q_id", *[F.col(c).cast("long").alias(c) for c in ("n_terms", "n_passages", "n_covered")], "ok")


@register("retrieve_widen", f"""
WITH {OVERLAP_TOP}, {NARROW}, {WIDE}, {COVERAGE}, choice AS (
  SELECT q_id, NOT ok AND coalesce(n_wide, 0) >= n_passages AS use_wide FROM coverage LEFT JOIN (SELECT q_id, count(*) AS n_wide FROM wide GROUP BY q_id) USING (q_id))
SELECT q_id, ref, chunk_id, doc_name, round(score, 6) AS score, wide FROM (
  SELECT *, false AS wide FROM narrow UNION ALL SELECT *, true AS wide FROM wide) JOIN choice USING (q_id) WHERE wide = use_wide""")
def retrieve_widen(spark, d):
    out = C.retrieve_widen(T.queries(spark, d), anchors(spark, d), T.chunks(spark, d))
    return out.withColumn("score", F.round("score", 6))


SIBLINGS = """keys AS (SELECT DISTINCT q_id, doc_name, section_heading FROM hits JOIN chunks USING (chunk_id) WHERE trim(section_heading) <> ''),
grown AS (SELECT q_id, chunk_id, bool_or(is_hit) AS is_hit, min(CASE WHEN is_hit THEN place END) AS hit_place FROM (
  SELECT q_id, chunk_id, true AS is_hit, rn::BIGINT AS place FROM hits UNION ALL
  SELECT q_id, c.chunk_id, false, c.chunk_id FROM keys k JOIN chunks c USING (doc_name, section_heading)) GROUP BY q_id, chunk_id),
siblings AS (SELECT q_id, chunk_id, is_hit, CASE WHEN is_hit THEN hit_place ELSE chunk_id END AS place FROM grown)"""


@register("sibling_expand", f"WITH {OVERLAP_TOP}, hits AS (SELECT * FROM anchors), {SIBLINGS} SELECT * FROM siblings")
def sibling_expand(spark, d):
    return C.sibling_expand(anchors(spark, d), T.chunks(spark, d))


@register("sibling_expand_by_text", f"""
WITH {OVERLAP_TOP}, hits AS (SELECT * FROM anchors), {SIBLINGS},
opened AS (SELECT s.*, left(chunk_text, 80) AS opening FROM siblings s JOIN chunks USING (chunk_id))
SELECT q_id, chunk_id, is_hit, place FROM opened o WHERE is_hit OR (
  NOT EXISTS (SELECT 1 FROM opened h WHERE h.is_hit AND h.q_id = o.q_id AND h.opening = o.opening)
  AND chunk_id = (SELECT min(chunk_id) FROM opened m WHERE NOT m.is_hit AND m.q_id = o.q_id AND m.opening = o.opening))""")
def sibling_expand_by_text(spark, d):
    return C.sibling_expand(anchors(spark, d), T.chunks(spark, d), by_text=True)


CAPPED = """first_rows AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY is_hit DESC, place) AS rn FROM sized QUALIFY rn <= 24),
running AS (SELECT *, coalesce(sum(length(snippet)) OVER (PARTITION BY q_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM first_rows),
capped AS (SELECT q_id, chunk_id, rn, CASE WHEN used + length(snippet) <= 24000 THEN snippet ELSE left(snippet, 24000 - used) END AS snippet
  FROM running WHERE used + length(snippet) <= 24000 OR 24000 - used >= 200)"""


@register("cap_context", f"""
WITH {OVERLAP_TOP}, hits AS (SELECT * FROM anchors), {SIBLINGS}, sized AS (SELECT s.*, chunk_text AS snippet FROM siblings s JOIN chunks USING (chunk_id)), {CAPPED}
SELECT * FROM capped""")
def cap_context(spark, d):
    chunks = T.chunks(spark, d)
    grown = C.sibling_expand(anchors(spark, d), chunks)
    texts = grown.join(chunks.select("chunk_id", F.col("chunk_text").alias("snippet")), "chunk_id")
    return C.cap_context(texts, [F.col("is_hit").desc(), F.col("place")]).select("q_id", "chunk_id", "rn", "snippet")


@register("pinned_context", f"""
WITH {O.CHUNKS}, pins AS (SELECT item_id AS q_id, unnest([item_id * 3, item_id + 500, -1, item_id * 3]) AS chunk_id, unnest([0, 1, 2, 3]) AS rn FROM benchmark),
hits AS (SELECT q_id, chunk_id, min(rn) AS rn FROM pins SEMI JOIN chunks USING (chunk_id) GROUP BY ALL), {SIBLINGS},
sized AS (SELECT s.*, left(chunk_text, 1200) AS snippet FROM siblings s JOIN chunks USING (chunk_id)), {CAPPED} SELECT * FROM capped""")
def pinned_context(spark, d):
    item = F.col("item_id")
    pins = T.load(spark, d, "benchmark").select(
        item.alias("q_id"), F.array(item * 3, item + 500, F.lit(-1).cast("long"), item * 3).alias("pinned"))
    return C.pinned_context(pins, T.chunks(spark, d)).select("q_id", "chunk_id", "rn", "snippet")


@register("citations", f"""
WITH {OVERLAP_TOP}, {NARROW}
SELECT n.q_id, n.ref, n.chunk_id, n.doc_name, c.section_heading AS heading, c.page_number AS page,
  left({O.strip('c.chunk_text')}, 240) AS snippet, round(n.score, 4) AS score
FROM narrow n JOIN chunks c USING (chunk_id) WHERE n.ref IN (1, 3, n.q_id % 15)""")
def citations(spark, d):
    answers = T.queries(spark, d).select("q_id", F.concat(
        F.lit("First [1], then [3][1] and ["), (F.col("q_id") % 15).cast("string"), F.lit("].")).alias("answer"))
    return C.citations(passages(spark, d), answers, T.chunks(spark, d))


@register("source_docs", f"""
WITH {OVERLAP_TOP}, {NARROW}, best AS (SELECT q_id, doc_name, max(score) AS score, min(ref) AS first_ref FROM narrow GROUP BY ALL)
SELECT q_id, rn, doc_name FROM ({O.ranked('best', tie='first_ref')})""")
def source_docs(spark, d):
    return C.source_docs(passages(spark, d))


MAPPED_SQL = "mapped AS (SELECT DISTINCT section_id, ord * 7 AS chunk_id FROM sections WHERE ord * 7 IN (SELECT doc_id FROM documents))"
BLEND = f"""{O.CHUNKS}, {O.KEYWORDS}, {O.FIELDS}, {O.SECTIONS}, {O.COSINE}, {MAPPED_SQL},
st AS (SELECT s.section_id, s.ord, s.title || ' ' || coalesce(p.title, '') AS title FROM sections s
  LEFT JOIN sections p ON p.project_id = s.project_id AND contains(s.section_id, '.') AND p.section_id = split_part(s.section_id, '.', 1)),
terms AS ({TITLE_TERMS.replace('FROM sections', 'FROM st')}),
tags AS (SELECT chunk_id, {O.classify(O.TAGGED_HAY)} AS tag FROM chunks),
points AS (
  SELECT section_id, chunk_id, CASE WHEN list_contains({O.sql_list(fixed.BLEND_STOP)}, term) THEN 0 ELSE 1 END *
      (10 * CAST(contains(d, term) AS INT) + 3 * CAST(contains(h, term) AS INT) + 2 * CAST(contains(k, term) AS INT) + CAST(contains(t, term) AS INT))
    + 8 * CAST(contains(h, term) AS INT) + 2 * CAST(contains(k, term) AS INT) + CAST(contains(t, term) AS INT) AS points
  FROM terms, fields WHERE contains(d, term) OR contains(h, term) OR contains(k, term) OR contains(t, term)
  UNION ALL SELECT section_id, chunk_id, score * 40 FROM cosine JOIN st ON st.ord = cosine.q_id WHERE score > 0
  UNION ALL SELECT section_id, chunk_id, 50 FROM mapped
  UNION ALL SELECT section_id, chunk_id, 15 FROM st, tags WHERE tag <> '' AND (tag = section_id OR starts_with(section_id, tag || '.') OR starts_with(tag, section_id || '.'))),
blend AS (SELECT section_id, chunk_id, round(sum(points), 4) AS score FROM points GROUP BY ALL)"""


def section_words(sections):
    words = R.section_terms(sections)
    return words.join(sections.select("project_id", "section_id", "ord"), ["project_id", "section_id"])


def blend_inputs(spark, d):
    sections = section_words(T.sections(spark, d))
    sims = R.similarities(T.query_vectors(spark, d), T.embedded_chunks(spark, d), None, None)
    by_section = sims.join(sections.select(F.col("ord").alias("q_id"), "section_id"), "q_id")
    mapped = sections.select("section_id", (F.col("ord") * 7).alias("chunk_id")).join(
        T.chunks(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    return sections, by_section, mapped


@register("blend_rank", f"""
WITH {BLEND}, named AS (SELECT b.*, doc_name, coalesce(page_number, 0) AS page FROM blend b JOIN chunks USING (chunk_id))
SELECT section_id, chunk_id, score, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, doc_name, page, chunk_id) AS rn FROM named QUALIFY rn <= 50""")
def blend_rank(spark, d):
    sections, sims, mapped = blend_inputs(spark, d)
    return C.blend_rank(sections, T.keyed_chunks(spark, d), sims, mapped, k=50)


@register("cross_section_dedupe", f"""
WITH RECURSIVE {LEXICAL}, pool AS (SELECT project_id, section_id, list(chunk_id ORDER BY round(score, 9) DESC, chunk_id) AS ids FROM lexical GROUP BY ALL),
steps AS (SELECT p.project_id, p.section_id, ids, row_number() OVER (PARTITION BY p.project_id ORDER BY ord) AS j
  FROM pool p JOIN sections s ON s.project_id = p.project_id AND s.section_id = p.section_id),
walk AS (SELECT project_id, section_id, j, ids[1:6] AS taken, ids[1:6] AS used FROM steps WHERE j = 1
  UNION ALL SELECT project_id, section_id, j, taken, list_concat(used, taken) FROM (
    SELECT s.project_id, s.section_id, s.j, w.used, (CASE WHEN len(list_filter(s.ids, lambda c: NOT list_contains(w.used, c))) >= 4
      THEN list_filter(s.ids, lambda c: NOT list_contains(w.used, c)) ELSE s.ids END)[1:6] AS taken
    FROM walk w JOIN steps s ON s.project_id = w.project_id AND s.j = w.j + 1))
SELECT project_id, section_id, unnest(range(1, len(taken) + 1)) AS rn, unnest(taken) AS chunk_id FROM walk""")
def cross_section_dedupe(spark, d):
    sections = T.sections(spark, d)
    scores = R.lexical_section_scores(sections, T.keyed_chunks(spark, d))
    found = C.cross_section_dedupe(C.section_candidates(scores, sections, 6), 6)
    return found.withColumn("rn", F.col("rn").cast("long"))


PROBES = "probes AS (SELECT unnest(range({n})) AS probe, unnest({lists}) AS q)".format(
    n=len(fixed.FACT_PROBES),
    lists="[" + ", ".join(f"list_distinct({O.alnum_tokens(O.quoted(p))})" for p in fixed.FACT_PROBES) + "]")


@register("fact_candidates", f"""
WITH {O.CHUNKS}, {PROBES}, pt AS (SELECT probe, len(q) AS q_size, unnest(q) AS term FROM probes),
ct AS (SELECT project_id, chunk_id, unnest(list_distinct({O.alnum_tokens("chunk_text || ' ' || section_heading || ' ' || doc_name")})) AS term FROM chunks),
sc AS (SELECT project_id, probe, chunk_id, count(*) / sqrt(any_value(q_size)) AS score FROM ct JOIN pt USING (term) GROUP BY ALL),
seats AS (
  SELECT project_id, chunk_id, 1 AS turn, row_number() OVER (PARTITION BY project_id ORDER BY chunk_id) AS a, 0 AS b FROM chunks WHERE regexp_matches(chunk_text, {O.quoted(fixed.HARD_SIGNAL)})
  UNION ALL SELECT project_id, chunk_id, 2, rn, probe FROM ({O.ranked('sc', 'project_id, probe', 6)})
  UNION ALL SELECT project_id, chunk_id, 3, row_number() OVER (PARTITION BY project_id ORDER BY chunk_id) AS a, 0 FROM chunks QUALIFY a <= 5),
once AS (SELECT project_id, chunk_id, turn, a, b FROM seats QUALIFY row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY turn, a, b) = 1)
SELECT project_id, chunk_id, turn, row_number() OVER (PARTITION BY project_id ORDER BY turn, a, b) AS rn FROM once QUALIFY rn <= 60""")
def fact_candidates(spark, d):
    return C.fact_candidates(T.chunks(spark, d))
