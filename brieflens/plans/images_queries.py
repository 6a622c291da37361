"""Image records over every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

from ..operators import images as I
from ..operators import ranking as R
from ..sources import tables as T
from . import oracle as O
from .registry import register

IMAGES = f"""{O.CHUNKS}, {O.KEYWORDS}, kw5 AS (SELECT chunk_id, string_agg(term, ' ' ORDER BY pos) AS k FROM kw WHERE pos <= 5 GROUP BY chunk_id),
images AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 50 = 49 THEN '' ELSE left(sha256(text), 12) END AS image_id,
  'F' || (doc_id // 20) || {O.pick('(doc_id // 20) % 7', T.DOC_SUFFIXES)} AS source_doc, nullif(doc_id % 7, 0) AS page_number,
  CASE WHEN doc_id % 5 = 3 THEN left(sha256(text), 12) ELSE {O.pick('doc_id % 5', T.CAPTION_HEADS)} || text END AS caption,
  CASE WHEN doc_id % 9 = 4 THEN '' ELSE coalesce(k, '') END AS keywords, {O.pick('doc_id % 8', T.DIAGRAM_TYPES)} AS diagram_type, (['unknown', '4 Demand', '6', ''])[doc_id % 4 + 1] AS section_hint,
  CASE WHEN doc_id % 6 = 0 THEN '3.2 Sites' WHEN doc_id % 6 = 1 THEN 'unknown' ELSE regexp_extract(text, '^([^\\s.,|]+)', 1) END AS section_heading, text AS description,
  (['', '4', '6'])[doc_id % 3 + 1] AS brd_section_id, lang, doc_id % 11 = 0 AS slide, doc_id % 3 AS lib FROM documents LEFT JOIN kw5 ON chunk_id = doc_id)"""
CONTENT = "concat_ws(' ', caption, keywords, section_heading, description)"
INDEXED = "concat_ws(' ', caption, keywords, section_heading, section_heading, description, source_doc, image_id)"


def min3(x: str) -> str:
    return f"list_filter({O.tokens(x)}, lambda z: length(z) > 2)"


OKAPI = f"""{IMAGES}, {O.QUERIES}, itok AS (SELECT row_id, {min3(INDEXED)} AS toks FROM images), tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM itok),
post AS (SELECT row_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT row_id, len(toks) AS dl, unnest(toks) AS term FROM itok) GROUP BY row_id, term),
raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qn AS (SELECT q_id, term, count(*) AS qn FROM (SELECT q_id, unnest({min3('query')}) AS term FROM queries) GROUP BY ALL),
okapi AS (SELECT q_id, row_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN qn USING (term) JOIN idf USING (term), tot GROUP BY q_id, row_id),
qsz AS (SELECT q_id, len(list_distinct({min3('query')})) AS n_terms FROM queries),
cov AS (SELECT q_id, row_id, count(*) / any_value(n_terms) AS coverage FROM (SELECT row_id, unnest(list_distinct({min3(CONTENT)})) AS term FROM images) JOIN (SELECT DISTINCT q_id, term FROM qn) USING (term) JOIN qsz USING (q_id) GROUP BY q_id, row_id)"""
WEIGHT = "CASE " + " ".join(f"WHEN diagram_type = '{k}' THEN {v}" for k, v in fixed.DIAGRAM_WEIGHTS.items()) + " ELSE 1.0 END"
BRAND = f"(regexp_matches(caption, {O.quoted(fixed.LOGO_WORDS)}) OR diagram_type IN ('logo', 'icon'))"


def ranked(source, k):
    return O.ranked(source, "q_id", k, tie="row_id")


@register("bm25_okapi_images", f"WITH {OKAPI} SELECT q_id, row_id, rn, round(score, 6) AS score FROM ({ranked('(SELECT * FROM okapi WHERE score > 0)', 10)})")
def bm25_okapi_images(spark, d):
    out = I.image_search(T.queries(spark, d), T.images(spark, d), 10)
    return out.select("q_id", "row_id", "rn", F.round("score", 6).alias("score"))


@register("term_coverage", f"WITH {OKAPI} SELECT q_id, row_id, round(coverage, 6) AS coverage FROM cov")
def term_coverage(spark, d):
    return I.term_coverage(T.queries(spark, d), I.counted_terms(T.images(spark, d))).withColumn("coverage", F.round("coverage", 6))


SEARCH = f"""{OKAPI}, w AS (SELECT q_id, o.row_id, image_id, source_doc, CASE WHEN {BRAND} THEN 0 ELSE o.score * {WEIGHT} * CASE WHEN slide THEN 2.0 ELSE 1.0 END END AS score
  FROM okapi o JOIN images USING (row_id) WHERE o.score > 0 AND (brd_section_id = '' OR brd_section_id = '' || (q_id % 6 + 1))),
c AS (SELECT w.* FROM w JOIN cov USING (q_id, row_id) WHERE w.score > 0 AND coverage >= 0.05), b AS (SELECT q_id, max(score) AS best FROM c GROUP BY q_id),
found AS (SELECT c.* FROM c JOIN b USING (q_id) WHERE score >= best * 0.45)"""


def asked(spark, d):
    return T.queries(spark, d).withColumn("section_id", (F.col("q_id") % 6 + 1).cast("string"))


@register("image_search", f"WITH {SEARCH} SELECT q_id, row_id, rn, round(score, 6) AS score FROM ({ranked('found', 5)})")
def image_search(spark, d):
    out = I.image_search(asked(spark, d), T.images(spark, d), 5, prefer_diagrams=True, min_coverage=0.05, min_ratio=0.45)
    return out.select("q_id", "row_id", "rn", F.round("score", 6).alias("score"))


USED = "used AS (SELECT DISTINCT 'p' || (row_id % 10) AS project_id, image_id FROM images WHERE row_id % 4 = 0 AND image_id <> '')"


def placed_texts(spark, d):
    n = F.col("row_id")
    return T.images(spark, d).filter((n % 4 == 0) & (F.col("image_id") != "")).select(
        F.concat(F.lit("p"), (n % 10).cast("string")).alias("project_id"),
        F.concat(F.lit("See < image id='"), "image_id", F.lit("' > above")).alias("content"))


@register("drop_used_images", f"""
WITH {SEARCH}, {USED}, top AS ({ranked('found', 5)}) SELECT q_id, row_id, rn FROM top t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.project_id = 'p' || (t.q_id % 10) AND u.image_id = t.image_id)""")
def drop_used_images(spark, d):
    hits = I.image_search(asked(spark, d), T.images(spark, d), 5, prefer_diagrams=True, min_coverage=0.05, min_ratio=0.45)
    placed = hits.withColumn("project_id", F.concat(F.lit("p"), (F.col("q_id") % 10).cast("string")))
    return I.drop_used_images(placed, placed_texts(spark, d)).select("q_id", "row_id", "rn")


@register("section_images")
def section_images(spark, d):
    project = F.concat(F.lit("p"), (F.col("q_id") % 10).cast("string"))
    sections = T.queries(spark, d).select("q_id", project.alias("project_id"), "query", F.col("query").alias("title"))
    scope = T.chunks(spark, d).select("project_id", F.col("doc_name").alias("source_doc")).distinct()
    return I.section_images(sections, T.images(spark, d), scope, placed_texts(spark, d))


@register("classify_image_section", f"""
WITH {IMAGES} SELECT row_id, CASE WHEN regexp_matches(section_heading, '^[1-6]') THEN left(section_heading, 1) WHEN regexp_matches(section_hint, '^[1-6]') THEN left(section_hint, 1)
  ELSE {O.classify("lower(concat_ws(' ', section_heading, caption, keywords, left(description, 300)))", fixed.IMAGE_SECTION_PHRASES)} END AS section FROM images""")
def classify_image_section(spark, d):
    return T.images(spark, d).select("row_id", I.classify_image_section(
        F.col("section_heading"), F.col("section_hint"), F.col("caption"), F.col("keywords"), F.col("description")).alias("section"))


@register("junk_image", f"WITH {IMAGES} SELECT row_id, regexp_matches(caption, {O.quoted(fixed.JUNK_IMAGE)}) OR regexp_matches(keywords, {O.quoted(fixed.JUNK_IMAGE)}) AS junk, {BRAND} AS brand FROM images")
def junk_image(spark, d):
    return T.images(spark, d).select("row_id", I.is_junk().alias("junk"), I.is_brand_mark().alias("brand"))


@register("tag_filter", f"WITH {IMAGES} SELECT row_id FROM images WHERE contains(lower(lang), 'tag1') OR row_id % 10 = 1")
def tag_filter(spark, d):
    return T.images(spark, d).filter(I.tag_filter("TAG1")).select("row_id")


@register("word_and_search", f"""
WITH {IMAGES}, q AS (SELECT item_id AS q_id, lower(text) AS query FROM benchmark),
h AS (SELECT row_id, lower(concat_ws(' ', caption, description)) AS hay FROM images)
SELECT q_id, row_id FROM q, h WHERE len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: length(w) > 1 AND NOT contains(hay, w))) = 0""")
def word_and_search(spark, d):
    """Every word of a query must occur: the words are found by `substring_counts`, then counted."""
    asked_ = T.load(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.filter(
        F.array_distinct(F.split(F.lower("text"), X.uni(r"\s+"))), lambda w: F.length(w) > 1).alias("ws"))
    terms = asked_.select("q_id", F.size("ws").alias("n"), F.explode("ws").alias("term"))
    hay = T.images(spark, d).select(F.col("row_id").alias("chunk_id"), F.concat_ws(" ", "caption", "description").alias("hay"))
    found = R.substring_counts(hay, {"hay": F.col("hay")}, terms).join(terms, "term")
    return found.groupBy("q_id", F.col("chunk_id").alias("row_id")).agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c = n").select("q_id", "row_id")


@register("wants_diagram", f"SELECT item_id, regexp_matches(t, {O.quoted(fixed.DIAGRAM_TITLE)}) OR contains(lower(t), 'diagram') AS wanted FROM (SELECT item_id, text || (['', ' roadmap', ' Data  flow', ' diagrams'])[item_id % 4 + 1] AS t FROM benchmark)")
def wants_diagram(spark, d):
    title = F.concat("text", T.pick(F.col("item_id") % 4, ["", " roadmap", " Data  flow", " diagrams"]))
    return T.load(spark, d, "benchmark").select("item_id", I.wants_diagram(title).alias("wanted"))


@register("needs_retag", f"WITH {IMAGES} SELECT row_id FROM images WHERE keywords = ''")
def needs_retag(spark, d):
    return I.needs_retag(T.images(spark, d)).select("row_id")


@register("image_dedupe", f"WITH {IMAGES} SELECT min(row_id) AS row_id, image_id, lower(source_doc) AS doc FROM images WHERE image_id <> '' GROUP BY ALL")
def image_dedupe(spark, d):
    return I.image_dedupe(T.images(spark, d)).select("row_id", "image_id", F.lower("source_doc").alias("doc"))


LIBRARY = """links AS (SELECT 'p' || i AS project_id, i % 4 AS lib FROM (SELECT unnest(range(10)) AS i)), own AS (SELECT DISTINCT project_id, doc_name AS source_doc FROM chunks)"""


@register("image_library_membership", f"""
WITH {IMAGES}, {LIBRARY}, both_rows AS (SELECT project_id, image_id, lower(source_doc) AS doc, row_id, 0 AS late FROM images JOIN links USING (lib)
  UNION ALL SELECT project_id, image_id, lower(source_doc), row_id, 1 FROM images JOIN own USING (source_doc))
SELECT project_id, image_id, doc, row_id, late = 0 AS from_repo FROM both_rows WHERE image_id <> '' QUALIFY row_number() OVER (PARTITION BY project_id, image_id, doc ORDER BY late, row_id) = 1""")
def image_library_membership(spark, d):
    links = spark.range(10).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_id"),
                                   F.concat(F.lit("lib"), (F.col("id") % 4).cast("string")).alias("image_repo_id"))
    own = T.chunks(spark, d).select("project_id", F.col("doc_name").alias("source_doc")).distinct()
    return I.library_membership(T.images(spark, d).filter("image_id <> ''"), links, own)


@register("library_counts", f"WITH {IMAGES}, l AS (SELECT unnest(range(5)) AS lib) SELECT 'lib' || l.lib AS image_repo_id, count(row_id) AS image_count FROM l LEFT JOIN (SELECT * FROM images WHERE image_id <> '') i ON i.lib = l.lib GROUP BY ALL")
def library_counts(spark, d):
    libraries = spark.range(5).select(F.concat(F.lit("lib"), F.col("id").cast("string")).alias("image_repo_id"))
    return I.library_counts(libraries, T.images(spark, d))


@register("grounded_images")
def grounded_images(spark, d):
    from .context_queries import passages
    meta = T.chunks(spark, d).select("chunk_id", F.col("page_number").alias("page"), F.col("section_heading").alias("heading"))
    cited = passages(spark, d).join(meta, "chunk_id")
    return I.grounded_images(T.queries(spark, d), cited, T.images(spark, d))


@register("image_home", f"""
WITH {IMAGES}, p AS (SELECT 'p' || (doc_id % 7) AS project_id, left(sha256(text), 12) AS image_id, s AS pos, doc_id, CASE s WHEN 0 THEN lang ELSE regexp_extract(text, '(\\S+\\s+){{' || 1 || '}}\\S+') END AS heading FROM documents, (SELECT unnest([0, 1, 2]) AS s)),
m AS (SELECT image_id, arg_min(caption, row_id) AS caption, arg_min(description, row_id) AS description FROM images GROUP BY image_id),
sc AS (SELECT p.project_id, p.image_id, pos, len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', caption, description)), '[a-z0-9]{{3,}}')), list_distinct(regexp_extract_all(lower(heading), '[a-z0-9]{{3,}}')))) AS shared FROM p LEFT JOIN m USING (image_id))
SELECT project_id, image_id, arg_max(pos, shared * 100 - pos)::BIGINT AS pos FROM sc GROUP BY ALL""")
def image_home(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", "text", "lang", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("pos"))
    placements = rows.select(
        F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")).alias("project_id"), F.left(F.sha2("text", 256), F.lit(12)).alias("image_id"),
        F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") == 0, F.col("lang")).otherwise(F.regexp_extract("text", r"(\S+\s+){1}\S+", 0)).alias("heading"))
    return I.image_home(placements, T.images(spark, d))


@register("diagram_slides", """
WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS slide, l_quantity::INT AS n, (l_partkey % 7) AS conn, (l_suppkey % 12) AS txt, l_returnflag AS flag FROM lineitem),
sc AS (SELECT doc, slide, CASE WHEN n < 6 THEN 0 ELSE CASE WHEN conn >= 2 THEN 5 + least(conn, 20) * 0.3 ELSE 0 END + CASE WHEN n >= 15 THEN 2 ELSE 0 END + CASE WHEN n - txt >= 8 THEN 1.5 ELSE 0 END + CASE WHEN flag = 'R' THEN 2.5 ELSE 0 END END AS score FROM s)
SELECT doc, slide, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, slide) AS rn FROM sc WHERE score > 0 QUALIFY rn <= 3""")
def diagram_slides(spark, d):
    slides = T.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("slide"),
        F.col("l_quantity").cast("int").alias("n_shapes"), (F.col("l_partkey") % 7).cast("int").alias("n_connectors"),
        (F.col("l_suppkey") % 12).cast("int").alias("n_text"), F.when(F.col("l_returnflag") == "R", "Our Roadmap").otherwise("list").alias("text"))
    return I.diagram_slides(slides, ["roadmap", "workflow"], 3).select("doc", "slide", "rn")
