"""Section lists, families, statuses, imports and versions over one contract per document."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sections as S
from ..sources import contracts as D
from ..sources import tables as T
from ..sources import versions as V
from ..sources.shared import shared_dir
from . import oracle as O
from .checks_queries import CONTRACTS
from .registry import register

BASE = f"""{CONTRACTS}, numbered AS (SELECT *, CAST(substring(project_id, 2) AS BIGINT) AS n FROM sections),
secs AS (SELECT project_id, section_id, ord, title, n, NOT (ord = 4 AND n % 2 = 0) AS has_own_content FROM numbered),
approved AS (SELECT project_id, section_id, content FROM numbered WHERE (n + ord) % 3 > 0 OR n % 7 = 0)"""


def secs(spark, d):
    n = F.substring("project_id", 2, 12).cast("long")
    return D.contracts(spark, d).withColumn("has_own_content", ~((F.col("ord") == 4) & (n % 2 == 0)))


def approved(spark, d):
    n = F.substring("project_id", 2, 12).cast("long")
    return D.contracts(spark, d).filter(((n + F.col("ord")) % 3 > 0) | (n % 7 == 0)).select("project_id", "section_id", "content")


@register("top_level", f"WITH {BASE} SELECT project_id, section_id FROM secs WHERE NOT contains(section_id, '.')")
def top_level(spark, d):
    return secs(spark, d).filter(S.is_top_level(F.col("section_id"))).select("project_id", "section_id")


FAMILY = f"""{BASE}, family AS (SELECT p.project_id, p.section_id AS parent_id, c.section_id, c.ord FROM secs p JOIN secs c
  ON c.project_id = p.project_id AND (c.section_id = p.section_id OR starts_with(c.section_id, p.section_id || '.'))),
blocks AS (SELECT f.* FROM family f JOIN secs p ON p.project_id = f.project_id AND p.section_id = f.parent_id
  WHERE NOT (f.section_id = f.parent_id AND NOT p.has_own_content AND (SELECT count(*) FROM family g WHERE g.project_id = f.project_id AND g.parent_id = f.parent_id) > 1))"""


@register("family", f"WITH {FAMILY} SELECT project_id, parent_id, section_id FROM family")
def family(spark, d):
    return S.families(secs(spark, d)).select("project_id", "parent_id", "section_id")


@register("draftable_blocks", f"WITH {FAMILY} SELECT project_id, parent_id, section_id FROM blocks")
def draftable_blocks(spark, d):
    return S.draftable_blocks(secs(spark, d)).select("project_id", "parent_id", "section_id")


@register("select_sections", f"""
WITH {BASE} SELECT project_id, section_id, row_number() OVER (PARTITION BY project_id ORDER BY CAST(split_part(section_id, '.', 1) AS INT), coalesce(try_cast(split_part(section_id, '.', 2) AS INT), -1)) AS pos
FROM secs WHERE (n + ord) % 2 = 0""")
def select_sections(spark, d):
    from pyspark.sql import Window
    n = F.substring("project_id", 2, 12).cast("long")
    rows = secs(spark, d)
    picked = S.select_sections(rows, rows.filter((n + F.col("ord")) % 2 == 0).select("project_id", "section_id"))
    w = Window.partitionBy("project_id").orderBy("sort_key")  # the sections of one contract
    return picked.select("project_id", "section_id", F.row_number().over(w).alias("pos"))


def state(spark, d):
    """A saved draft on every parent, marked per block for even contracts, unmarked for odd ones."""
    n = F.substring("project_id", 2, 12).cast("long")
    rows = D.contracts(spark, d)
    blocks = S.families(secs(spark, d)).join(rows.select("project_id", "section_id", "content"), ["project_id", "section_id"])
    joined = blocks.groupBy("project_id", F.col("parent_id").alias("section_id")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "section_id", "content"))).alias("b"))
    marked = F.array_join(F.transform("b", lambda x: F.concat(F.lit("### "), x["section_id"], F.lit(" t\n"), x["content"])), "\n")
    plain = F.array_join(F.transform("b", lambda x: x["content"]), "\n")
    return joined.filter(n % 4 > 0).select("project_id", "section_id", F.when(n % 2 == 0, marked).otherwise(plain).alias("draft_content"))


STATE = f"""{FAMILY}, drafts AS (SELECT f.project_id, f.parent_id, string_agg(CASE WHEN s.n % 2 = 0 THEN '### ' || f.section_id || ' t' || chr(10) || s.content ELSE s.content END, chr(10) ORDER BY f.ord) AS draft
  FROM family f JOIN numbered s ON s.project_id = f.project_id AND s.section_id = f.section_id WHERE s.n % 4 > 0 GROUP BY ALL)"""


@register("section_status", f"""
WITH {STATE}, allok AS (SELECT b.project_id, b.parent_id, bool_and(a.content IS NOT NULL) AS ok FROM blocks b LEFT JOIN approved a ON a.project_id = b.project_id AND a.section_id = b.section_id GROUP BY ALL)
SELECT s.project_id, s.section_id, s.title, CASE WHEN ok THEN 'generated' WHEN coalesce(draft, '') <> '' THEN 'in-progress' ELSE 'not-started' END AS status,
  (SELECT count(*) - 1 FROM family f WHERE f.project_id = s.project_id AND f.parent_id = s.section_id) AS child_count
FROM secs s LEFT JOIN allok o ON o.project_id = s.project_id AND o.parent_id = s.section_id LEFT JOIN drafts d ON d.project_id = s.project_id AND d.parent_id = s.section_id WHERE NOT contains(s.section_id, '.')""")
def section_status(spark, d):
    return S.section_status(secs(spark, d), approved(spark, d), state(spark, d)).drop("ord")


@register("ordered_approved", f"WITH {BASE} SELECT s.project_id, s.section_id, s.ord, s.title, a.content FROM secs s JOIN approved a USING (project_id, section_id) WHERE a.content <> ''")
def ordered_approved(spark, d):
    return S.ordered_approved(secs(spark, d), approved(spark, d))


@register("all_with_status", f"WITH {BASE} SELECT s.project_id, s.section_id, s.ord, s.title, has_own_content, a.content FROM secs s LEFT JOIN approved a USING (project_id, section_id)")
def all_with_status(spark, d):
    return S.all_with_status(secs(spark, d), approved(spark, d))


@register("review_sections")
def review_sections(spark, d):
    return S.review_sections(secs(spark, d), approved(spark, d), state(spark, d))


@register("prior_context", f"""
WITH {BASE} SELECT s.project_id, s.section_id, coalesce(string_agg('### ' || p.title || ' (already approved)' || chr(10) || a.content, chr(10) || chr(10) ORDER BY p.ord) FILTER (a.content <> ''), '') AS prior
FROM secs s LEFT JOIN secs p ON p.project_id = s.project_id AND p.ord < s.ord LEFT JOIN approved a ON a.project_id = p.project_id AND a.section_id = p.section_id GROUP BY ALL""")
def prior_context(spark, d):
    return S.prior_context(secs(spark, d), approved(spark, d))


@register("story_text", f"""
WITH {BASE}, t AS (SELECT s.project_id, string_agg('## Section ' || s.section_id || ': ' || s.title || chr(10) || {O.strip('a.content')}, chr(10) || chr(10)
   ORDER BY CAST(split_part(s.section_id, '.', 1) AS INT), coalesce(try_cast(split_part(s.section_id, '.', 2) AS INT), -1)) AS text FROM secs s JOIN approved a USING (project_id, section_id) WHERE {O.strip('a.content')} <> '' GROUP BY s.project_id)
SELECT project_id, CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || chr(10) || '[... content truncated ...]' ELSE text END AS text FROM t""")
def story_text(spark, d):
    return S.story_text(secs(spark, d), approved(spark, d), 20000)


@register("join_titles", f"""
WITH {BASE}, defs AS (SELECT * FROM (VALUES {', '.join(f"({O.quoted(s)}, {O.quoted('Default ' + s)})" for s, _, _ in D.OUTLINE)}) t(section_id, dt)),
own AS (SELECT project_id, section_id, CASE WHEN ord % 4 = 1 THEN ' ' ELSE title END AS title FROM secs)
SELECT coalesce(g.project_id, o.project_id) AS project_id, coalesce(g.section_id, o.section_id) AS section_id, coalesce(o.title, g.dt) AS title
FROM (SELECT project_id, section_id, dt FROM (SELECT DISTINCT project_id FROM secs) p, defs) g FULL JOIN (SELECT * FROM own WHERE trim(title) <> '') o ON o.project_id = g.project_id AND o.section_id = g.section_id""")
def join_titles(spark, d):
    defaults = spark.createDataFrame([(s, f"Default {s}") for s, _, _ in D.OUTLINE], "section_id string, title string")
    own = secs(spark, d).withColumn("title", F.when(F.col("ord") % 4 == 1, " ").otherwise(F.col("title")))
    return S.join_titles(defaults, own)


@register("enrich_sections", f"""
WITH {BASE} SELECT project_id, section_id, title, CASE WHEN n % 3 = 0 AND ord % 2 = 0 THEN 'saved' WHEN ord % 5 < 3 THEN 'fresh ' || ord WHEN ord % 2 = 0 THEN 'saved' ELSE '' END AS doc_keywords,
  CASE WHEN ord % 2 = 0 THEN 'web' WHEN ord % 5 < 4 THEN 'new web' ELSE '' END AS web_keywords, n % 3 = 0 AND ord % 2 = 0 AS user_edited, CASE WHEN ord % 2 = 0 THEN 'generated' ELSE 'not-started' END AS status FROM secs""")
def enrich_sections(spark, d):
    n, o = F.substring("project_id", 2, 12).cast("long"), F.col("ord")
    rows = secs(spark, d)
    saved = rows.filter(o % 2 == 0).select(
        "project_id", "section_id", F.array(F.lit("saved")).alias("doc_keywords"), F.array(F.lit("web")).alias("web_keywords"),
        (n % 3 == 0).alias("user_edited"), F.lit("generated").alias("status"), F.lit("").alias("prompt"))
    fresh = rows.filter(o % 5 < 4).select(
        "project_id", "section_id", F.when(o % 5 < 3, F.array(F.concat(F.lit("fresh "), o.cast("string")))).otherwise(F.array().cast("array<string>")).alias("doc_keywords"),
        F.array(F.lit("new web")).alias("web_keywords"))
    out = S.enrich_sections(rows, saved, fresh)
    return out.select("project_id", "section_id", "title", F.array_join("doc_keywords", " ").alias("doc_keywords"),
                      F.array_join("web_keywords", " ").alias("web_keywords"), "user_edited", "status")


@register("client_name", """
SELECT c_custkey::VARCHAR AS project_id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'Given' END, CASE WHEN c_custkey % 5 = 1 THEN c_mktsegment END,
  CASE WHEN c_custkey % 5 = 2 THEN c_name END, CASE WHEN c_custkey % 5 = 3 THEN 'Proj ' || c_nationkey END, '') AS company FROM customer""")
def client_name(spark, d):
    n = F.col("c_custkey")
    rows = T.load(spark, d, "customer").withColumn("project_id", n.cast("string"))
    projects = rows.select("project_id", F.when(n % 5 == 2, F.col("c_name")).when(n % 5 == 3, " No description").alias("client"),
                           F.when(n % 5 == 3, F.concat(F.lit("Proj "), F.col("c_nationkey").cast("string"))).when(n % 5 == 4, " ").otherwise("x").alias("name"))
    supplied = rows.filter(n % 5 == 0).select("project_id", F.lit(" Given ").alias("company"))
    context = rows.filter(n % 5 < 2).select("project_id", F.col("c_mktsegment").alias("company"))
    return S.client_name(projects, supplied, context)


# ---------------------------------------------------------------- imports

def import_lines(spark, d):
    """Lines of an imported contract: matching, renumbered, conflicting and body lines."""
    n, o = F.substring("project_id", 2, 12).cast("long"), F.col("ord")
    bare = F.regexp_replace("title", r"^[0-9.]+\s+", "")
    text = (F.when(o % 5 == 0, F.col("title")).when(o % 5 == 1, F.concat(F.lit("99 "), bare))
            .when(o % 5 == 2, F.concat(F.lit("1 "), bare)).when(o % 5 == 3, bare).otherwise(F.col("content")))
    return D.contracts(spark, d).select("project_id", o.alias("line_no"), F.when(n % 2 == 0, "Heading 2").otherwise("Normal").alias("style"), text.alias("text"))


@register("match_import_heading")
def match_import_heading(spark, d):
    return S.match_import_headings(import_lines(spark, d), secs(spark, d))


@register("fuzzy_suggest")
def fuzzy_suggest(spark, d):
    lines = S.match_import_headings(import_lines(spark, d), secs(spark, d)).filter("section_id = '__UNMATCHED__'")
    return S.fuzzy_suggest(lines, secs(spark, d))


INCOMING = "incoming AS (SELECT project_id, section_id, CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN content ELSE content || ' updated' END AS content FROM numbered WHERE ord % 6 > 0)"


def incoming(spark, d):
    o, c = F.col("ord"), F.col("content")
    return D.contracts(spark, d).filter(o % 6 > 0).select(
        "project_id", "section_id", F.when(o % 4 == 0, "").when(o % 4 == 1, c).otherwise(F.concat(c, F.lit(" updated"))).alias("content"))


def preview_sql(x, most=520):
    return f"CASE WHEN length({O.collapse(x)}) <= {most} THEN {O.collapse(x)} ELSE rtrim(left({O.collapse(x)}, {most}), {O.WS}) || '...' END"


@register("import_preview", f"""
WITH {BASE}, {INCOMING} SELECT i.project_id, i.section_id, s.title, length(i.content) AS chars, {preview_sql('i.content', 700)} AS preview, coalesce(a.content, '') <> '' AS has_current, {preview_sql("coalesce(a.content, '')", 700)} AS current_preview
FROM incoming i JOIN secs s USING (project_id, section_id) LEFT JOIN approved a USING (project_id, section_id)""")
def import_preview(spark, d):
    return S.import_preview(incoming(spark, d), secs(spark, d), approved(spark, d))


@register("apply_import", f"""
WITH {BASE}, {INCOMING}, new AS (SELECT * FROM incoming WHERE content <> '')
SELECT coalesce(a.project_id, i.project_id) AS project_id, coalesce(a.section_id, i.section_id) AS section_id, coalesce(i.content, a.content) AS content, i.content IS NOT NULL AS imported
FROM approved a FULL JOIN new i ON a.project_id = i.project_id AND a.section_id = i.section_id""")
def apply_import(spark, d):
    return S.apply_import(approved(spark, d), incoming(spark, d).filter("content <> ''"))


@register("clean_import")
def clean_import(spark, d):
    tagged = incoming(spark, d).withColumn("content", F.concat(F.lit("<p>"), "content", F.lit("</p>\n# 4.1 Extra\nSection 2: Other")))
    return S.clean_import(tagged, secs(spark, d))


# ---------------------------------------------------------------- versions

VERSIONS = f"""{BASE}, v1 AS (SELECT project_id, section_id, title, content FROM numbered WHERE (n + ord) % 8 <> 1),
v2 AS (SELECT project_id, section_id, title, CASE WHEN (n + ord) % 3 = 0 THEN content || chr(10) || 'edited' ELSE content END AS content FROM numbered WHERE (n + ord) % 9 <> 2)"""


def versions(spark, d):
    n, o = F.substring("project_id", 2, 12).cast("long"), F.col("ord")
    rows = D.contracts(spark, d)
    v1 = S.snapshot(rows.filter((n + o) % 8 != 1), F.lit("v1"), F.lit("2026-01-01"))
    edited = rows.withColumn("content", F.when((n + o) % 3 == 0, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")))
    v2 = S.snapshot(edited.filter((n + o) % 9 != 2), F.lit("v2"), F.lit("2026-02-01"))
    return v1.unionByName(v2)


def two(spark, d):
    v = versions(spark, d)
    return v.filter("version_id = 'v1'"), v.filter("version_id = 'v2'")


@register("snapshot_write", f"""
WITH {VERSIONS} SELECT project_id, 'v1' AS version_id, count(*) AS sections, sum(length(content))::BIGINT AS chars FROM v1 GROUP BY project_id
UNION ALL SELECT project_id, 'v2', count(*), sum(length(content))::BIGINT FROM v2 GROUP BY project_id""")
def snapshot_write(spark, d):
    return S.version_counts(versions(spark, d)).drop("created_at")


@register("version_list", f"""
WITH {VERSIONS} SELECT project_id, 'v1' AS version_id, '2026-01-01' AS created_at, 2 AS pos FROM v1 GROUP BY project_id UNION ALL SELECT project_id, 'v2', '2026-02-01', 1 FROM v2 GROUP BY project_id""")
def version_list(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("project_id").orderBy(F.col("created_at").desc())  # one row per snapshot
    return S.version_counts(versions(spark, d)).select("project_id", "version_id", "created_at", F.row_number().over(w).alias("pos"))


DIFF = f"""{VERSIONS}, diff AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.section_id, b.section_id) AS section_id,
  CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' WHEN a.content = b.content THEN 'unchanged' ELSE 'changed' END AS change, coalesce(a.content, '') AS before, coalesce(b.content, '') AS after
  FROM v1 a FULL JOIN v2 b ON a.project_id = b.project_id AND a.section_id = b.section_id)"""


@register("version_diff", f"""
WITH {DIFF} SELECT project_id, section_id, change, length(before) AS before_chars, length(after) AS after_chars, {preview_sql('before')} AS before_preview, {preview_sql('after')} AS after_preview FROM diff WHERE change <> 'unchanged'""")
def version_diff(spark, d):
    return S.diff_details(S.version_diff(*two(spark, d)))


@register("version_diff_summary", f"WITH {DIFF} SELECT project_id, change, count(*) AS n FROM diff GROUP BY ALL")
def version_diff_summary(spark, d):
    return S.version_diff(*two(spark, d)).groupBy("project_id", "change").agg(F.count("*").alias("n"))


@register("line_diff")
def line_diff(spark, d):
    return S.changed_lines(S.version_diff(*two(spark, d))).withColumn("diff_lines", F.array_join("diff_lines", "\n"))


@register("version_restore", f"WITH {VERSIONS} SELECT project_id, section_id, title, content FROM v1 WHERE CAST(substring(project_id, 2) AS BIGINT) % 2 = 0 UNION ALL SELECT project_id, section_id, title, content FROM v2 WHERE CAST(substring(project_id, 2) AS BIGINT) % 2 = 1")
def version_restore(spark, d):
    v = versions(spark, d)
    n = F.substring("project_id", 2, 12).cast("long")
    wanted = v.select("project_id", F.when(n % 2 == 0, "v1").otherwise("v2").alias("version_id")).distinct()
    return S.restore(v, wanted)


@register("version_store", f"""
WITH {VERSIONS} SELECT project_id, section_id, title, content FROM v1 WHERE CAST(substring(project_id, 2) AS BIGINT) % 3 = 0
UNION ALL SELECT project_id, section_id, title, content FROM v2 WHERE CAST(substring(project_id, 2) AS BIGINT) % 3 <> 0""")
def version_store(spark, d):
    """Two states written and frozen, every third project put back to the first; the table as it is read afterwards."""
    root = f"{shared_dir(spark)}/versions_{uuid.uuid4().hex}"
    v1, v2 = two(spark, d)
    projects = D.contracts(spark, d).select("project_id").distinct()
    V.save_current(v1, root, projects)
    V.write_version(spark, root, projects, "v1", "2026-01-01", "first")
    V.save_current(v2, root, projects)
    V.write_version(spark, root, projects, "v2", "2026-02-01")
    third = F.substring("project_id", 2, 12).cast("long") % 3 == 0
    V.restore(spark, root, projects.filter(third).withColumn("version_id", F.lit("v1")))
    return V.current(spark, root).select("project_id", "section_id", "title", "content")


@register("export_bundle", f"WITH {BASE} SELECT a.project_id, a.section_id, a.content FROM approved a WHERE CAST(split_part(a.section_id, '.', 1) AS INT) % 4 = CAST(substring(project_id, 2) AS BIGINT) % 4")
def export_bundle(spark, d):
    """As `export_subset`, written as bundles and read back."""
    path = f"{shared_dir(spark)}/bundle_{uuid.uuid4().hex}"
    V.write_bundle(export_subset(spark, d), path)
    return V.read_bundle(spark, path).select("project_id", "section_id", "content")


@register("gen_queue", f"WITH {BASE} SELECT s.project_id, s.section_id FROM secs s WHERE NOT EXISTS (SELECT 1 FROM approved a WHERE a.project_id = s.project_id AND a.section_id = s.section_id AND a.content <> '')")
def gen_queue(spark, d):
    return S.gen_queue(secs(spark, d), approved(spark, d))


@register("export_subset", f"WITH {BASE} SELECT a.project_id, a.section_id, a.content FROM approved a WHERE CAST(split_part(a.section_id, '.', 1) AS INT) % 4 = CAST(substring(project_id, 2) AS BIGINT) % 4")
def export_subset(spark, d):
    n = F.substring("project_id", 2, 12).cast("long")
    rows = secs(spark, d).select("project_id", F.split_part("section_id", F.lit("."), F.lit(1)).alias("top")).distinct()
    return S.export_subset(approved(spark, d), rows.filter(F.col("top").cast("int") % 4 == n % 4))


@register("export_info", f"""
WITH {BASE} SELECT DISTINCT s.project_id, split_part(s.section_id, '.', 1) AS top, EXISTS (SELECT 1 FROM approved a WHERE a.project_id = s.project_id AND split_part(a.section_id, '.', 1) = split_part(s.section_id, '.', 1)) AS has_content FROM secs s""")
def export_info(spark, d):
    return S.export_info(secs(spark, d), approved(spark, d))


@register("sanitize_image_refs")
def sanitize_image_refs(spark, d):
    n = F.col("doc_id")
    texts = T.annotated(spark, d).select(n.alias("key"), F.concat(
        "text", F.lit("\n![a](attachment:x3)\n![b](dir/none.png)\n*Figure 1: lost*\n<IMAGE id='x"), (n % 12).cast("string"), F.lit("'>\nFigure 2: kept\n")).alias("content"))
    images = T.load(spark, d, "documents").select(F.concat(F.lit("x"), (n % 7).cast("string")).alias("image_id")).distinct()
    return S.sanitize_image_refs(texts, images)
