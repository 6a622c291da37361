"""Lines, headings, sections and tables of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import markdown as M
from ..functions import structure as S
from ..functions import text as X
from ..sources import tables as T
from . import oracle as O
from .registry import register

WS_LINE = "' ' || chr(9) || chr(13)"


def exploded_lines(spark, d):
    rows = T.drafts(spark, d).select("doc_id", F.posexplode(S.lines(F.col("text"))).alias("i", "line"))
    return rows.withColumn("i", F.col("i").cast("long"))


@register("detect_heading", f"""
WITH {O.DRAFT_LINES}, l AS (SELECT doc_id, i, {O.strip("regexp_replace(CASE WHEN i % 6 = 1 THEN 'Section ' || i || ': ' || line ELSE line END, '^## ', '')")} AS line FROM draft_lines)
SELECT doc_id, i, CASE WHEN i % 6 = 1 THEN 'section' ELSE 'numbered' END AS kind,
  CASE WHEN i % 6 = 1 THEN '' || i WHEN regexp_matches(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}) THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}, 1)
    ELSE regexp_extract(line, {O.quoted(fixed.NUMBERED_LINE)}, 1) END AS id,
  {O.strip(f"CASE WHEN i % 6 = 1 THEN regexp_extract(line, {O.quoted(fixed.SECTION_LINE)}, 2) WHEN regexp_matches(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}) THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}, 2) ELSE regexp_extract(line, {O.quoted(fixed.NUMBERED_LINE)}, 2) END")} AS title
FROM l WHERE i % 6 = 1 OR regexp_matches(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}) OR regexp_matches(line, {O.quoted(fixed.NUMBERED_LINE)})""")
def detect_heading(spark, d):
    i = F.col("i")
    line = F.regexp_replace(F.when(i % 6 == 1, F.concat(F.lit("Section "), i.cast("string"), F.lit(": "), "line")).otherwise(F.col("line")), "^## ", "")
    rows = exploded_lines(spark, d).select("doc_id", "i", S.detect_heading(line).alias("h"))
    return rows.filter("h is not null").select("doc_id", "i", "h.kind", "h.id", "h.title")


@register("headingish", f"WITH {O.DRAFT_LINES} SELECT doc_id, i, {O.headingish('x')} AS headingish FROM draft_lines")
def headingish(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", T.SENTENCE_BREAK)).alias("i", "x"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), S.headingish(F.col("x")).alias("headingish"))


TOC_LINE_SQL = "CASE i % 4 WHEN 0 THEN x || ' .... ' || i WHEN 1 THEN (i % 9) || '.1' || chr(9) || x || chr(9) || ' ' || i || ' ' || chr(9) || i WHEN 2 THEN ' Contents ' ELSE x END"


def toc_lines(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", T.SENTENCE_BREAK)).alias("i", "x"))
    i = F.col("i")
    n = i.cast("string")
    line = (
        F.when(i % 4 == 0, F.concat(F.col("x"), F.lit(" .... "), n))
        .when(i % 4 == 1, F.concat((i % 9).cast("string"), F.lit(".1\t"), F.col("x"), F.lit("\t "), n, F.lit(" \t"), n))
        .when(i % 4 == 2, " Contents ").otherwise(F.col("x")))
    return rows.select("doc_id", i.cast("long").alias("i"), line.alias("line"))


@register("is_toc_line", f"""
WITH {O.DRAFT_LINES} SELECT doc_id, i, i % 10 = 9 OR lower({O.strip('line')}) IN ('contents', 'table of contents') OR regexp_matches(line, '\\.{{2,}}\\s*\\d+\\s*$') AS toc
FROM (SELECT doc_id, i, {TOC_LINE_SQL} AS line FROM raw_lines)""")
def is_toc_line(spark, d):
    style = F.when(F.col("i") % 10 == 9, "TOC 2")
    return toc_lines(spark, d).select("doc_id", "i", S.is_toc_line(F.col("line"), style).alias("toc"))


@register("clean_toc_text", f"""
WITH {O.DRAFT_LINES} SELECT doc_id, i, {O.collapse("regexp_replace(" + O.strip("regexp_replace(line, '((^|\\t)[ \\r\\n]*[0-9]+[ \\r\\n]*)+$', '')") + ", '[ \\t]*\\.{2,}[ \\t]*\\d+\\s*$', '')")} AS title
FROM (SELECT doc_id, i, {TOC_LINE_SQL} AS line FROM raw_lines)""")
def clean_toc_text(spark, d):
    return toc_lines(spark, d).select("doc_id", "i", S.clean_toc_text(F.col("line")).alias("title"))


FLAT = f"flat AS (SELECT doc_id, i, {O.collapse(O.rx('line', '^## ', ''))} AS line FROM draft_lines)"


@register("outline_from_lines", f"""
WITH {O.DRAFT_LINES}, {FLAT}, kept AS (
  SELECT * FROM flat WHERE line <> '' AND NOT (lower(line) IN ('contents', 'table of contents') OR regexp_matches(line, '\\.{{2,}}\\s*\\d+\\s*$'))),
parsed AS (SELECT *, CASE WHEN regexp_matches(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}) THEN {O.quoted(fixed.NUMBERED_PUNCT_LINE)}
   WHEN regexp_matches(line, {O.quoted(fixed.NUMBERED_LINE)}) THEN {O.quoted(fixed.NUMBERED_LINE)} END AS pat FROM kept),
heads AS (SELECT doc_id, i, line, CASE WHEN pat = {O.quoted(fixed.NUMBERED_PUNCT_LINE)} THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}, 1) WHEN pat IS NOT NULL THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_LINE)}, 1) END AS id0,
  trim(CASE WHEN pat = {O.quoted(fixed.NUMBERED_PUNCT_LINE)} THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}, 2) WHEN pat IS NOT NULL THEN regexp_extract(line, {O.quoted(fixed.NUMBERED_LINE)}, 2) END) AS title0 FROM parsed),
marked AS (SELECT *, CASE WHEN id0 IS NOT NULL AND {O.headingish('title0')} THEN id0 END AS id FROM heads),
filled AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section_id FROM marked)
SELECT doc_id, section_id, arg_min(title0, i) FILTER (id IS NOT NULL) AS title,
  coalesce(string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (id IS NULL), '') AS content
FROM filled WHERE section_id IS NOT NULL GROUP BY doc_id, section_id""")
def outline_from_lines(spark, d):
    items = F.transform(S.lines(F.col("text")), lambda x: F.regexp_replace(x, "^## ", ""))
    rows = T.drafts(spark, d).select("doc_id", F.explode(S.outline(items)).alias("s"))
    return rows.select("doc_id", F.col("s.id").alias("section_id"), "s.title", "s.content")


ALLOWED = "['1', '2', '4', '6', '9']"


@register("split_marked_text", f"""
WITH {O.DRAFT_LINES}, marked AS (SELECT *, CASE WHEN i % 6 = 0 AND list_contains({ALLOWED}, regexp_extract(line, '^## ([0-9]+(\\.[0-9]+)*)\\b', 1)) THEN regexp_extract(line, '^## ([0-9]+(\\.[0-9]+)*)\\b', 1) END AS id FROM draft_lines),
filled AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section_id FROM marked)
SELECT doc_id, section_id, {O.strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (id IS NULL), '')")} AS content FROM filled WHERE section_id IS NOT NULL GROUP BY ALL""")
def split_marked_text(spark, d):
    allowed = F.array(*[F.lit(x) for x in ("1", "2", "4", "6", "9")])
    rows = T.drafts(spark, d).select("doc_id", F.explode(S.split_marked(F.col("text"), allowed)).alias("s"))
    return rows.select("doc_id", F.col("s.id").alias("section_id"), "s.content")


@register("own_content", f"""
WITH {O.DRAFT_LINES}, heads AS (SELECT *, count(*) FILTER (i % 3 = 0) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM draft_lines)
SELECT doc_id, ord, bool_or(i % 3 <> 0 AND {O.strip('x')} <> '') AS has_own_content FROM heads GROUP BY ALL""")
def own_content(spark, d):
    """Headings are every third line here; a section owns content if a filled line follows."""
    def sections(ls):
        marks = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("id"), F.lit("").alias("title"))),
                         lambda m: m["i"] % 3 == 0)
        return F.transform(S.segments(ls, marks), lambda s, j: F.struct(
            (j + 1).cast("long").alias("ord"), F.exists(s["body"], lambda x: X.strip(x) != "").alias("has_own_content")))

    rows = T.load(spark, d, "documents").select("doc_id", F.explode(sections(F.split("text", T.SENTENCE_BREAK))).alias("s"))
    return rows.select("doc_id", "s.*")


@register("heading_path_chunks", f"""
WITH {O.DRAFT_LINES}, paras AS (SELECT doc_id, i, {O.strip('x')} AS t, CASE WHEN i % 15 = 3 THEN 1 WHEN i % 15 = 7 THEN 2 WHEN i % 15 = 9 THEN 4 END AS lvl FROM raw_lines WHERE {O.strip('x')} <> ''),
walk AS (SELECT *, count(lvl) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM paras),
heads AS (SELECT doc_id, h, lvl, t FROM walk WHERE lvl IS NOT NULL),
ranked AS (SELECT *, CASE WHEN lvl = 1 THEN 1 WHEN lvl = 2 THEN 2 ELSE 0 END AS l12 FROM heads),
ctx AS (SELECT *, last_value(CASE WHEN lvl = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY h) AS t1,
   last_value(CASE WHEN lvl = 1 THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY h) AS h1,
   last_value(CASE WHEN lvl = 2 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY h) AS t2,
   last_value(CASE WHEN lvl = 2 THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY h) AS h2,
   lag(CASE WHEN lvl = 4 THEN t END) OVER (PARTITION BY doc_id ORDER BY h) AS prev4 FROM ranked),
body AS (SELECT doc_id, h, t, (row_number() OVER (PARTITION BY doc_id, h ORDER BY i) - 1) // 10 AS part, i FROM walk WHERE lvl IS NULL),
chunks AS (SELECT doc_id, h, part, min(i) AS first_i, {O.strip(O.rx(O.rx("string_agg(t, chr(10) ORDER BY i)", "[ \\t]+", " "), "\\n{3,}", "\n\n"))} AS body FROM body GROUP BY ALL)
SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY first_i) - 1 AS seq, c.body FROM chunks c""")
def heading_path_chunks(spark, d):
    return styled_chunks(spark, d).select("doc_id", "seq", "body")


def styled_chunks(spark, d):
    paragraphs = F.transform(F.split("text", T.SENTENCE_BREAK), lambda x, i: F.struct(
        F.when(i % 15 == 3, "Heading 1").when(i % 15 == 7, "heading 2").when(i % 15 == 9, "Heading 4").otherwise("Normal").alias("style"),
        x.alias("text")))
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(S.heading_path_chunks(paragraphs)).alias("seq", "c"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("c.path").alias("heading_path"), "c.body")


@register("heading_paths")
def heading_paths(spark, d):
    """The paths of `heading_path_chunks`; the stack rule is tested on fixtures."""
    return styled_chunks(spark, d).select("doc_id", "seq", "heading_path")


@register("page_chunks", f"""
WITH {O.CHUNKS}, pages2 AS (SELECT file_id, chunk_id % 20 + 1 AS page, {O.strip(O.rx(O.rx("replace(replace(chunk_text, '-' || chr(10), ''), chr(13), chr(10))", "[ \\t]+", " "), "\\n{3,}", "\n\n"))} AS body FROM chunks)
SELECT file_id, 'Page ' || page AS heading_path, body, file_id || ':pdf:' || (row_number() OVER (PARTITION BY file_id ORDER BY page) - 1) AS chunk_id FROM pages2 WHERE body <> ''""")
def page_chunks(spark, d):
    from ..operators.chunking import page_chunks as build
    pages = T.chunks(spark, d).select("file_id", (F.col("chunk_id") % 20 + 1).alias("page"), F.col("chunk_text").alias("text"))
    return build(pages).select("file_id", "heading_path", "body", "chunk_id")


@register("assign_section_ids", f"""
WITH RECURSIVE {O.DRAFT_LINES}, e AS MATERIALIZED (SELECT doc_id, i, title, i % 3 + 1 AS lvl,
  string_split(regexp_extract(title, '{fixed.SECTION_NUMBER.replace(chr(92) + "z", "$")}', 1), '.') AS parts,
  regexp_extract(title, '{fixed.SECTION_NUMBER.replace(chr(92) + "z", "$")}', 2) AS rest FROM (SELECT doc_id, i, {O.strip('x')} AS title FROM raw_lines)),
walk AS (SELECT doc_id, -1::BIGINT AS i, list_transform(range(12), lambda k: 0::HUGEINT) AS c, 0::BIGINT AS level FROM (SELECT DISTINCT doc_id FROM e)
  UNION ALL SELECT doc_id, i, list_transform(range(1, 13), lambda k: CASE WHEN k > level THEN 0 WHEN parts[1] <> '' THEN try_cast(parts[k] AS HUGEINT)
    WHEN k = level THEN c[k] + 1 ELSE c[k] END), level FROM (
    SELECT e.doc_id, e.i, w.c, e.parts, CASE WHEN e.parts[1] <> '' THEN least(len(e.parts), 12) ELSE lvl END AS level
    FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i + 1))
SELECT doc_id, i, CASE WHEN parts[1] <> '' THEN array_to_string(parts, '.') ELSE array_to_string(c[1:level], '.') END AS section_id,
  CASE WHEN parts[1] <> '' THEN {O.strip('rest')} ELSE title END AS title, CAST(level AS INT) AS level FROM walk JOIN e USING (doc_id, i)""")
def assign_section_ids(spark, d):
    """Contents entries cycle through levels 1, 2, 3; a number in an entry wins and sets the counters."""
    parts = F.split("text", T.SENTENCE_BREAK)
    entries = F.transform(parts, lambda x, i: F.struct(x.alias("title"), (i % 3 + 1).alias("level")))
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(S.assign_section_ids(entries)).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.col("s.id").alias("section_id"), "s.title", "s.level")


@register("drop_meta_sections", f"""
WITH {O.DRAFT_LINES} SELECT doc_id, i, CASE i % 7 WHEN 0 THEN ' Table of Contents' WHEN 3 THEN 'TOC' ELSE x END AS title FROM raw_lines
WHERE i % 7 NOT IN (0, 3) AND lower({O.strip('x')}) NOT IN ('table of contents', 'toc')""")
def drop_meta_sections(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", T.SENTENCE_BREAK)).alias("i", "x"))
    title = F.when(F.col("i") % 7 == 0, " Table of Contents").when(F.col("i") % 7 == 3, "TOC").otherwise(F.col("x"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), title.alias("title")).filter(~S.is_meta_title(F.col("title")))


PIPES = f"""stripped AS (SELECT doc_id, i, {O.strip('line')} AS s FROM draft_lines),
pipe AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM stripped WHERE s LIKE '|%' AND length(s) - length(replace(s, '|', '')) >= 2),
rows0 AS (SELECT doc_id, i, run, list_transform(string_split(trim(s, '|'), '|'), lambda c: {O.strip('c')}) AS cells FROM pipe)"""


@register("extract_tables", f"""
WITH {O.DRAFT_LINES}, {PIPES}, data AS (SELECT * FROM rows0 WHERE len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-{{2,}}:?$'))) > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM data)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS table_no, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS row_no, array_to_string(cells, '/') AS cells
FROM sized WHERE n >= 2""")
def extract_tables(spark, d):
    tables = T.drafts(spark, d).select("doc_id", F.posexplode(S.extract_tables(F.col("text"))).alias("t", "rows"))
    rows = tables.select("doc_id", "t", F.posexplode("rows").alias("r", "cells"))
    return rows.select("doc_id", (F.col("t") + 1).cast("long").alias("table_no"), (F.col("r") + 1).cast("long").alias("row_no"),
                       F.array_join("cells", "/").alias("cells"))


@register("extract_tables_strict")
def extract_tables_strict(spark, d):
    text = F.concat(F.replace("text", F.lit(":--:"), F.lit("---")), F.lit("\n"))
    tables = T.drafts(spark, d).select("doc_id", F.posexplode(S.extract_tables_strict(text)).alias("t", "table"))
    return tables.select("doc_id", (F.col("t") + 1).cast("long").alias("table_no"), F.array_join("table.headers", "/").alias("headers"),
                         F.size("table.rows").cast("long").alias("n_rows"))


@register("split_adjacent_tables", f"""
WITH {O.DRAFT_LINES}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, {O.strip('line')} AS s FROM draft_lines WHERE starts_with({O.strip('line')}, '|') AND ends_with({O.strip('line')}, '|')),
tagged AS (SELECT *, regexp_matches(s, '^\\|[\\s\\-:|]+\\|$') AS sep, coalesce(regexp_matches(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '^\\|[\\s\\-:|]+\\|$'), false) AS next_sep FROM p),
grp AS (SELECT *, count(*) FILTER (next_sep AND NOT sep) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tagged),
part AS (SELECT *, count(*) FILTER (sep) OVER (PARTITION BY doc_id, g ORDER BY i) AS seps FROM grp WHERE g > 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS row_no FROM part WHERE NOT sep AND seps <= 1)
SELECT doc_id, g AS table_no, row_no, array_to_string(list_transform(string_split(trim(s, '|'), '|'), lambda c: {O.strip('c')}), '/') AS cells FROM kept""")
def split_adjacent_tables(spark, d):
    drafts = T.drafts(spark, d)
    tables = drafts.filter(F.col("text").rlike(r"\|")).select("doc_id", F.posexplode(S.split_adjacent_tables(S.lines(F.col("text")))).alias("t", "rows"))
    rows = tables.select("doc_id", "t", F.posexplode("rows").alias("r", "cells"), )
    marked = rows.join(drafts.filter(F.col("text").rlike(r"(?m)^\| --- \|")).select("doc_id"), "doc_id", "left_semi")
    return marked.select("doc_id", (F.col("t") + 1).cast("long").alias("table_no"), (F.col("r") + 1).cast("long").alias("row_no"),
                         F.array_join("cells", "/").alias("cells"))


# ---------------------------------------------------------------- clean-up of drafted text

HTML_LINES = f"""html_lines AS (SELECT doc_id, i, x, CASE i % 5
  WHEN 0 THEN '<h2 class="a">' || x || '</h2>' WHEN 1 THEN '<p>' || x || '</p>' WHEN 2 THEN '<ul><li> ' || x || '</li></ul>'
  WHEN 3 THEN '<TABLE><tr><th> <b>' || x || '</b></th><th>b</th></tr><tr><td>' || i || '</td></tr></table>'
  ELSE '<IMAGE id="' || i || '"/> &lt;' || x || '&gt; &amp;' END AS line FROM raw_lines)"""


@register("strip_html", f"""
WITH {O.DRAFT_LINES}, {HTML_LINES}, done AS (SELECT doc_id, i, CASE i % 5
  WHEN 0 THEN CASE WHEN {O.strip('x')} = '' THEN '' ELSE '**' || {O.strip('x')} || '**' END
  WHEN 1 THEN x || chr(10) WHEN 2 THEN '- ' || {O.strip('x')} || chr(10) WHEN 3 THEN line
  ELSE '<IMAGE id="' || i || '"/> <' || x || '> &' END AS line FROM html_lines)
SELECT doc_id, {O.strip(O.rx("string_agg(line, chr(10) ORDER BY i)", "\\n{3,}", "\n\n"))} AS text FROM done GROUP BY doc_id""")
def strip_html(spark, d):
    return T.html_drafts(spark, d).select("doc_id", M.strip_html(F.col("html")).alias("text"))


@register("html_tables_to_markdown", f"""
WITH {O.DRAFT_LINES}, {HTML_LINES}
SELECT doc_id, string_agg(CASE WHEN i % 5 = 3 THEN chr(10) || '| ' || {O.strip('x')} || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' |  |' || chr(10) ELSE line END, chr(10) ORDER BY i) AS text
FROM html_lines GROUP BY doc_id""")
def html_tables_to_markdown(spark, d):
    return T.html_drafts(spark, d).select("doc_id", M.html_tables_to_markdown(F.col("html")).alias("text"))


@register("html_to_text")
def html_to_text(spark, d):
    return T.load(spark, d, "pages").select("page_id", M.html_to_text(F.col("html"), 12000).alias("text"))


KEPT_LINES = "coalesce(string_agg(line, chr(10) ORDER BY i), '')"


@register("drop_placeholder_rows", f"""
WITH {O.DRAFT_LINES}, t AS (SELECT *, {O.strip('line')} AS s FROM draft_lines),
c AS (SELECT *, s LIKE '|%' AND s LIKE '%|' AND NOT contains(s, '---') AS is_row,
  list_filter(list_transform(string_split(trim(s, '|'), '|'), lambda c: {O.strip('c')}), lambda c: c <> '') AS cells FROM t),
k AS (SELECT *, is_row AND len(list_filter(cells, lambda c: NOT regexp_matches(c, {O.quoted(fixed.PLACEHOLDER)}))) = 0 AS gone FROM c)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id""")
def drop_placeholder_rows(spark, d):
    return T.drafts(spark, d).select("doc_id", M.drop_placeholder_rows(F.col("text")).alias("text"))


@register("normalize_table_text")
def normalize_table_text(spark, d):
    text = F.concat(F.replace("text", F.lit(":--:"), F.lit("---")), F.lit("\n"))
    return T.drafts(spark, d).select("doc_id", M.normalize_table_text(text).alias("text"))


KNOWN = ("1", "2", "3", "2.1", "4.3")


@register("strip_invented_headings", f"""
WITH {O.DRAFT_LINES}, b AS (SELECT *, {O.rx(O.strip('line'), '^#{1,6}\\s*', '')} AS bare FROM draft_lines),
h AS (SELECT *, CASE WHEN regexp_matches(bare, {O.quoted(fixed.SECTION_LINE)}) THEN 'section' WHEN regexp_matches(bare, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}) THEN regexp_extract(bare, {O.quoted(fixed.NUMBERED_PUNCT_LINE)}, 1)
   WHEN regexp_matches(bare, {O.quoted(fixed.NUMBERED_LINE)}) THEN regexp_extract(bare, {O.quoted(fixed.NUMBERED_LINE)}, 1) ELSE '' END AS id FROM b),
k AS (SELECT *, (id = 'section' OR id IN {KNOWN}) AND len(regexp_split_to_array({O.strip('bare')}, '\\s+')) <= 8 AS gone FROM h)
SELECT doc_id, {O.strip(O.rx("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')", "\\n{3,}", "\n\n"))} AS text FROM k GROUP BY doc_id""")
def strip_invented_headings(spark, d):
    ids = F.array(*[F.lit(k) for k in KNOWN])
    return T.drafts(spark, d).select("doc_id", M.strip_invented_headings(F.col("text"), ids).alias("text"))


@register("strip_empty_headings", f"""
WITH {O.DRAFT_LINES}, l AS (SELECT doc_id, i, CASE WHEN i % 6 IN (2, 3, 4) AND doc_id % 2 = 0 THEN '' ELSE line END AS line FROM draft_lines),
t AS (SELECT *, {O.strip('line')} AS s FROM l), h AS (SELECT *, regexp_matches(s, '^#{{1,6}}\\s+\\S') OR regexp_matches(s, '^\\*\\*[^*]{{1,60}}\\*\\*:?$') AS head FROM t),
n AS (SELECT *, lead(head, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS next_head FROM h WHERE s <> ''),
k AS (SELECT h.doc_id, h.i, h.line, coalesce(n.head AND n.next_head, false) AS gone FROM h LEFT JOIN n USING (doc_id, i))
SELECT doc_id, {O.strip(O.rx("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')", "\\n{3,}", "\n\n"))} AS text FROM k GROUP BY doc_id""")
def strip_empty_headings(spark, d):
    even = F.col("doc_id") % 2 == 0
    thin = F.array_join(F.transform(S.lines(F.col("text")), lambda x, i: F.when((i % 6 >= 2) & (i % 6 <= 4) & even, "").otherwise(x)), "\n")
    return T.drafts(spark, d).select("doc_id", M.strip_empty_headings(thin).alias("text"))


@register("strip_redundant_headers", f"""
WITH {O.DRAFT_LINES}, k AS (SELECT *, regexp_matches({O.strip('line')}, '^#{{1,6}}\\s+[\\d.]+\\b') AND starts_with(regexp_extract({O.strip('line')}, '^#{{1,6}}\\s+([\\d.]+)\\b', 1), '' || (doc_id % 4 + 1)) AS gone FROM draft_lines)
SELECT doc_id, ltrim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ''), chr(10)) AS text FROM k GROUP BY doc_id""")
def strip_redundant_headers(spark, d):
    sid = F.concat((F.col("doc_id") % 4 + 1).cast("string"), F.lit(".3"))
    return T.drafts(spark, d).select("doc_id", M.strip_redundant_headers(F.col("text"), sid).alias("text"))


# ---------------------------------------------------------------- chunking and packing

@register("chunk_text")
def chunk_text(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(S.pack_paragraphs(F.col("text"))).alias("seq", "c"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("c.text").alias("chunk_text"), "c.char_start", "c.char_end")


@register("pack_parts")
def pack_parts(spark, d):
    """Sentences of a document as blocks, packed to 1,000 characters."""
    blocks = F.transform(F.split("text", T.SENTENCE_BREAK), lambda x, i: F.struct(
        F.concat(F.lit("=== "), i.cast("string"), F.lit(" ===")).alias("label"), x.alias("text")))
    rows = T.load(spark, d, "documents").select("doc_id", F.posexplode(S.pack_parts(blocks, 1000)).alias("block", "part"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), F.col("part").cast("long").alias("part"))
