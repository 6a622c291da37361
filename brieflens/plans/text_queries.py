"""Scalar text functions, each over the whole table it reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..sources import tables as T
from . import oracle as O
from .registry import register


def over_documents(name, column, sql):
    """Register ``column(text)`` over every document."""
    register(name, f"SELECT doc_id, {sql('text')} AS value FROM documents")(
        lambda spark, d: T.load(spark, d, "documents").select("doc_id", column(F.col("text")).alias("value")))


def over_annotated(name, column, sql):
    register(name, f"WITH {O.ANNOTATED} SELECT doc_id, {sql('text')} AS value FROM annotated")(
        lambda spark, d: T.annotated(spark, d).select("doc_id", column(F.col("text")).alias("value")))


def joined(column):
    return lambda c: F.array_join(column(c), " ")


def sql_joined(fn):
    return lambda x: f"coalesce(array_to_string({fn(x)}, ' '), '')"


# list_distinct does not keep order, so set-valued results are compared sorted
over_documents("tokenize", joined(X.tokens), sql_joined(O.tokens))
over_documents("tokenize_min3", joined(X.tokens_min3),
               sql_joined(lambda x: f"list_filter({O.tokens(x)}, lambda z: length(z) > 2)"))
over_documents("token_set", lambda c: F.array_join(F.array_sort(X.token_set(c)), " "),
               sql_joined(lambda x: f"list_sort(list_distinct({O.alnum_tokens(x)}))"))
over_documents("content_terms", lambda c: F.array_join(F.array_sort(X.content_terms(c)), " "),
               sql_joined(lambda x: f"list_sort({O.content_terms(x)})"))
over_documents("content_terms_lexical",
               lambda c: F.array_join(F.array_sort(X.content_terms(c, fixed.LEXICAL_STOP)), " "),
               sql_joined(lambda x: f"list_sort({O.content_terms(x, fixed.LEXICAL_STOP)})"))
over_documents("norm_body", X.norm_body, lambda x: f"lower({O.collapse(x)})")
over_documents("norm_alnum_title", X.norm_alnum_title, lambda x: f"trim({O.rx(f'lower({x})', '[^a-z0-9]+', ' ')})")
over_documents("content_preview", X.content_preview,
               lambda x: f"CASE WHEN length({O.collapse(x)}) <= 520 THEN {O.collapse(x)} "
                         f"ELSE rtrim(left({O.collapse(x)}, 520), {O.WS}) || '...' END")
over_documents("result_preview", X.result_preview, lambda x: f"left({O.collapse(x)}, 140)")
over_documents("embed_text_prep", X.embed_text_prep,
               lambda x: f"left({O.strip(f'replace({x}, chr(10), chr(32))')}, 8000)")
over_documents("is_non_answer", X.is_non_answer,
               lambda x: "(" + " OR ".join(f"contains(lower({x}), {O.quoted(h)})" for h in fixed.HEDGES) + f" OR {x} = '')")


def clean_sql(x):
    return O.strip(O.rx(O.rx(f"replace({x}, chr(13), chr(10))", "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def locators_sql(x):
    for pattern in fixed.LOCATORS:
        x = O.rx(x, pattern, "")
    return O.strip(O.rx(O.rx(x, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def citations_sql(x):
    x = O.rx(x, "\\[[0-9]+\\]", "")
    for pattern, value in (("[ \\t]{2,}", " "), (" +([.,;:)])", "\\1"), ("[ \\t]+(\\n|$)", "\\1")):
        x = O.rx(x, pattern, value)
    return O.strip(x)


over_annotated("clean_text", X.clean_text, clean_sql)
over_annotated("dehyphenate", X.dehyphenate, lambda x: clean_sql(f"replace({x}, '-' || chr(10), '')"))
over_annotated("strip_locators", X.strip_locators, locators_sql)
over_annotated("strip_citations", X.strip_citations, citations_sql)
over_annotated("normalize_image_tags", X.normalize_image_tags,
               lambda x: O.rx(x, fixed.IMAGE_TAG_ANY, '<IMAGE id="\\1"/>'))
over_annotated("extract_image_ids", lambda c: F.array_join(X.image_ids(X.normalize_image_tags(c)), " "),
               lambda x: "array_to_string(regexp_extract_all({}, '<IMAGE id=\"([^\"]+)\"/>', 1), ' ')".format(
                   O.rx(x, fixed.IMAGE_TAG_ANY, '<IMAGE id="\\1"/>')))
over_annotated("strip_image_tags", X.strip_image_tags, lambda x: O.strip(O.rx(x, '<IMAGE id="[^"]+"/>', "")))


def title_key_sql(x, prefix):
    x = f"replace({O.rx(x, prefix, '')}, '&', ' and ')"
    return f"lower({O.collapse(O.rx(x, '[^\\p{L}\\p{N}_\\s]', ' '))})"


TITLE_SQL = "(['Section ', 'Clause ', '', 'Appendix b - ', 'IV) '])[doc_id % 5 + 1] || (doc_id % 30) || '.2 ' || text || ' & More'"


def titled(spark, d):
    n = F.col("doc_id")
    title = F.concat(T.pick(n % 5, ["Section ", "Clause ", "", "Appendix b - ", "IV) "]), (n % 30).cast("string"),
                     F.lit(".2 "), F.col("text"), F.lit(" & More"))
    return T.load(spark, d, "documents").select("doc_id", title.alias("title"))


@register("norm_title", f"SELECT doc_id, {title_key_sql(TITLE_SQL, fixed.TITLE_PREFIX)} AS title_key, "
                        f"{title_key_sql(TITLE_SQL, fixed.CHECK_TITLE_PREFIX)} AS check_key FROM documents")
def norm_title(spark, d):
    return titled(spark, d).select("doc_id", X.norm_title(F.col("title")).alias("title_key"),
                                   X.norm_check_title(F.col("title")).alias("check_key"))


@register("norm_doc_name", """
SELECT page_id, lower(regexp_extract(replace(url, '/page', chr(92) || 'Page'), '([^/\\\\]*)$', 1)) AS doc FROM pages""")
def norm_doc_name(spark, d):
    name = F.replace("url", F.lit("/page"), F.lit("\\Page"))
    return T.load(spark, d, "pages").select("page_id", X.norm_doc_name(name).alias("doc"))


@register("cell_to_str", """
SELECT o_orderkey, regexp_replace(CAST(round(o_totalprice) AS VARCHAR), '\\.0$', '') AS price,
       strftime(o_orderdate, '%Y-%m-%d') AS day,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE trim(o_orderstatus) END AS status FROM orders""")
def cell_to_str(spark, d):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), "o_orderstatus"))
    price = F.format_string("%.1f", F.round("o_totalprice"))
    return T.load(spark, d, "orders").select(
        "o_orderkey", X.cell_text(price).alias("price"), X.date_cell_text(F.col("o_orderdate")).alias("day"),
        X.cell_text(status).alias("status"))


@register("section_sort_key", """
WITH ids AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'app' || chr(CAST(65 + doc_id % 7 AS INTEGER)) ELSE '' || (doc_id % 13) || '.' || (doc_id % 101) END AS section_id FROM documents)
SELECT doc_id, section_id, rank() OVER (ORDER BY kind, a, b, w) AS pos FROM (
  SELECT doc_id, section_id, CASE WHEN section_id LIKE 'app%' THEN 1 ELSE 0 END AS kind, lower(section_id) AS w0,
         coalesce(try_cast(split_part(section_id, '.', 1) AS BIGINT), 0) AS a,
         CASE WHEN section_id LIKE 'app%' THEN 0 ELSE try_cast(split_part(section_id, '.', 2) AS BIGINT) END AS b,
         CASE WHEN section_id LIKE 'app%' THEN lower(section_id) ELSE '' END AS w FROM ids)""")
def section_sort_key(spark, d):
    """Rank of every id; ids repeat, so the rank is taken over distinct ids and joined back."""
    n = F.col("doc_id")
    sid = F.when(n % 11 == 0, F.concat(F.lit("app"), F.chr(65 + n % 7))).otherwise(
        F.concat((n % 13).cast("string"), F.lit("."), (n % 101).cast("string")))
    rows = T.load(spark, d, "documents").select("doc_id", sid.alias("section_id"))
    from ..operators.numbering import running_total
    counted = rows.groupBy("section_id").agg(F.count("*").alias("n")).withColumn(
        "key", X.section_sort_key(F.col("section_id")))
    placed = running_total(counted, "key", "n", "before")
    return rows.join(placed, "section_id").select("doc_id", "section_id", (F.col("before") + 1).alias("pos"))


@register("is_empty_value", """
SELECT doc_id, v IS NULL OR lower(trim(v)) IN ('', 'null', 'none', 'n/a', 'na', 'tbd', 'not specified', 'not stated', 'unknown', 'not provided') AS empty_text,
       n_tags = 0 AS empty_list
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' TBD ' WHEN 2 THEN 'N/A' WHEN 3 THEN lang ELSE text END AS v,
             length(regexp_replace(text, '[^|]', '', 'g')) AS n_tags FROM documents)""")
def is_empty_value(spark, d):
    n = F.col("doc_id") % 6
    value = F.when(n == 1, " TBD ").when(n == 2, "N/A").when(n == 3, F.col("lang")).when(n > 3, F.col("text"))
    tags = F.regexp_extract_all("text", F.lit(r"\|"), F.lit(0))
    return T.load(spark, d, "documents").select(
        "doc_id", X.is_empty_text(value).alias("empty_text"), X.is_empty_list(tags).alias("empty_list"))


@register("image_caption", """
SELECT doc_id, CASE WHEN trim(cap) <> '' AND lower(trim(cap)) <> lower(id) AND NOT regexp_matches(trim(cap), '(?i)^[0-9a-f]{8,}$') THEN trim(cap, ' ' || chr(10))
  WHEN head <> '' AND lower(head) NOT IN ('note','tip','important','unknown') THEN head
  WHEN page <> 0 THEN 'Figure (p.' || page || ')' ELSE 'Figure' END AS caption
FROM (SELECT doc_id, left(sha256(text), 12) AS id, doc_id % 7 AS page,
  CASE doc_id % 5 WHEN 0 THEN left(sha256(text), 12) WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN 'deadbeef' ELSE ' ' || text END AS cap,
  CASE doc_id % 4 WHEN 0 THEN 'Note' WHEN 1 THEN '' ELSE source END AS head FROM documents)""")
def image_caption(spark, d):
    n = F.col("doc_id")
    image_id = F.left(F.sha2("text", 256), F.lit(12))
    cap = (F.when(n % 5 == 0, image_id).when(n % 5 == 1, " ").when(n % 5 == 3, "deadbeef")
           .when(n % 5 == 4, F.concat(F.lit(" "), "text")))
    head = F.when(n % 4 == 0, "Note:").when(n % 4 == 1, "").otherwise(F.concat("source", F.lit(":")))
    return T.load(spark, d, "documents").select("doc_id", X.image_caption(cap, image_id, head, n % 7).alias("caption"))


@register("snippet", f"""
WITH docs AS (SELECT doc_id, text, list_sort(list_distinct({O.tokens('left(reverse(text), 200)')})) AS terms FROM documents),
hits AS (SELECT doc_id, text, list_filter(list_transform(terms, lambda t: instr(lower(text), t)), lambda p: p > 0)[1] AS hit FROM docs),
win AS (SELECT doc_id, text, hit, greatest(0, hit - 1 - 157) AS s FROM hits)
SELECT doc_id, CASE WHEN hit IS NULL THEN left(text, 450) || CASE WHEN length(text) > 450 THEN '…' ELSE '' END
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, CAST(s + 1 AS BIGINT), 450) || CASE WHEN s + 450 < length(text) THEN '…' ELSE '' END END AS snippet
FROM win""")
def snippet(spark, d):
    return T.load(spark, d, "documents").select(
        "doc_id", X.snippet(F.col("text"), X.expand_terms(F.left(F.reverse("text"), F.lit(200)))).alias("snippet"))


@register("renumber_citations", f"""
WITH {O.ANNOTATED}, refs AS (
  SELECT doc_id, text, (doc_id % 9) AS a, (doc_id % 4 + 3) AS b FROM annotated),
firsts AS (
  SELECT *, strpos(text, '[' || a || ']') AS pa, strpos(text, '[' || b || ']') AS pb FROM refs),
maps AS (
  SELECT *, a BETWEEN 1 AND 5 AND pa > 0 AS ua, b BETWEEN 1 AND 5 AND pb > 0 AS ub FROM firsts)
SELECT doc_id, {O.strip('''replace(replace(replace(replace(text, '[' || b || ']', chr(1)),
   '[' || a || ']', chr(2)),
   chr(1), CASE WHEN NOT ub THEN '' WHEN ua AND a <> b AND pa < pb THEN '[2]' ELSE '[1]' END),
   chr(2), CASE WHEN NOT ua THEN '' WHEN ub AND pb < pa THEN '[2]' ELSE '[1]' END)''')} AS answer,
  CASE WHEN ua AND ub AND a <> b THEN CASE WHEN pa < pb THEN a || ' ' || b ELSE b || ' ' || a END
       WHEN ub THEN '' || b WHEN ua THEN '' || a ELSE '' END AS old_refs
FROM maps""")
def renumber_citations(spark, d):
    five = F.lit(5)
    return T.annotated(spark, d).select(
        "doc_id", X.renumber_citations(F.col("text"), five).alias("answer"),
        F.array_join(X.citation_order(F.col("text"), five), " ").alias("old_refs"))


@register("chat_title", f"""
SELECT conv_id, coalesce(arg_min(CASE WHEN length(flat) > 60 THEN left(flat, 60) || '…' ELSE flat END, turn) FILTER (role = 'user' AND flat <> ''), 'New chat') AS title
FROM (SELECT conv_id, turn, role, {O.collapse('text')} AS flat FROM conversations) GROUP BY conv_id""")
def chat_title(spark, d):
    return titles_of(T.load(spark, d, "conversations"))


def titles_of(messages):
    usable = (F.col("role") == "user") & (X.strip(F.col("text")) != "")
    first = F.min_by(F.when(usable, X.chat_title_text(F.col("text"))), F.when(usable, F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(first, F.lit("New chat")).alias("title"))


@register("hard_signal", f"SELECT doc_id, regexp_matches(text, {O.quoted(fixed.HARD_SIGNAL)}) AS signal FROM documents")
def hard_signal(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.col("text").rlike(X.uni(fixed.HARD_SIGNAL)).alias("signal"))


@register("image_intent", f"WITH {O.QUERIES} SELECT q_id, regexp_matches(query, {O.quoted(fixed.IMAGE_INTENT)}) AS wanted FROM queries")
def image_intent(spark, d):
    return T.queries(spark, d).select("q_id", F.col("query").rlike(X.uni(fixed.IMAGE_INTENT)).alias("wanted"))


@register("clean_image_query", f"""
WITH {O.QUERIES} SELECT q_id, array_to_string(list_filter({O.alnum_tokens('query')}, lambda z: length(z) > 2
  AND NOT list_contains({O.sql_list(fixed.QUESTION_STOP + fixed.IMAGE_REQUEST_WORDS)}, z)), ' ') AS topic FROM queries""")
def clean_image_query(spark, d):
    return T.queries(spark, d).select("q_id", X.image_topic(F.col("query")).alias("topic"))
