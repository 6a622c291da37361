"""Sources and the chunk store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as B
from ..sources.shared import shared_dir
from ..sources import store as S
from ..sources import tables as T
from . import oracle as O
from .registry import register

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_size"]


@register("csv_row_chunks", """
SELECT 'CSV Row' AS heading_path, 'p_partkey: ' || p_partkey || chr(10) || 'p_name: ' || trim(p_name) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || 'p_brand: ' || p_brand END || chr(10) || 'p_size: ' || p_size AS body_text,
  'part:csv:' || (row_number() OVER (ORDER BY p_partkey) - 1) AS chunk_id FROM part""")
def csv_row_chunks(spark, d):
    rows = T.load(spark, d, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("  "))
    return S.row_chunks(rows, PART_COLUMNS, "part", "p_partkey")


SHEET = """SELECT l_orderkey AS sheet, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS row_no, l_partkey, l_quantity, l_returnflag FROM lineitem"""


@register("sheet_block", f"""
WITH s AS ({SHEET}), l AS (SELECT sheet, row_no, 'l_partkey: ' || l_partkey || ', l_quantity: ' || CAST(l_quantity AS BIGINT) || CASE WHEN l_returnflag = 'A' THEN '' ELSE ', l_returnflag: ' || l_returnflag END AS line FROM s)
SELECT sheet, 'orders.xlsx — Sheet: ' || sheet AS heading, 'orders.xlsx — Sheet: ' || sheet || chr(10) || 'Columns: l_partkey | l_quantity | l_returnflag' || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS text FROM l GROUP BY sheet""")
def sheet_block(spark, d):
    """Line items of an order as one sheet; whole numbers lose their ``.0``."""
    rows = T.load(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sheet"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("row_no"),
        "l_partkey", "l_quantity", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("l_returnflag"))
    out = S.sheet_block(rows, ["l_partkey", "l_quantity", "l_returnflag"], F.lit("orders.xlsx"))
    return out.withColumn("sheet", F.col("sheet").cast("long"))


@register("delete_file_chunks", f"WITH {O.CHUNKS} SELECT project_id, chunk_id FROM chunks WHERE CAST(substring(file_id, 2) AS INT) % 4 <> 1")
def delete_file_chunks(spark, d):
    chunks = T.chunks(spark, d)
    files = chunks.select("project_id", "file_id").distinct().filter(F.substring("file_id", 2, 9).cast("int") % 4 == 1)
    return S.delete_file_chunks(chunks, files).select("project_id", "chunk_id")


@register("deleted_counts", f"WITH {O.CHUNKS} SELECT project_id, file_id, count(*) AS removed FROM chunks WHERE CAST(substring(file_id, 2) AS INT) % 4 = 1 GROUP BY ALL")
def deleted_counts(spark, d):
    chunks = T.chunks(spark, d)
    files = chunks.select("project_id", "file_id").distinct().filter(F.substring("file_id", 2, 9).cast("int") % 4 == 1)
    return S.deleted_counts(chunks, files)


@register("replace_file_chunks", f"""
WITH {O.CHUNKS}, kept AS (SELECT project_id, file_id, chunk_id, chunk_text FROM chunks WHERE CAST(substring(file_id, 2) AS INT) % 4 <> 1), top AS (SELECT project_id, max(chunk_id) AS m FROM kept GROUP BY project_id),
new AS (SELECT project_id, file_id, 'new: ' || chunk_text AS chunk_text, row_number() OVER (PARTITION BY project_id ORDER BY chunk_id) AS seq FROM chunks WHERE CAST(substring(file_id, 2) AS INT) % 4 = 1)
SELECT * FROM kept UNION ALL SELECT n.project_id, file_id, coalesce(m, -1) + seq, chunk_text FROM new n LEFT JOIN top USING (project_id)""")
def replace_file_chunks(spark, d):
    chunks = T.chunks(spark, d).select("project_id", "file_id", "chunk_id", "chunk_text")
    new = chunks.filter(F.substring("file_id", 2, 9).cast("int") % 4 == 1).withColumn("chunk_text", F.concat(F.lit("new: "), "chunk_text")).withColumn("pos", F.col("chunk_id"))
    return S.replace_file_chunks(chunks, new, "pos")


LINKS = "links AS (SELECT 'p' || i AS project_id, 'r' || (i % 5) AS repo_id FROM (SELECT unnest(range(10)) AS i))"


def links(spark):
    n = F.col("id")
    return spark.range(10).select(F.concat(F.lit("p"), n.cast("string")).alias("project_id"), F.concat(F.lit("r"), (n % 5).cast("string")).alias("repo_id"))


@register("union_project_repo", f"""
WITH {O.CHUNKS}, {LINKS}, pulled AS (SELECT l.project_id, c.chunk_id, c.doc_name FROM chunks c JOIN links l USING (repo_id)),
m AS (SELECT p.*, o.chunk_id IS NOT NULL AS clash, (SELECT max(chunk_id) FROM chunks x WHERE x.project_id = p.project_id) AS top FROM pulled p LEFT JOIN chunks o ON o.project_id = p.project_id AND o.chunk_id = p.chunk_id)
SELECT project_id, chunk_id, doc_name, false AS from_repo FROM chunks UNION ALL SELECT project_id, chunk_id, doc_name, true FROM m WHERE NOT clash
UNION ALL SELECT project_id, top + row_number() OVER (PARTITION BY project_id ORDER BY chunk_id), doc_name, true FROM m WHERE clash""")
def union_project_repo(spark, d):
    chunks = T.chunks(spark, d)
    return S.union_project_repo(chunks, chunks, links(spark))


@register("source_doc_scope", f"""
WITH {O.CHUNKS}, {LINKS} SELECT project_id, lower(doc_name) AS doc FROM chunks UNION SELECT l.project_id, lower(doc_name) FROM chunks JOIN links l USING (repo_id)""")
def source_doc_scope(spark, d):
    chunks = T.chunks(spark, d)
    return S.source_doc_scope(chunks, chunks, links(spark))


@register("project_scope", f"""
WITH {O.CHUNKS}, {LINKS}, scope AS (SELECT project_id, lower(doc_name) AS doc FROM chunks UNION SELECT l.project_id, lower(doc_name) FROM chunks JOIN links l USING (repo_id))
SELECT s.project_id, count(*) AS chunks FROM chunks c JOIN scope s ON s.doc = lower(c.doc_name) GROUP BY s.project_id""")
def project_scope(spark, d):
    """Chunks whose document belongs to a project or to one of its repositories."""
    chunks = T.chunks(spark, d)
    scope = S.source_doc_scope(chunks, chunks, links(spark))
    return chunks.select(F.lower("doc_name").alias("doc")).join(scope, "doc").groupBy("project_id").agg(F.count("*").alias("chunks"))


@register("repo_dependencies", f"""
WITH {LINKS}, {O.CHUNKS}, repos AS (SELECT repo_id, 'Library ' || repo_id AS name FROM chunks GROUP BY repo_id) SELECT l.project_id, l.repo_id, r.name FROM links l JOIN repos r USING (repo_id)""")
def repo_dependencies(spark, d):
    repos = T.chunks(spark, d).select("repo_id").distinct().withColumn("name", F.concat(F.lit("Library "), "repo_id"))
    attached = links(spark).groupBy("project_id").agg(F.collect_list("repo_id").alias("repositories"))
    return attached.select("project_id", F.explode("repositories").alias("repo_id")).join(repos, "repo_id")


@register("deck_assembly", f"""
WITH {O.CHUNKS} SELECT doc_name, page_number, string_agg(chunk_text, chr(10) ORDER BY chunk_id) AS text FROM chunks WHERE {O.strip('chunk_text')} <> '' GROUP BY ALL""")
def deck_assembly(spark, d):
    return S.deck_slides(T.chunks(spark, d))


@register("slide_counts", f"WITH {O.CHUNKS} SELECT doc_name, max(page_number) AS slides FROM chunks WHERE {O.strip('chunk_text')} <> '' AND page_number IS NOT NULL GROUP BY doc_name")
def slide_counts(spark, d):
    return S.slide_counts(T.chunks(spark, d))


@register("rejoin_tables_by_doc", f"""
WITH {O.CHUNKS}, r AS (SELECT *, CASE WHEN contains(lower(doc_name), 'f7') AND contains(lower(doc_name), 'docx') THEN 1 WHEN contains(lower(chunk_text), 'country.value') OR contains(lower(chunk_text), 'licensetype') THEN 2
  WHEN regexp_matches(chunk_text, '(?m)^\\|?\\s*\\d+\\s*\\|') THEN 3 WHEN length(chunk_text) - length(replace(chunk_text, '|', '')) > 5 THEN 4 END AS rank FROM chunks),
b AS (SELECT project_id, min(rank) AS rank FROM r GROUP BY project_id)
SELECT r.project_id, r.rank, chunk_id, regexp_replace(regexp_replace({O.strip('chunk_text')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^\\s+', '', 'g') AS text FROM r JOIN b ON b.project_id = r.project_id AND b.rank = r.rank""")
def rejoin_tables_by_doc(spark, d):
    return S.rejoin_tables(T.chunks(spark, d), ("f7", "docx"), ["country.value", "licensetype"])


@register("chunk_store")
def chunk_store(spark, d):
    """Write the chunk table, overwrite one project, read it back."""
    path = f"{shared_dir(spark)}/chunk_store_{uuid.uuid4().hex}"
    chunks = T.chunks(spark, d).select("chunk_id", "file_id", "doc_name", "chunk_text", "project_id")
    S.write_chunks(chunks, path)
    S.write_chunks(chunks.filter("project_id = 'p3'").withColumn("doc_name", F.lit("Replaced")), path)
    return S.read_chunks(spark, path).select("project_id", "chunk_id", "doc_name")


def block_rows(spark, d):
    n = F.col("doc_id")
    return T.load(spark, d, "documents").select(
        F.concat(F.lit("p"), (F.expr("doc_id div 20") % 10).cast("string")).alias("project_id"), n.alias("block_id"),
        F.concat(F.lit("f"), F.expr("doc_id div 20").cast("string")).alias("file_id"), "text", F.lit(None).cast("int").alias("page"),
        T.pick(n % 8, T.TAG_WORDS).alias("heading"))


@register("chunk_documents")
def chunk_documents(spark, d):
    """Blocks to chunks with section tag, keywords and sequential ids per project."""
    chunks = B.number_chunks(B.chunk_blocks(block_rows(spark, d)))
    return chunks.select("project_id", "chunk_id", "file_id", "chunk_text", "char_start", "char_end", "brd_section_id", F.array_join("keywords", " ").alias("keywords"))


@register("build_index")
def build_index(spark, d):
    """Blocks of many files to index statistics per term: document frequency over chunks."""
    from ..operators import ranking as R
    chunks = B.number_chunks(B.chunk_blocks(block_rows(spark, d))).select(
        F.concat("project_id", F.lit(":"), F.col("chunk_id").cast("string")).alias("chunk_id"), F.col("file_id").alias("doc_name"), "section_heading", "chunk_text")
    return R.term_statistics(R.postings(chunks))
