"""Reading files into blocks, and the chunk store as a partitioned table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import text as X
from ..operators.numbering import number_by_id

CHUNK_SCHEMA = (
    "project_id string, chunk_id bigint, repo_id string, file_id string, doc_name string, page_number int, "
    "section_heading string, char_start int, char_end int, chunk_text string, keywords array<string>, "
    "brd_section_id string, created_at timestamp, embedding array<float>"
)


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One block per text file, undecodable bytes replaced."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(file_name(F.col("_metadata.file_path")).alias("doc_name"), F.lit(0).alias("block_no"), F.col("value").alias("text"),
                       F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("heading"))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def row_chunks(rows: DataFrame, columns: list[str], stem: str, order: str) -> DataFrame:
    """Each row as ``h: v`` lines without blank cells; empty rows skipped; id ``stem:csv:seq``.

    Sequence numbers follow the unique integer `order` and are made by id
    range, so no single task sees the whole table.
    """
    lines = F.filter(F.array(*[
        F.when(X.cell_text(F.col(c)) != "", F.concat(F.lit(f"{c}: "), X.cell_text(F.col(c)))) for c in columns
    ]), lambda x: x.isNotNull())
    filled = rows.select(F.col(order).alias("_order"), X.clean_text(F.array_join(lines, "\n")).alias("body_text")).filter("body_text <> ''")
    numbered = number_by_id(filled.withColumn("_all", F.lit(0)), ["_all"], "_order", "seq")
    return numbered.select(
        F.lit("CSV Row").alias("heading_path"), "body_text",
        F.concat(F.lit(f"{stem}:csv:"), (F.col("seq") - 1).cast("string")).alias("chunk_id"))


def sheet_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One ``h: v, h: v`` line per data row of a sheet (sheet, row_no, cells...)."""
    pairs = F.filter(F.array(*[
        F.when(X.cell_text(F.col(c)) != "", F.concat(F.lit(f"{c}: "), X.cell_text(F.col(c)))) for c in columns
    ]), lambda x: x.isNotNull())
    return rows.select("sheet", "row_no", F.array_join(pairs, ", ").alias("line")).filter("line <> ''")


def sheet_block(rows: DataFrame, columns: list[str], doc_name: Column) -> DataFrame:
    """One text block per sheet: heading, column line, one line per row; a sheet is one document."""
    joined = sheet_lines(rows, columns).groupBy("sheet").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("ls"))
    heading = F.concat(doc_name, F.lit(" — Sheet: "), "sheet")
    text = F.concat(heading, F.lit("\nColumns: " + " | ".join(columns) + "\n"), F.array_join(F.transform("ls", lambda r: r["line"]), "\n"))
    return joined.select("sheet", heading.alias("heading"), text.alias("text"))


def sheet_text(cells: Column, sheet: str, doc_name: str = "") -> Column:
    """A raw sheet ``array<array<string>>`` as its text block; null if nothing but the heading."""
    heading = f"{doc_name} — Sheet: {sheet}" if doc_name else f"Sheet: {sheet}"
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    head = F.get(rows, F.lit(0))

    def line(r: Column) -> Column:
        pairs = F.filter(F.zip_with(head, F.slice(r, F.lit(1), F.size(head)), lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit(": "), v))),
                         lambda p: p.isNotNull())
        return F.when(F.size(pairs) > 0, F.array_join(pairs, ", ")).otherwise(F.array_join(F.filter(r, lambda c: c != ""), " | "))

    body = F.filter(F.transform(F.slice(rows, F.lit(2), F.size(rows)), line), lambda x: x != "")
    columns = F.concat(F.lit("Columns: "), F.array_join(F.filter(head, lambda h: h != ""), " | "))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.lit(heading), columns), body), "\n"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunks of the projects present in `chunks`; other projects stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """The chunk store; a path that does not exist reads as empty, any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as why:
        if why.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def delete_file_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks without those of the listed files (project_id, file_id)."""
    return chunks.join(files, ["project_id", "file_id"], "left_anti")


def deleted_counts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files, ["project_id", "file_id"], "left_semi").groupBy("project_id", "file_id").agg(F.count("*").alias("removed"))


def replace_file_chunks(chunks: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Drop the re-ingested files' rows and append the new ones, ids from the project's max + 1.

    `new` has the columns of `chunks`; `order` is a unique integer giving the
    order of the new rows.
    """
    files = new.select("project_id", "file_id").distinct()
    kept = delete_file_chunks(chunks, files)
    top = kept.groupBy("project_id").agg(F.max("chunk_id").alias("_top"))
    numbered = number_by_id(new.withColumn("_order", F.col(order)), ["project_id"], "_order", "_seq")
    fresh = numbered.join(top, "project_id", "left").withColumn(
        "chunk_id", F.coalesce(F.col("_top"), F.lit(-1)) + F.col("_seq")).select(*chunks.columns)
    return kept.unionByName(fresh)


def union_project_repo(own: DataFrame, shared: DataFrame, links: DataFrame) -> DataFrame:
    """A project's chunks with those of its attached repositories.

    Ids of the project stay; a repository id already taken is renumbered above
    the project's largest.  `links`: project_id, repo_id.
    """
    mine = own.select("project_id", "chunk_id", "doc_name", F.lit(False).alias("from_repo"))
    pulled = shared.select("repo_id", "chunk_id", "doc_name").join(links, "repo_id").select("project_id", "chunk_id", "doc_name")
    taken = own.select("project_id", "chunk_id", F.lit(True).alias("_taken"))
    marked = pulled.join(taken, ["project_id", "chunk_id"], "left")
    free = marked.filter("_taken is null").select("project_id", "chunk_id", "doc_name")
    clash = number_by_id(marked.filter("_taken is not null"), ["project_id"], "chunk_id", "_seq")
    top = own.groupBy("project_id").agg(F.max("chunk_id").alias("_top"))
    moved = clash.join(top, "project_id", "left").select(
        "project_id", (F.coalesce("_top", F.lit(-1)) + F.col("_seq")).alias("chunk_id"), "doc_name")
    return mine.unionByName(free.unionByName(moved).withColumn("from_repo", F.lit(True)))


def source_doc_scope(own: DataFrame, shared: DataFrame, links: DataFrame) -> DataFrame:
    """Lower-cased file names of a project and its repositories."""
    mine = own.select("project_id", F.lower("doc_name").alias("doc"))
    pulled = shared.select("repo_id", F.lower("doc_name").alias("doc")).distinct().join(links, "repo_id").select("project_id", "doc")
    return mine.distinct().unionByName(pulled).distinct()


def deck_slides(chunks: DataFrame) -> DataFrame:
    """Text per document and page in chunk order; unpaged text is kept under a null page."""
    filled = chunks.filter(X.strip(X.text_or_empty(F.col("chunk_text"))) != "")
    joined = filled.groupBy("doc_name", "page_number").agg(
        F.sort_array(F.collect_list(F.struct("chunk_id", "chunk_text"))).alias("parts"))
    return joined.select("doc_name", "page_number", F.array_join(F.transform("parts", lambda p: p["chunk_text"]), "\n").alias("text"))


def slide_counts(chunks: DataFrame) -> DataFrame:
    """Slides of a deck: its largest page number."""
    filled = chunks.filter((X.strip(X.text_or_empty(F.col("chunk_text"))) != "") & F.col("page_number").isNotNull())
    return filled.groupBy("doc_name").agg(F.max("page_number").alias("slides"))


def rejoin_tables(chunks: DataFrame, name_words: tuple[str, str], markers: list[str]) -> DataFrame:
    """The chunks that hold a project's complete table, by the best predicate that matches any.

    Predicates in order: both words in the file name, a marker in the text, a
    numbered pipe row, more than five pipes.  One row per chunk in reading
    order; joining them is left to the reader of the file.
    """
    low, name = F.lower("chunk_text"), F.lower("doc_name")
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(low, F.lit(m))
    pipes = F.length("chunk_text") - F.length(F.replace("chunk_text", F.lit("|"), F.lit("")))
    rank = (F.when(F.contains(name, F.lit(name_words[0])) & F.contains(name, F.lit(name_words[1])), 1).when(marked, 2)
            .when(F.col("chunk_text").rlike(r"(?m)^\|?\s*\d+\s*\|"), 3).when(pipes > 5, 4))
    ranked = chunks.withColumn("rank", rank).filter("rank is not null")
    best = ranked.groupBy("project_id").agg(F.min("rank").alias("rank"))
    text = X.replace_all(X.strip(F.col("chunk_text")), (r"\n{3,}", "\n\n"), (r"(?m)^\s+", ""))
    return ranked.join(best, ["project_id", "rank"], "left_semi").select("project_id", "rank", "chunk_id", text.alias("text"))


