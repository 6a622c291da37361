"""Uploads as a file stream: new text files become chunks, each batch committed once.

The store has two folders:

* data, cut by version and project: the chunks a batch has made, and nothing else;
  a batch writes its own partitions and may write them again.
* manifest, cut by version: one row per file of the batch with its number of chunks
  and its first chunk id, written last.  A version without a manifest does not exist.

The state at a version is, for each file, the newest entry up to it, so a batch reads
manifests and its own files, never the chunks of others.  A version knows the query and
batch it comes from: a batch that is delivered again is found and not repeated.

A lost manifest version, or a checkpoint that has progressed without a store, stops the
stream; lost data is made again from the upload folder, with its ids, as a new version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_blocks, number_chunks
from ..sources.store import file_name

FILE = ["project_id", "file_id"]
CHUNK_COLUMNS = ["project_id", "chunk_id", "file_id", "doc_name", "section_heading", "char_start", "char_end",
                 "chunk_text", "keywords", "brd_section_id"]
HASH_RANGE = 1 << 54  # block ids are hashes: about a thousand ranges
MANIFEST = ("project_id string, file_id string, doc_name string, rows bigint, first_id bigint, query_id string, batch_id bigint, "
            "version int")


class StoreDamaged(RuntimeError):
    """Part of the store is gone and cannot be made again."""


def _existing(df_of, *args) -> DataFrame | None:
    """What the reader returns; none if its path does not exist.  Other failures are raised."""
    try:
        return df_of(*args)
    except AnalysisException as why:
        if why.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """All entries of all versions; a version has one row without a file besides.  None: there is no store yet."""
    rows = _existing(spark.read.schema(MANIFEST).parquet, f"{store}/manifest")
    if rows is None:
        return None
    span = rows.agg(F.min("version").alias("low"), F.max("version").alias("high"), F.count_distinct("version").alias("n")).first()
    if span["n"] == 0 or span["low"] != 0 or span["n"] != span["high"] + 1:
        raise StoreDamaged(f"{store}: {span['n']} manifest versions of {(span['high'] or 0) + 1} are there")
    return rows


def live_files(entries: DataFrame, version: int | None = None) -> DataFrame:
    """The newest entry of each file, up to a version."""
    seen = entries.filter("file_id IS NOT NULL") if version is None else entries.filter(F.col("file_id").isNotNull() & (F.col("version") <= version))
    newest = seen.groupBy(*FILE).agg(F.max(F.struct("version", "doc_name", "rows", "first_id")).alias("e"))
    return newest.select(*FILE, "e.*")


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The chunks of the store as of a version (the newest, if none is given).  A store that is not there is an error."""
    entries = manifest(spark, store)
    if entries is None:
        raise StoreDamaged(f"{store}: no manifest")
    files = live_files(entries, version).filter("rows > 0").select(*FILE, "version")
    data = _existing(spark.read.parquet, f"{store}/data")
    if data is None:
        if files.isEmpty():
            return spark.createDataFrame([], "project_id string, chunk_id bigint, file_id string")
        raise StoreDamaged(f"{store}: no data")
    return data.join(files, [*FILE, "version"], "left_semi").select(*CHUNK_COLUMNS)


def lost_files(spark: SparkSession, store: str) -> DataFrame:
    """Live files whose chunks are not all in the data folder: the columns of `live_files`."""
    files = live_files(manifest(spark, store)).filter("rows > 0")
    data = _existing(spark.read.parquet, f"{store}/data")
    if data is None:
        return files
    there = data.groupBy(*FILE, "version").agg(F.count("*").alias("_n"))
    return files.join(there, [*FILE, "version"], "left").filter("coalesce(_n, 0) <> rows").drop("_n")


def _text_files(reader, folder: str) -> DataFrame:
    """project_id, doc_name, text, modified of the files below ``folder/<project>/``.

    A file source reads each path once, so a new text of a file comes under a path of its own, in any folder of the project.
    """
    rows = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path, bare = F.col("_metadata.file_path"), folder.split("://")[-1].removeprefix("file:").rstrip("/")
    below = F.element_at(F.split(F.url_decode(path), rf"\Q{bare}/\E"), -1)
    return rows.select(F.get(F.split(below, "/"), F.lit(0)).alias("project_id"), file_name(path).alias("doc_name"),
                       F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def _newest(files: DataFrame) -> DataFrame:
    """One text per project and file name: the one modified last."""
    order = [*([F.col("modified").desc()] if "modified" in files.columns else []), F.xxhash64("text")]
    one = Window.partitionBy("project_id", "doc_name").orderBy(*order)
    return files.withColumn("_k", F.row_number().over(one)).filter("_k = 1").drop("_k", "modified")


def upload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Text files under ``folder/<project>/`` as they arrive."""
    return _text_files(spark.readStream, folder)


def _chunked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files with their ids, and their chunks, not yet numbered."""
    named = files.withColumn("file_id", F.left(F.sha2(F.concat_ws("/", "project_id", "doc_name"), 256), F.lit(12)))
    blocks = named.select(*FILE, "doc_name", F.xxhash64("file_id").alias("block_id"), "text",
                          F.lit(None).cast("int").alias("page"), F.lit("").alias("heading"))
    return named.select(*FILE, "doc_name"), chunk_blocks(blocks)


def _commit(spark: SparkSession, store: str, version: int, files: DataFrame, chunks: DataFrame, query_id: str, batch_id: int) -> DataFrame:
    """Write chunks, then the manifest that makes them count; its rows are returned."""
    chunks.select(*CHUNK_COLUMNS, F.lit(version).alias("version")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("version", "project_id").parquet(f"{store}/data")
    data = _existing(spark.read.parquet, f"{store}/data")
    made = files.select(*FILE, F.lit(0).cast("long").alias("_n"), F.lit(None).cast("long").alias("first_id")).limit(0) if data is None else (
        data.filter(F.col("version") == version).groupBy(*FILE).agg(F.count("*").alias("_n"), F.min("chunk_id").alias("first_id")))
    rows = files.distinct().join(made, FILE, "left").select(*FILE, "doc_name", F.coalesce("_n", F.lit(0)).alias("rows"), "first_id")
    head = spark.createDataFrame([(None,) * 5], "project_id string, file_id string, doc_name string, rows bigint, first_id bigint")
    out = f"{store}/manifest/version={version}"
    rows.unionByName(head).withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("long")}).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).filter("file_id IS NOT NULL")


def commit_batch(spark: SparkSession, store: str, files: DataFrame, query_id: str, batch_id: int) -> DataFrame:
    """Chunk the files (project_id, doc_name, text), replace their earlier chunks, give ids after the project's largest
    remaining one; the manifest rows of the batch are returned.  The same batch again returns what it has committed."""
    entries = manifest(spark, store)
    version = 0
    if entries is not None:
        done = entries.filter((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id))
        if not done.isEmpty():
            return done.filter("file_id IS NOT NULL")
        version = entries.agg(F.max("version")).first()[0] + 1
    named, chunks = _chunked(_newest(files))
    top = None
    if entries is not None:
        kept = live_files(entries).filter("rows > 0").join(named, FILE, "left_anti")
        top = kept.select("project_id", (F.col("first_id") + F.col("rows") - 1).alias("chunk_id"))
    return _commit(spark, store, version, named, number_chunks(chunks, top, HASH_RANGE), query_id, batch_id)


def repair(spark: SparkSession, folder: str, store: str) -> int:
    """Make lost chunks again from the upload folder, under the ids they had; the number of files that were lost."""
    lost = lost_files(spark, store)
    count = lost.count()
    if not count:
        return 0
    wanted = _text_files(spark.read, folder).join(lost.select("project_id", "doc_name"), ["project_id", "doc_name"], "left_semi")
    named, chunks = _chunked(_newest(wanted))
    again = chunks.groupBy(*FILE).agg(F.count("*").alias("_n"))
    gone = lost.join(again, FILE, "left").filter("coalesce(_n, 0) <> rows").select("project_id", "doc_name")
    missing = [tuple(r) for r in gone.take(20)]
    if missing:
        raise StoreDamaged(f"{store}: chunks lost and files changed or gone: {missing}")
    numbered = chunks.join(lost.select(*FILE, "first_id"), FILE).withColumn("chunk_id", F.col("first_id") + F.col("seq"))
    version = manifest(spark, store).agg(F.max("version")).first()[0] + 1
    _commit(spark, store, version, named, numbered, "repair", version)
    return count


def file_status(entries: DataFrame) -> DataFrame:
    """indexed with a chunk count, or error when a file gave no chunk."""
    return entries.select(*FILE, "doc_name", F.col("rows").alias("chunk_count"), F.when(F.col("rows") > 0, "indexed").otherwise("error").alias("status"))


def start_ingest(spark: SparkSession, folder: str, store: str, status: str, checkpoint: str) -> StreamingQuery:
    """Chunk every new file, replace its earlier chunks, record its status (one folder per batch)."""
    if manifest(spark, store) is not None:
        repair(spark, folder, store)
    elif _existing(spark.read.text, f"{checkpoint}/commits") is not None:
        raise StoreDamaged(f"{store}: the stream has committed batches before, but its store is gone")

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        query_id = own.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        file_status(commit_batch(own, store, batch, query_id, batch_id)).write.mode("overwrite").parquet(f"{status}/batch={batch_id}")

    return (upload_stream(spark, folder).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
