"""Projects, files, runs, saved results and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .numbering import top_k


def ingest_manifest(files: DataFrame) -> DataFrame:
    """Incoming files (name, size, category) with accepted extension, status or the reject reason."""
    base = F.element_at(F.split(F.replace(X.text_or_empty(F.col("name")), F.lit("\\"), F.lit("/")), "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"[^.]\.([^.]+)\z", 1))
    allowed = F.when(F.col("category") == "source", ext.isin(fixed.SOURCE_EXTENSIONS)).otherwise(ext.isin(fixed.PROMPT_EXTENSIONS))
    why = (F.when(~F.col("category").isin("source", "prompt"), "bad category").when(base.isin("", ".", ".."), "bad name")
           .when(~allowed, "bad type").when(F.col("size") > fixed.MAX_FILE_BYTES, "too large"))
    return files.select(*files.columns, base.alias("file_name"), ext.alias("ext"),
                        F.when(why.isNull(), "uploaded").otherwise("rejected").alias("status"), why.alias("reason"))


def project_list(projects: DataFrame, files: DataFrame, workflow: str | None = None, exclude: str | None = None) -> DataFrame:
    """Projects with file and chunk counts."""
    flow = F.coalesce("workflow", F.lit("new"))
    kept = projects.withColumn("workflow", flow)
    if workflow is not None:
        kept = kept.filter(F.col("workflow") == workflow)
    if exclude is not None:
        kept = kept.filter(F.col("workflow") != exclude)
    counts = files.groupBy("project_id").agg(F.count("*").alias("file_count"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"))
    return kept.join(counts, "project_id", "left").fillna(0, ["file_count", "chunk_count"])


def run_counts(runs: DataFrame) -> DataFrame:
    state = F.coalesce("status", F.lit("pending"))
    return runs.groupBy("project_id").agg(*[F.count_if(state == s).alias(s) for s in ("done", "failed", "running", "pending")])


def retain_latest(results: DataFrame, keep: int) -> DataFrame:
    return top_k(results, ["session_id"], [F.col("created_at").desc(), F.col("result_id").desc()], keep)


def history_list(messages: DataFrame) -> DataFrame:
    """Chats with title, size and last update."""
    usable = (F.col("role") == "user") & (X.strip(F.col("text")) != "")
    first = F.min_by(F.when(usable, X.chat_title_text(F.col("text"))), F.when(usable, F.col("turn")))
    return messages.groupBy("user", "chat_id").agg(
        F.coalesce(first, F.lit("New chat")).alias("title"), F.count("*").alias("message_count"), F.max("at").alias("updated_at"))


def history_upsert(chats: DataFrame, saved: DataFrame) -> DataFrame:
    """Store chats: creation time kept, a blank title derived by the caller, empty chats ignored.

    Both: user, chat_id, title, created_at, updated_at, message_count.
    """
    key = ["user", "chat_id"]
    new = saved.filter("message_count > 0").select(*key, *[F.col(c).alias(f"_{c}") for c in ("title", "updated_at", "message_count")])
    rows = chats.join(new, key, "full_outer")
    return rows.select(
        *key, F.coalesce("_title", "title").alias("title"),
        F.coalesce("created_at", "_updated_at").alias("created_at"), F.coalesce("_updated_at", "updated_at").alias("updated_at"),
        F.coalesce("_message_count", "message_count").alias("message_count"))
