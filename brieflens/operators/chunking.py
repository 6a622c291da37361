"""From extracted blocks to chunk tables: chunk, tag, keyword, number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import structure as S
from ..functions import text as X
from .numbering import number_by_id


def page_chunks(pages: DataFrame) -> DataFrame:
    """One index chunk per non-empty page of a file: heading `Page n`, id ``file:pdf:seq``.

    The pages of one file are numbered in one window; a file is a bounded unit.
    """
    body = X.dehyphenate(X.text_or_empty(F.col("text")))
    filled = pages.select("file_id", "page", body.alias("body")).filter("body <> ''")
    seq = F.row_number().over(Window.partitionBy("file_id").orderBy("page")) - 1
    return filled.select(
        "file_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("heading_path"), "body",
        F.concat("file_id", F.lit(":pdf:"), seq.cast("string")).alias("chunk_id"))


def chunk_blocks(blocks: DataFrame) -> DataFrame:
    """Chunks of extracted blocks (file_id, block_no, text, page, heading ...), tagged and keyworded.

    Other columns of `blocks` are carried along; `seq` orders the chunks of a block.
    """
    cut = blocks.filter(X.strip(X.text_or_empty(F.col("text"))) != "").select(
        "*", F.posexplode(S.pack_paragraphs(F.col("text"))).alias("seq", "chunk")).drop("text")
    text = F.col("chunk.text")
    heading = X.text_or_empty(F.col("heading"))
    return cut.select(
        *[c for c in blocks.columns if c not in ("text", "heading")], heading.alias("section_heading"), "seq",
        text.alias("chunk_text"), F.col("chunk.char_start").alias("char_start"), F.col("chunk.char_end").alias("char_end"),
        K.classify_section(heading, text).alias("brd_section_id"), K.keywords_tf(text).alias("keywords"))


def number_chunks(chunks: DataFrame, existing: DataFrame | None = None, width: int = 100_000) -> DataFrame:
    """Sequential chunk ids per project after the largest existing id.

    `chunks` holds project_id, an integer `block_id` unique within the project,
    and `seq` within the block.  Blocks are numbered by id range, so no project
    passes through one task; `width` ids make a range.
    """
    sizes = chunks.groupBy("project_id", "block_id").agg(F.count("*").alias("_n"))
    firsts = _offsets(sizes, width)
    base = F.lit(0)
    placed = chunks.join(firsts, ["project_id", "block_id"])
    if existing is not None:
        top = existing.groupBy("project_id").agg((F.max("chunk_id") + 1).alias("_base"))
        placed = placed.join(top, "project_id", "left")
        base = F.coalesce("_base", F.lit(0))
    return placed.withColumn("chunk_id", (base + F.col("_before") + F.col("seq")).cast("long")).drop("_before", "_base", "_n")


def _offsets(sizes: DataFrame, width: int = 100_000) -> DataFrame:
    """Rows before each block of a project, by ranges of block ids."""
    ranged = sizes.withColumn("_range", F.floor(F.col("block_id") / width))
    totals = ranged.groupBy("project_id", "_range").agg(F.sum("_n").alias("_t"))
    over_ranges = Window.partitionBy("project_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("project_id", "_range", F.coalesce(F.sum("_t").over(over_ranges), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("project_id", "_range").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return local.join(starts, ["project_id", "_range"]).select(
        "project_id", "block_id", (F.col("_start") + F.col("_local")).alias("_before"))


__all__ = ["page_chunks", "chunk_blocks", "number_chunks", "number_by_id"]
