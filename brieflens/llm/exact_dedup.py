"""Exact duplicates: 128-bit content hash, smallest id stays, bytes compared inside groups.

Plan: narrow rows (hash, id) are grouped first, so a text travels only where a
hash occurs twice.  The texts of those rows are grouped by their bytes, which
separates texts that merely share a hash.  Every grouping has a map-side part,
so a group that holds a third of all rows reaches a reducer as one row per map
task; the semi-join that picks the texts is salted.

Cases: a null text is an empty text; a null id counts as the largest id of its
group; rows that repeat both id and text are one document (`decisions` gives
one row and counts each in `group_size`; `survivors` keeps one of them); an
empty table gives an empty result; other columns are carried by `survivors`
under their own names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, whole_text

SALTS = 16


def normalised(column: str) -> Column:
    """The text with each run of white space (space, tab to carriage return) as one space."""
    return F.regexp_replace(whole_text(column), SPACES, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              digest: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copies (rows with this id and text)."""
    norm = normalised(text_col)
    ident = F.col(id_col)
    narrow = (docs.select(ident.alias("doc_id"), digest(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("sha"))
              .groupBy("h", "sha", "doc_id").agg(F.count("*").alias("copies")))
    repeated = (narrow.groupBy("h").agg(F.sum("copies").alias("rows")).filter("rows > 1")
                .select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    texts = docs.select(ident.alias("doc_id"), norm.alias("norm"), digest(norm).alias("h"),
                        F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int").alias("salt"))
    by_bytes = (texts.join(repeated, ["h", "salt"], "left_semi").groupBy("h", "norm")
                .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"),
                     F.count("*").alias("size"))
                .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "first", "size"))
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return narrow.join(by_bytes, ["h", "sha"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", "copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), "copies")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of `docs`."""
    sha, key, nth = (free_name(docs.columns, x) for x in ("text_sha256", "kept_id", "nth_row"))
    kept = decisions(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias(key), F.col("text_sha256").alias(sha + "_kept"))
    rows = docs.withColumn(sha, F.sha2(normalised(text_col).cast("binary"), 256))
    joined = rows.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(sha + "_kept")))
    one = Window.partitionBy(id_col, sha).orderBy(F.xxhash64(*docs.columns))
    return joined.withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).select(*docs.columns)
