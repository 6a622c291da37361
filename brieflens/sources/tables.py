"""Readers for the parquet tables, and the logical tables built on them.

Every logical table is a projection of a physical one, so filters and column
pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import keywords as K

DOC_SUFFIXES = ["-solution.docx", "-draft.docx", "-template.docx", ".pdf", "-user stories.docx", "-wip.docx", ".docx"]
TAG_WORDS = ["introduction scope", "kpi", "", "demand planning", "supply planning interface",
             "architecture etl middleware", "net off", "sites"]
QUERY_EXTRAS = [" forecast interface", " sop constraints", "", " show me the go-live diagram"]


LONG_ROWS = {"documents": "doc_id", "pages": "page_id"}  # tables whose rows are long texts
INPUT_PARTITIONS = "spark.brieflens.inputPartitions"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split.

    A small parquet file of one row group is read by one task.  Where that is
    the case, as in local tests and benches, the session may name a number of
    partitions to deal long texts out to; unset, as on a cluster, nothing is shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, "") if name in LONG_ROWS else ""
    return df.repartition(int(parts), LONG_ROWS[name]) if parts else df


def pick(index, values: list[str]):
    """The value at position `index` of a constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a chunk table: twenty consecutive ids make one file."""
    file_no = F.expr("doc_id div 20")
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("p"), (file_no % 10).cast("string")).alias("project_id"),
        F.concat(F.lit("r"), F.expr("doc_id div 100 % 4").cast("string")).alias("repo_id"),
        F.concat(F.lit("f"), file_no.cast("string")).alias("file_id"),
        F.concat(F.lit("F"), file_no.cast("string"), pick(file_no % 7, DOC_SUFFIXES)).alias("doc_name"),
        F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("page_number"),
        F.regexp_extract("text", r"^([^\s.,|]+)", 1).alias("section_heading"),
        F.col("text").alias("chunk_text"),
    )


def keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chunks` with term-frequency keywords and a section tag."""
    text = F.col("chunk_text")
    return chunks(spark, sf_dir).withColumns({
        "keywords": K.keywords_tf(text),
        "brd_section_id": K.classify_section(F.concat_ws(" ", "section_heading", pick(F.col("chunk_id") % 8, TAG_WORDS)), text),
    })


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chunks` with the vector of the same id; the others have none."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunks(spark, sf_dir).join(vectors, "chunk_id", "left")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of query i is embedding i."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"))
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q_id"), "embedding")
    return items.join(vectors, "q_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section list per project: five items make one top section and its children."""
    item = F.col("item_id")
    top = F.expr("item_id div 5 + 1").cast("string")
    sid = F.when(item % 5 == 0, top).otherwise(F.concat(top, F.lit("."), (item % 5).cast("string")))
    return load(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("p"), F.expr("item_id div 5 % 10").cast("string")).alias("project_id"),
        item.alias("ord"), sid.alias("section_id"),
        F.col("text").alias("title"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`benchmark` items as questions, some with vocabulary that has synonyms."""
    item = F.col("item_id")
    return load(spark, sf_dir, "benchmark").select(
        item.alias("q_id"),
        F.concat(F.col("text"), pick(item % 4, QUERY_EXTRAS)).alias("query"),
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with citations, locators, image tags and untidy spacing added."""
    n = F.col("doc_id")
    text = F.col("text")
    text = F.replace(text, F.lit(". "), F.concat(F.lit(" ["), (n % 9).cast("string"), F.lit("] .\r\n\n\n ")))
    text = F.replace(text, F.lit(", "), F.concat(F.lit(" ["), (n % 4 + 3).cast("string"), F.lit("],  (page "), (n % 13).cast("string"), F.lit(") \t")))
    text = F.concat(
        F.lit("Slide "), (n % 50).cast("string"), F.lit(". [Source: deck] "), text,
        F.lit(' < Image ID = \'ab'), n.cast("string"), F.lit("' > on page 3 <IMAGE id=\"x"), (n % 10).cast("string"), F.lit('"/>-\nend '),
    )
    return load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


SENTENCE_BREAK = r"\. |\n"


def draft_text(text, doc_id):
    """A document as a markdown draft: numbered headings, prose, table rows, bold labels."""
    def line(x, i):
        n = F.floor(i / 6).cast("string")
        up = (F.floor(i / 6) + 1).cast("string")
        return (
            F.when(i % 6 == 0, F.concat(F.lit("## "), up, F.lit(" "), x))
            .when(i % 6 == 1, x)
            .when(i % 6 == 2, F.concat(F.lit("| "), x, F.lit(" | "), doc_id.cast("string"), F.lit(" |")))
            .when(i % 6 == 3, F.lit("| --- | :--: |"))
            .when(i % 6 == 4, F.concat(F.lit("|"), x, F.lit("|<information not available "), n, F.lit(">|")))
            .when(i % 12 == 5, F.concat(F.lit("**"), x, F.lit("**")))
            .otherwise(F.concat(up, F.lit("."), n, F.lit(". "), x))
        )

    return F.array_join(F.transform(F.split(text, SENTENCE_BREAK), line), "\n")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown draft per document."""
    return load(spark, sf_dir, "documents").select("doc_id", draft_text(F.col("text"), F.col("doc_id")).alias("text"))


def html_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as HTML: headings, paragraphs, lists, tables, images, entities."""
    def line(x, i):
        return (
            F.when(i % 5 == 0, F.concat(F.lit('<h2 class="a">'), x, F.lit("</h2>")))
            .when(i % 5 == 1, F.concat(F.lit("<p>"), x, F.lit("</p>")))
            .when(i % 5 == 2, F.concat(F.lit("<ul><li> "), x, F.lit("</li></ul>")))
            .when(i % 5 == 3, F.concat(F.lit("<TABLE><tr><th> <b>"), x, F.lit("</b></th><th>b</th></tr><tr><td>"),
                                       i.cast("string"), F.lit("</td></tr></table>")))
            .otherwise(F.concat(F.lit('<IMAGE id="'), i.cast("string"), F.lit('"/> &lt;'), x, F.lit("&gt; &amp;")))
        )

    text = F.array_join(F.transform(F.split("text", SENTENCE_BREAK), line), "\n")
    return load(spark, sf_dir, "documents").select("doc_id", text.alias("html"))


def criteria(spark: SparkSession) -> DataFrame:
    """The rubric as a table: category_no, criterion_id, weight."""
    rows = [(no, f"{no}.{i}", weight) for no, (n, weight) in enumerate(fixed.RUBRIC, 1) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "category_no int, criterion_id string, weight double")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels` as criterion ratings: 57 documents make one project."""
    n = F.col("doc_id")
    ids = [f"{no}.{i}" for no, (k, _) in enumerate(fixed.RUBRIC, 1) for i in range(1, k + 1)]
    rating = (
        F.when((F.col("toxic") == 1) | (n % 57).between(11, 14) & (F.expr("doc_id div 57") % 3 == 0), "n/a")
        .when((F.col("quality") == 1) & (n % 2 == 0), "✅ Best Practice").when(F.col("quality") == 1, " minimally meets ")
        .when(n % 7 == 0, "Excellent").otherwise("❌ Does Not Meet"))
    return load(spark, sf_dir, "labels").select(
        F.concat(F.lit("p"), F.expr("doc_id div 57").cast("string")).alias("project_id"),
        pick(n % 57, ids).alias("criterion_id"), rating.alias("rating"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three verdicts per label row, one per part of a split deck, with citations."""
    n = F.col("doc_id")
    ids = [f"{no}.{i}" for no, (k, _) in enumerate(fixed.RUBRIC, 1) for i in range(1, k + 1)] + ["99.1"]
    part = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part")
    rows = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", part)
    p = F.col("part")
    return rows.select(
        F.concat(F.lit("p"), F.expr("doc_id div 58").cast("string")).alias("project_id"),
        pick(n % 58, ids).alias("criterion_id"), p.cast("int").alias("part"),
        pick((n + p * F.col("quality")) % 5, ["Not Applicable", "Does Not Meet", "❌ does not meet", "Best Practice", "Excellent"]).alias("rating"),
        pick(n % 3, ["HIGH", "extremely sure", "low"]).alias("confidence"),
        pick(n % 4, ["found", "Absent", "maybe", "unassessable"]).alias("evidence_status"),
        F.array(
            F.struct(pick((n + p) % 3, ["Deck.pptx", "deck.PPTX", "Other"]).alias("doc"), ((n + p) % 50).cast("int").alias("slide")),
            F.struct(F.lit("Deck.pptx").alias("doc"), ((n * p) % 45).cast("int").alias("slide"))).alias("slides"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company per document: a long word of its text, half of them with a suffix."""
    n = F.col("doc_id")
    word = F.regexp_extract("text", "([A-Za-z]{7,12})", 1)
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), n.cast("string")).alias("project_id"),
        F.when(word == "", "").when(n % 4 == 0, F.concat(word, F.lit(" and"))).otherwise(word).alias("company"))


def approved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the approved text of section 1 of its own project."""
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("project_id"), F.lit("1").alias("section_id"),
        F.col("text").alias("content"))


DIAGRAM_TYPES = ["flowchart", "logo", "chart", "screenshot", "", "other", "timeline", "photo"]
CAPTION_HEADS = ["Architecture of ", "Company logo ", "Flow: ", "", "Badge "]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image record per document: exact copies of a text share the image id."""
    n = F.col("doc_id")
    file_no = F.expr("doc_id div 20")
    caption = F.when(n % 5 == 3, F.left(F.sha2("text", 256), F.lit(12))).otherwise(
        F.concat(pick(n % 5, CAPTION_HEADS), "text"))
    keywords = F.when(n % 9 == 4, F.array().cast("array<string>")).otherwise(F.slice(K.keywords_tf(F.col("text")), 1, 5))
    return load(spark, sf_dir, "documents").select(
        n.alias("row_id"), F.when(n % 50 == 49, "").otherwise(F.left(F.sha2("text", 256), F.lit(12))).alias("image_id"),
        F.concat(F.lit("F"), file_no.cast("string"), pick(file_no % 7, DOC_SUFFIXES)).alias("source_doc"),
        F.nullif(n % 7, F.lit(0)).alias("page_number"), caption.alias("caption"), keywords.alias("keywords"),
        pick(n % 8, DIAGRAM_TYPES).alias("diagram_type"), pick(n % 4, ["unknown", "4 Demand", "6", ""]).alias("section_hint"),
        F.when(n % 6 == 0, "3.2 Sites").when(n % 6 == 1, "unknown").otherwise(F.regexp_extract("text", r"^([^\s.,|]+)", 1)).alias("section_heading"),
        F.col("text").alias("description"), pick(n % 3, ["", "4", "6"]).alias("brd_section_id"),
        F.array(F.col("lang"), F.concat(F.lit("Tag"), (n % 10).cast("string"))).alias("tags"),
        F.when(n % 11 == 0, "slide").otherwise("picture").alias("render_kind"),
        F.concat(F.lit("lib"), (n % 3).cast("string")).alias("image_repo_id"))
