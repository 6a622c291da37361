"""From ranked hits to a context: expansion, coverage, budgets, citations.

Hits are small (k rows per query); chunk tables are large.  Each operator joins
the small side in, so the chunk table is scanned with only the columns needed
and adaptive execution broadcasts the hits when they are small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .numbering import top_k
from .ranking import best_first, substring_counts, text_fields, title_words


def neighbor_expand(
    anchors: DataFrame, chunks: DataFrame,
    window: int = fixed.NEIGHBOR_WINDOW, cap: int = fixed.MAX_PASSAGES,
) -> DataFrame:
    """Chunks within `window` ids of an anchor, same repository and file.

    A neighbour gets the anchor's score with linear decay, the best over all
    anchors counts, `cap` chunks stay.  Result in reading order: q_id, ref,
    chunk_id, doc_name, score.
    """
    where = chunks.select("chunk_id", "repo_id", "file_id", "doc_name")
    placed = anchors.select("q_id", "chunk_id", "score").join(where.drop("doc_name"), "chunk_id")
    offsets = placed.withColumn("off", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    decay = F.greatest(F.lit(fixed.NEIGHBOR_MIN_FACTOR), 1.0 - fixed.NEIGHBOR_STEP * F.abs("off"))
    reach = offsets.select(
        "q_id", "repo_id", "file_id", (F.col("chunk_id") + F.col("off")).alias("chunk_id"),
        (F.col("score") * F.when(F.col("off") == 0, 1.0).otherwise(decay)).alias("score"))
    best = reach.groupBy("q_id", "repo_id", "file_id", "chunk_id").agg(F.max("score").alias("score"))
    found = best.join(where, ["repo_id", "file_id", "chunk_id"])
    kept = top_k(found, ["q_id"], best_first(), cap)
    reading = Window.partitionBy("q_id").orderBy("doc_name", "chunk_id")
    return kept.select("q_id", F.row_number().over(reading).alias("ref"), "chunk_id", "doc_name", "score")


def context_coverage(queries: DataFrame, passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """q_id, n_terms, n_passages, n_covered, ok for every query.

    `passages` holds at most a few dozen rows per query.
    """
    asked = queries.select("q_id", X.content_terms(F.col("query")).alias("terms"))
    texts = passages.select("q_id", "chunk_id").join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
    hits = texts.join(asked, "q_id").select(
        "q_id", F.filter("terms", lambda t: F.contains(F.lower("chunk_text"), t)).alias("hit"))
    seen = hits.groupBy("q_id").agg(
        F.count("*").alias("n_passages"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("n_covered"))
    joined = asked.join(seen, "q_id", "left").select(
        "q_id", F.size("terms").alias("n_terms"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
    enough = (F.col("n_passages") >= 2) & (F.col("n_covered") >= fixed.COVERAGE_MIN * F.col("n_terms"))
    return joined.withColumn("ok", (F.col("n_terms") == 0) | enough)


def retrieve_widen(queries: DataFrame, anchors: DataFrame, chunks: DataFrame, k: int = fixed.ANCHORS) -> DataFrame:
    """Passages from `k` anchors; where they cover too little, from 2k anchors and a wider window.

    `anchors` is ranked to 2k rows per query.  The wider set replaces the narrow
    one only if it is not smaller.
    """
    narrow = neighbor_expand(anchors.filter(F.col("rn") <= k), chunks)
    wide = neighbor_expand(anchors, chunks, fixed.NEIGHBOR_WINDOW + 2, fixed.MAX_PASSAGES + 6)
    graded = context_coverage(queries, narrow, chunks).select("q_id", "ok", "n_passages")
    wider = wide.groupBy("q_id").agg(F.count("*").alias("n_wide"))
    choice = graded.join(wider, "q_id", "left").select(
        "q_id", (~F.col("ok") & (F.coalesce("n_wide", F.lit(0)) >= F.col("n_passages"))).alias("use_wide"))
    both = narrow.withColumn("wide", F.lit(False)).unionByName(wide.withColumn("wide", F.lit(True)))
    return both.join(choice, "q_id").filter(F.col("wide") == F.col("use_wide")).drop("use_wide")


def sibling_expand(hits: DataFrame, chunks: DataFrame, by_text: bool = False) -> DataFrame:
    """Hits plus every chunk under the same document and heading: q_id, chunk_id, is_hit, rn.

    Blank headings pull nothing in.  With `by_text`, siblings whose first 80
    characters were already seen are dropped.  Hits come first in their order,
    then siblings by id (`rn` orders them, unnumbered: 0-based place of a hit,
    id of a sibling).
    """
    names = chunks.select("chunk_id", "doc_name", "section_heading")
    keys = hits.select("q_id", "chunk_id").join(names, "chunk_id").filter(
        X.strip(F.col("section_heading")) != "").select("q_id", "doc_name", "section_heading").distinct()
    cols = ["chunk_id", "doc_name", "section_heading"] + (["chunk_text"] if by_text else [])
    pulled = chunks.select(*cols).join(keys, ["doc_name", "section_heading"]).select(
        "q_id", "chunk_id", F.lit(1).alias("kind"), F.col("chunk_id").alias("place"),
        *([F.left("chunk_text", F.lit(80)).alias("opening")] if by_text else []))
    own = hits.select("q_id", "chunk_id", F.lit(0).alias("kind"), F.col("rn").cast("long").alias("place"))
    if by_text:
        openings = chunks.select("chunk_id", F.left("chunk_text", F.lit(80)).alias("opening"))
        own = own.join(openings, "chunk_id")
    merged = own.unionByName(pulled).groupBy("q_id", "chunk_id", *(["opening"] if by_text else [])).agg(
        F.min(F.struct("kind", "place")).alias("first"))
    if by_text:
        firsts = merged.filter("first.kind = 1").groupBy("q_id", "opening").agg(
            F.min(F.struct("first", "chunk_id")).alias("pick")).select("q_id", "opening", F.col("pick.chunk_id").alias("chunk_id"), F.col("pick.first").alias("first"))
        seen = merged.filter("first.kind = 0").select("q_id", "opening").distinct()
        fresh = firsts.join(seen, ["q_id", "opening"], "left_anti")
        merged = merged.filter("first.kind = 0").unionByName(fresh)
    return merged.select(
        "q_id", "chunk_id", (F.col("first.kind") == 0).alias("is_hit"), F.col("first.place").alias("place"))


def cap_context(hits: DataFrame, order: list[Column], max_hits: int = 24, max_chars: int = 24_000) -> DataFrame:
    """First `max_hits` rows within `max_chars`; the row that overflows is cut if 200 characters remain."""
    first = top_k(hits, ["q_id"], order, max_hits)
    before = Window.partitionBy("q_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("snippet")
    used = first.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0)))
    fits = F.col("used") + size <= max_chars
    cut = (F.lit(max_chars) - F.col("used") >= 200) & ~fits
    return used.filter(fits | cut).withColumn(
        "snippet", F.when(fits, F.col("snippet")).otherwise(
            F.left("snippet", F.greatest(F.lit(0), max_chars - F.col("used")).cast("int")))).drop("used")


def pinned_context(pins: DataFrame, chunks: DataFrame, chars: int = 1200) -> DataFrame:
    """Chunks pinned by id (q_id, pinned array) in pin order, then their siblings, cut to `chars`."""
    placed = pins.select("q_id", F.posexplode("pinned").alias("rn", "chunk_id"))
    first = placed.groupBy("q_id", "chunk_id").agg(F.min("rn").alias("rn")).join(
        chunks.select("chunk_id"), "chunk_id", "left_semi")
    grown = sibling_expand(first, chunks)
    texts = chunks.select("chunk_id", "doc_name", "section_heading", F.left("chunk_text", F.lit(chars)).alias("snippet"))
    return cap_context(grown.join(texts, "chunk_id"), [F.col("is_hit").desc(), F.col("place")])


def citations(passages: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One citation per passage whose number the answer uses."""
    used = answers.select("q_id", F.explode(X.citation_refs(F.col("answer"))).alias("ref")).distinct()
    meta = chunks.select("chunk_id", "section_heading", "page_number", "chunk_text")
    return passages.join(used, ["q_id", "ref"], "left_semi").join(meta, "chunk_id").select(
        "q_id", "ref", "chunk_id",
        F.when(X.text_or_empty(F.col("doc_name")) == "", "Unknown document").otherwise(F.col("doc_name")).alias("doc_name"),
        X.text_or_empty(F.col("section_heading")).alias("heading"), F.col("page_number").alias("page"),
        F.left(X.strip(F.col("chunk_text")), F.lit(240)).alias("snippet"), F.round("score", 4).alias("score"))


def source_docs(passages: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct documents of the passages by best score."""
    best = passages.filter(X.strip(F.col("doc_name")) != "").groupBy("q_id", "doc_name").agg(
        F.max("score").alias("score"), F.min("ref").alias("first_ref"))
    return top_k(best, ["q_id"], best_first("score", "first_ref"), limit).select("q_id", "rn", "doc_name")


def ancestors(section_id: Column) -> Column:
    """The id itself and every dotted prefix of it."""
    parts = F.split(section_id, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def blend_rank(
    sections: DataFrame, chunks: DataFrame, similarity: DataFrame | None = None, mapped: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """Blend of word hits, similarity, mapped picks and section tags per (section, chunk).

    Each signal adds points for the pairs it knows; pairs without any signal
    score zero and are not listed.  `sections` holds section_id and `words`
    (title and parent title); `similarity` and `mapped` hold section_id,
    chunk_id (and score).
    """
    words = sections.select("section_id", F.explode(title_words(F.col("words"))).alias("term"))
    counts = substring_counts(chunks, text_fields("text", "kws", "head", "doc"), words)

    def hit(name: str) -> Column:
        return (F.col(name) > 0).cast("double")

    plain = 3 * hit("head") + 2 * hit("kws") + hit("text")
    searched = (~F.col("term").isin(fixed.BLEND_STOP)).cast("double") * (10 * hit("doc") + plain)
    points = words.join(counts, "term").groupBy("section_id", "chunk_id").agg(
        F.sum(searched + plain + 5 * hit("head")).alias("points"))
    parts = [points]
    if similarity is not None:
        parts.append(similarity.filter("score > 0").select("section_id", "chunk_id", (F.col("score") * 40.0).alias("points")))
    if mapped is not None:
        parts.append(mapped.select("section_id", "chunk_id").distinct().withColumn("points", F.lit(50.0)))
    tagged = chunks.filter(X.strip(F.col("brd_section_id")) != "").select("chunk_id", X.strip(F.col("brd_section_id")).alias("tag"))
    below = sections.select("section_id", F.explode(ancestors(F.col("section_id"))).alias("tag"))
    above = tagged.select("chunk_id", "tag", F.explode(ancestors(F.col("tag"))).alias("section_id")).filter("tag <> section_id")
    on_path = tagged.join(below, "tag").select("section_id", "chunk_id").unionByName(
        above.join(sections.select("section_id").distinct(), "section_id").select("section_id", "chunk_id"))
    parts.append(on_path.withColumn("points", F.lit(15.0)))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    scored = pairs.groupBy("section_id", "chunk_id").agg(F.round(F.sum("points"), 4).alias("score"))
    if k is None:
        return scored
    names = chunks.select("chunk_id", "doc_name", F.coalesce("page_number", F.lit(0)).alias("page"))
    order = [F.col("score").desc(), F.col("doc_name"), F.col("page"), F.col("chunk_id")]
    return top_k(scored.join(names, "chunk_id"), ["section_id"], order, k).drop("doc_name", "page")


def section_candidates(scores: DataFrame, sections: DataFrame, k: int, enough: int = 4) -> DataFrame:
    """The ranked candidates that `cross_section_dedupe` can come to: the best k * (j + 1) + `enough` of the j-th section.

    Earlier sections use at most k * j chunks, so these hold the k best unused ones, and `enough` unused ones
    whenever the whole pool does.  `scores`: project_id, section_id, chunk_id, score; `sections`: project_id,
    section_id, ord.  The longest section list, one number, is counted first: it bounds what a task keeps per section.
    """
    place = Window.partitionBy("project_id").orderBy("ord", "section_id")
    placed = sections.select("project_id", "section_id", "ord", F.row_number().over(place).alias("_j"))
    longest = placed.agg(F.coalesce(F.max("_j"), F.lit(1))).first()[0]
    best = top_k(scores, ["project_id", "section_id"], best_first(), k * longest + enough)
    return best.join(placed, ["project_id", "section_id"]).filter(F.col("rn") <= k * F.col("_j") + enough).drop("_j")


def cross_section_dedupe(hits: DataFrame, k: int, enough: int = 4) -> DataFrame:
    """Walk a project's sections in order; chunks used by earlier ones are skipped.

    `hits` holds project_id, ord, section_id, chunk_id, rn (see `section_candidates`).
    A section keeps its full list when fewer than `enough` unused candidates stay.
    The walk is order dependent, so it is a fold over the project's sections; only
    ids enter the fold, and its state ends with the project.
    """
    lists = hits.groupBy("project_id", "ord", "section_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "chunk_id"))), lambda h: h["chunk_id"]).alias("ids"))
    walk = lists.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section_id", "ids"))).alias("steps"))
    start = F.struct(
        F.array().cast("array<bigint>").alias("used"),
        F.array().cast("array<struct<section_id:string,ids:array<bigint>>>").alias("kept"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.array_except(s["ids"], state["used"])
        taken = F.slice(F.when(F.size(fresh) >= enough, fresh).otherwise(s["ids"]), 1, k)
        return F.struct(
            F.concat(state["used"], taken).alias("used"),
            F.concat(state["kept"], F.array(F.struct(s["section_id"].alias("section_id"), taken.alias("ids")))).alias("kept"))

    folded = walk.select("project_id", F.explode(F.aggregate("steps", start, step, lambda s: s["kept"])).alias("s"))
    return folded.select("project_id", "s.section_id", F.posexplode("s.ids").alias("pos", "chunk_id")).select(
        "project_id", "section_id", (F.col("pos") + 1).alias("rn"), "chunk_id")


def fact_candidates(chunks: DataFrame, limit: int = 60) -> DataFrame:
    """Passages worth reading for facts: dated ones, probe hits in turn, opening ones; unique, first `limit`."""
    first_ids = [F.col("chunk_id")]
    dated = top_k(chunks.filter(F.col("chunk_text").rlike(X.uni(fixed.HARD_SIGNAL))).select("project_id", "chunk_id"),
                  ["project_id"], first_ids, limit)
    probes = F.array(*[X.token_set(F.lit(p)) for p in fixed.FACT_PROBES])
    spark = chunks.sparkSession
    terms = spark.range(1).select(F.posexplode(probes).alias("probe", "q")).select(
        "probe", F.size("q").alias("q_size"), F.explode("q").alias("term"))
    blob = F.concat_ws(" ", "chunk_text", "section_heading", "doc_name")
    held = chunks.select("project_id", "chunk_id", F.explode(X.token_set(blob)).alias("term"))
    scores = held.join(F.broadcast(terms), "term").groupBy("project_id", "probe", "chunk_id").agg(
        (F.count("*") / F.sqrt(F.max("q_size"))).alias("score"))
    probed = top_k(scores, ["project_id", "probe"], best_first(), 6)
    opening = top_k(chunks.select("project_id", "chunk_id"), ["project_id"], first_ids, 5)
    seats = (
        dated.select("project_id", "chunk_id", F.struct(F.lit(1).alias("turn"), F.col("rn").alias("a"), F.lit(0).alias("b")).alias("seat"))
        .unionByName(probed.select("project_id", "chunk_id", F.struct(F.lit(2).alias("turn"), F.col("rn").alias("a"), F.col("probe").alias("b")).alias("seat")))
        .unionByName(opening.select("project_id", "chunk_id", F.struct(F.lit(3).alias("turn"), F.col("rn").alias("a"), F.lit(0).alias("b")).alias("seat")))
    )
    once = seats.groupBy("project_id", "chunk_id").agg(F.min("seat").alias("seat"))
    return top_k(once, ["project_id"], [F.col("seat")], limit).select("project_id", "rn", "chunk_id", F.col("seat.turn").alias("turn"))
