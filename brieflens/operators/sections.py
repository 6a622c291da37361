"""Section lists joined with their saved, approved and imported texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import markdown as M
from ..functions import structure as S
from ..functions import text as X
from ..functions.similarity import line_diff, seq_ratio
from .context import ancestors
from .numbering import top_k

KEY = ["project_id", "section_id"]


def is_top_level(section_id: Column) -> Column:
    return ~F.contains(section_id, F.lit("."))


def families(sections: DataFrame) -> DataFrame:
    """project_id, parent_id, section_id, ord: each section under itself and every ancestor listed."""
    under = sections.select("project_id", F.explode(ancestors(F.col("section_id"))).alias("parent_id"), "section_id", "ord")
    listed = sections.select("project_id", F.col("section_id").alias("parent_id"))
    return under.join(listed, ["project_id", "parent_id"], "left_semi")


def draftable_blocks(sections: DataFrame) -> DataFrame:
    """Families without a parent that only groups children and has no text of its own."""
    family = families(sections)
    sizes = family.groupBy("project_id", "parent_id").agg(F.count("*").alias("_n"))
    own = sections.select("project_id", F.col("section_id").alias("parent_id"), F.coalesce("has_own_content", F.lit(True)).alias("_own"))
    joined = family.join(sizes, ["project_id", "parent_id"]).join(own, ["project_id", "parent_id"])
    empty_parent = (F.col("section_id") == F.col("parent_id")) & ~F.col("_own") & (F.col("_n") > 1)
    return joined.filter(~empty_parent).drop("_n", "_own")


def section_status(sections: DataFrame, approved: DataFrame, state: DataFrame) -> DataFrame:
    """Top sections: generated if every block is approved, in-progress if a draft exists."""
    done = approved.select(*KEY, F.lit(True).alias("_ok")).distinct()
    blocks = draftable_blocks(sections).join(done, KEY, "left").groupBy("project_id", "parent_id").agg(
        F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all"))
    members = families(sections).groupBy("project_id", "parent_id").agg((F.count("*") - 1).alias("child_count"))
    drafts = state.select("project_id", F.col("section_id").alias("parent_id"), (X.text_or_empty(F.col("draft_content")) != "").alias("_draft"))
    top = sections.filter(is_top_level(F.col("section_id"))).select("project_id", F.col("section_id").alias("parent_id"), "ord", "title")
    keys = ["project_id", "parent_id"]
    rows = top.join(blocks, keys, "left").join(members, keys, "left").join(drafts, keys, "left")
    status = F.when(F.col("_all"), "generated").when(F.col("_draft"), "in-progress").otherwise("not-started")
    return rows.select("project_id", F.col("parent_id").alias("section_id"), "ord", "title", status.alias("status"), "child_count")


def select_sections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exactly the listed ids, with the key that orders them numerically."""
    return sections.join(wanted, KEY, "left_semi").withColumn("sort_key", X.section_sort_key(F.col("section_id")))


def join_titles(defaults: DataFrame, sections: DataFrame) -> DataFrame:
    """Built-in titles, overridden by a section's own non-blank title."""
    own = sections.filter(X.strip(F.col("title")) != "").select(*KEY, X.strip(F.col("title")).alias("_title"))
    builtin = defaults.agg(F.collect_list(F.struct("section_id", "title"))).scalar()
    grid = sections.select("project_id").distinct().withColumn("d", F.explode(builtin)).select(
        "project_id", "d.section_id", "d.title")
    return grid.join(own, KEY, "full_outer").select(*KEY, F.coalesce("_title", "title").alias("title"))


def enrich_sections(sections: DataFrame, state: DataFrame, computed: DataFrame) -> DataFrame:
    """Left join of saved state: user edits beat recomputed keywords, which beat saved ones."""
    none = F.array().cast("array<string>")
    saved = state.select(*KEY, F.col("doc_keywords").alias("_doc"), F.col("web_keywords").alias("_web"), "user_edited", "status", "prompt")
    fresh = computed.select(*KEY, F.col("doc_keywords").alias("_new_doc"), F.col("web_keywords").alias("_new_web"))
    rows = sections.select(*KEY, "title").join(saved, KEY, "left").join(fresh, KEY, "left")
    edited = F.coalesce("user_edited", F.lit(False))
    doc = (F.when(edited & F.col("_doc").isNotNull(), F.col("_doc"))
           .when(F.size(F.coalesce("_new_doc", none)) > 0, F.col("_new_doc")).otherwise(F.coalesce("_doc", none)))
    return rows.select(
        *KEY, "title", doc.alias("doc_keywords"), F.coalesce("_web", "_new_web", none).alias("web_keywords"),
        edited.alias("user_edited"), F.coalesce("status", F.lit("not-started")).alias("status"), X.text_or_empty(F.col("prompt")).alias("prompt"))


def ordered_approved(sections: DataFrame, approved: DataFrame) -> DataFrame:
    filled = approved.filter(X.text_or_empty(F.col("content")) != "").select(*KEY, "content")
    return sections.select(*KEY, "ord", "title").join(filled, KEY)


def all_with_status(sections: DataFrame, approved: DataFrame) -> DataFrame:
    return sections.select(*KEY, "ord", "title", F.coalesce("has_own_content", F.lit(True)).alias("has_own_content")).join(
        approved.select(*KEY, "content"), KEY, "left")


def review_sections(sections: DataFrame, approved: DataFrame, state: DataFrame) -> DataFrame:
    """Approved text, else the part of the parent's draft under the section's marker.

    A draft without any marker stays whole on its parent.
    """
    blocks = draftable_blocks(sections)
    lists = blocks.groupBy("project_id", "parent_id").agg(F.collect_list("section_id").alias("ids"))
    drafts = state.filter(X.text_or_empty(F.col("draft_content")) != "").select(
        "project_id", F.col("section_id").alias("parent_id"), "draft_content").join(lists, ["project_id", "parent_id"])
    whole = F.array(F.struct(F.col("parent_id").alias("id"), F.col("draft_content").alias("content")))
    split = S.split_marked(F.col("draft_content"), F.col("ids"))
    pieces = drafts.withColumn("_parts", split).select(
        "project_id", "parent_id",
        F.explode(F.when((F.size("ids") > 1) & (F.size("_parts") > 0), F.col("_parts")).otherwise(whole)).alias("p"))
    # a section drafted under several parents takes the text of the outermost
    pieces = pieces.groupBy("project_id", F.col("p.id").alias("section_id")).agg(
        F.min_by("p.content", F.struct(F.size(F.split("parent_id", r"\.")), "parent_id")).alias("_draft"))
    rows = all_with_status(sections, approved).join(pieces, KEY, "left")
    lacking = X.strip(X.text_or_empty(F.col("content"))) == ""
    use = lacking & F.col("_draft").isNotNull()
    return rows.select(*KEY, "ord", "title", "has_own_content", F.when(use, F.col("_draft")).otherwise(F.col("content")).alias("content"),
                       use.alias("content_is_draft"))


def prior_context(sections: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved sections before each one, joined in order; a project's list is one document."""
    rows = sections.select(*KEY, "ord", "title").join(approved.select(*KEY, "content"), KEY, "left")
    block = F.when(X.text_or_empty(F.col("content")) != "", F.concat(
        F.lit("### "), "title", F.lit(" (already approved)\n"), "content"))
    before = Window.partitionBy("project_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*KEY, F.array_join(F.collect_list(block).over(before), "\n\n").alias("prior"))


def story_text(sections: DataFrame, approved: DataFrame, limit: int = 20_000) -> DataFrame:
    """Approved sections of a project as one text in id order, cut at `limit` characters."""
    titles = sections.select(*KEY, "title")
    filled = approved.select(*KEY, X.strip(X.text_or_empty(F.col("content"))).alias("content")).filter("content <> ''")
    rows = filled.join(titles, KEY, "left")
    part = F.concat(F.lit("## Section "), "section_id", F.lit(": "), F.coalesce("title", F.concat(F.lit("Section "), "section_id")),
                    F.lit("\n"), "content")
    joined = rows.groupBy("project_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(X.section_sort_key(F.col("section_id")).alias("k"), part.alias("part")))),
        lambda r: r["part"]), "\n\n").alias("text"))
    return joined.select("project_id", F.when(F.length("text") > limit, F.concat(
        F.left("text", F.lit(limit)), F.lit("\n\n[... content truncated ...]"))).otherwise(F.col("text")).alias("text"))


def client_name(projects: DataFrame, supplied: DataFrame, context: DataFrame) -> DataFrame:
    """Company per project: supplied, the project's context, its client, its name; never another project's."""
    def filled(c: Column) -> Column:
        return F.nullif(X.strip(X.text_or_empty(c)), F.lit(""))

    rows = projects.join(supplied.select("project_id", F.col("company").alias("_a")), "project_id", "left").join(
        context.select("project_id", F.col("company").alias("_b")), "project_id", "left")
    client = F.when(F.lower(filled(F.col("client"))) != "no description", filled(F.col("client")))
    return rows.select("project_id", F.coalesce(
        filled(F.col("_a")), filled(F.col("_b")), client, filled(F.col("name")), F.lit("")).alias("company"))


# ---------------------------------------------------------------- imports

def heading_keys(sections: DataFrame) -> DataFrame:
    """Normalised title -> section per project; the last section of a title counts."""
    keyed = sections.select("project_id", X.norm_alnum_title(F.col("title")).alias("key"), "section_id", "ord").filter("key <> ''")
    return keyed.groupBy("project_id", "key").agg(F.max_by("section_id", "ord").alias("by_title"))


def titles_agree(expected: Column, incoming: Column) -> Column:
    """Equal, contained, or equal up to filler words (null-safe: missing titles disagree)."""
    fillers = F.array(*[F.lit(w) for w in fixed.TITLE_FILLERS])
    a, b = F.array_except(F.split(expected, " "), fillers), F.array_except(F.split(incoming, " "), fillers)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    subset = some & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    named = (expected != "") & (incoming != "")
    return F.coalesce(named & (F.contains(expected, incoming) | F.contains(incoming, expected) | subset), F.lit(False))


def match_import_headings(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Section a line of an imported file opens: an id, ``__UNMATCHED__``, or null for body text.

    `lines`: project_id, line_no, style, text.  Number and title are matched by
    equi-joins; similarity is computed only where both exist and disagree.
    """
    ids = sections.select("project_id", F.col("section_id").alias("num"), X.norm_alnum_title(F.col("title")).alias("expected"))
    head = S.detect_heading(F.col("text"))
    style = F.lower(X.text_or_empty(F.col("style")))
    parsed = lines.withColumn("h", F.when(~S.is_toc_line(F.col("text"), F.col("style")), head)).withColumns({
        "num": F.col("h.id"), "key": X.norm_alnum_title(F.coalesce(F.col("h.title"), F.col("text"))),
        "title": F.coalesce(F.col("h.title"), F.lit(""))})
    rows = parsed.join(ids, ["project_id", "num"], "left").join(heading_keys(sections), ["project_id", "key"], "left")
    close = titles_agree(F.col("expected"), F.col("key"))
    both = F.col("expected").isNotNull() & (F.col("expected") != "") & (F.col("key") != "") & ~close
    rows = rows.withColumn("_sure", close).withColumn(
        "_near", F.when(both, seq_ratio(F.when(both, F.col("expected")), F.when(both, F.col("key"))) >= 0.8).otherwise(False))
    agrees = F.col("_sure") | F.col("_near")
    looks = (F.col("h.kind") == "section") | F.contains(style, F.lit("heading")) | S.headingish(F.col("title"))
    known = F.col("expected").isNotNull()
    numbered = (
        F.when(known & agrees, F.col("num"))
        .when(known & (F.col("title") == ""), F.when(looks, F.col("num")))
        .when(known & ~looks, F.lit(None))
        .when(known & F.col("by_title").isNotNull() & (F.col("by_title") != F.col("num")), F.col("by_title"))
        .when(known, "__UNMATCHED__")
        .when(looks & (F.col("title") != "") & F.col("by_title").isNotNull(), F.col("by_title"))
        .when(looks, "__UNMATCHED__"))
    plain = F.when(~F.contains(style, F.lit("list")) & ~S.is_toc_line(F.col("text"), F.col("style")) & (
        F.contains(style, F.lit("heading")) | (F.length(X.strip(F.col("text"))) >= 4)), F.col("by_title"))
    return rows.select("project_id", "line_no", "text", F.when(F.col("h").isNotNull(), numbered).otherwise(plain).alias("section_id"))


def fuzzy_suggest(headings: DataFrame, sections: DataFrame, threshold: float = 0.45, k: int = 3) -> DataFrame:
    """Top `k` section titles of the same project per unmatched heading.

    A project's section list is short; headings meet only their own project's titles.
    """
    pairs = headings.select("project_id", "line_no", "text").join(sections.select("project_id", "section_id", "title", "ord"), "project_id")
    scored = pairs.withColumn("score", F.round(seq_ratio(F.lower(X.strip(F.col("text"))), F.lower(X.strip(F.col("title")))), 2))
    return top_k(scored.filter(F.col("score") >= threshold), ["project_id", "line_no"],
                 [F.col("score").desc(), F.col("ord")], k).select("project_id", "line_no", "text", "rn", "section_id", "title", "score")


def import_preview(incoming: DataFrame, sections: DataFrame, approved: DataFrame) -> DataFrame:
    """Imported sections beside the current text: sizes and previews."""
    current = approved.select(*KEY, F.col("content").alias("_cur"))
    rows = incoming.join(sections.select(*KEY, "title"), KEY, "left").join(current, KEY, "left")
    has = X.text_or_empty(F.col("_cur")) != ""
    return rows.select(
        *KEY, X.text_or_empty(F.col("title")).alias("title"), F.length(X.text_or_empty(F.col("content"))).alias("chars"),
        X.content_preview(F.col("content"), 700).alias("preview"), has.alias("has_current"),
        F.when(has, X.content_preview(F.col("_cur"), 700)).otherwise("").alias("current_preview"))


def clean_import(incoming: DataFrame, sections: DataFrame) -> DataFrame:
    """Imported texts without markup and headings the template already supplies; empties dropped."""
    ids = sections.groupBy("project_id").agg(F.collect_set("section_id").alias("_ids"))
    rows = incoming.join(ids, "project_id", "left").filter(X.strip(X.text_or_empty(F.col("content"))) != "")
    known = F.coalesce("_ids", F.array().cast("array<string>"))
    bare = M.strip_redundant_headers(M.strip_html(X.strip(F.col("content"))), F.col("section_id"))
    # kept by an explode: a filter would be moved below and clean every text a second time
    kept = F.filter(F.array(M.strip_invented_headings(bare, known)), lambda c: c != "")
    return rows.select(*KEY, F.explode(kept).alias("content"))


def apply_import(store: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """Upsert of cleaned texts; `replace` drops what was stored.  New rows are marked imported."""
    new = incoming.select(*KEY, F.col("content").alias("_new"))
    if mode == "replace":
        return new.select(*KEY, F.col("_new").alias("content"), F.lit(True).alias("imported"))
    return store.select(*KEY, "content").join(new, KEY, "full_outer").select(
        *KEY, F.coalesce("_new", "content").alias("content"), F.col("_new").isNotNull().alias("imported"))


# ---------------------------------------------------------------- versions

def snapshot(state: DataFrame, version_id: Column, created_at: Column, message: str = "") -> DataFrame:
    """Freeze section rows under a version id (append to a table partitioned by project)."""
    return state.select(version_id.alias("version_id"), created_at.alias("created_at"), F.lit(message).alias("message"), *KEY, "title", "content")


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("project_id", "version_id").agg(
        F.max("created_at").alias("created_at"), F.count("*").alias("sections"), F.sum(F.length("content")).alias("chars"))


def version_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Added, removed, changed and unchanged sections between two versions, with previews."""
    a = left.select(*KEY, F.col("content").alias("_a"))
    b = right.select(*KEY, F.col("content").alias("_b"))
    rows = a.join(b, KEY, "full_outer")
    kind = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
            .when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed"))
    return rows.select(*KEY, kind.alias("change"), X.text_or_empty(F.col("_a")).alias("before"), X.text_or_empty(F.col("_b")).alias("after"))


def diff_details(diff: DataFrame) -> DataFrame:
    """Sizes and previews; a line diff for changed sections only."""
    return diff.filter("change <> 'unchanged'").select(
        *KEY, "change", F.length("before").alias("before_chars"), F.length("after").alias("after_chars"),
        X.content_preview(F.col("before")).alias("before_preview"), X.content_preview(F.col("after")).alias("after_preview"))


def changed_lines(diff: DataFrame) -> DataFrame:
    return diff.filter("change = 'changed'").select(*KEY, line_diff(F.col("before"), F.col("after")).alias("diff_lines"))


def restore(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """State rows of the wanted version of each project (project_id, version_id)."""
    return versions.join(wanted, ["project_id", "version_id"], "left_semi").select(*KEY, "title", "content")


def gen_queue(sections: DataFrame, approved: DataFrame, mode: str = "missing") -> DataFrame:
    """Sections still to generate: those without approved text, or all."""
    if mode == "all":
        return sections.select(*KEY)
    return sections.select(*KEY).join(approved.filter(X.text_or_empty(F.col("content")) != ""), KEY, "left_anti")


def export_subset(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose top-level section number is listed for the project (project_id, top)."""
    return rows.withColumn("top", F.split_part("section_id", F.lit("."), F.lit(1))).join(
        wanted, ["project_id", "top"], "left_semi").drop("top")


def export_info(sections: DataFrame, approved: DataFrame) -> DataFrame:
    """Per top-level section: does any approved text exist under it."""
    top = F.split_part("section_id", F.lit("."), F.lit(1)).alias("top")
    have = approved.select("project_id", top, F.lit(True).alias("has_content")).distinct()
    return sections.select("project_id", top).distinct().join(have, ["project_id", "top"], "left").fillna(False, ["has_content"])


# ---------------------------------------------------------------- saved image references

def sanitize_image_refs(texts: DataFrame, images: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Drop image tags and markdown images whose id is not indexed, and their captions.

    `texts`: key, content.  Ids used by a text are joined to the index once; the
    rewrite itself stays in the row.
    """
    tidy = texts.withColumn("content", X.normalize_image_tags(F.col("content")))
    tag = r'<IMAGE id="([^"]+)"\s*/?>'
    targets = F.regexp_extract_all("content", F.lit(fixed.MARKDOWN_IMAGE), F.lit(1))

    def names(t: Column) -> Column:
        bare = F.element_at(F.split(X.strip(t), "attachment:"), -1)
        base = F.element_at(F.split(bare, r"[/\\]"), -1)
        return F.array(bare, base, F.regexp_replace(base, r"\.[^.]*\z", ""))

    asked = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(tag), F.lit(1)), F.flatten(F.transform(targets, names))))
    known = images.select(F.col("image_id").alias("id")).distinct()
    if pinned is not None:
        known = known.unionByName(pinned.select(F.col("image_id").alias("id"))).distinct()
    valid = tidy.select("key", F.explode(asked).alias("id")).join(known, "id").groupBy("key").agg(F.collect_set("id").alias("valid"))
    rows = tidy.join(valid, "key", "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    ok = F.col("valid")
    kept = M.sub_each(F.col("content"), tag, 1, lambda i: F.when(F.array_contains(ok, i), F.concat(F.lit('<IMAGE id="'), i, F.lit('"/>'))).otherwise(""))

    def real(t: Column) -> Column:
        return F.get(F.filter(names(t), lambda n: F.array_contains(ok, n)), F.lit(0))

    def line(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(fixed.MARKDOWN_IMAGE), F.lit(1))
        swapped = M.sub_each(x, fixed.MARKDOWN_IMAGE, 1, lambda t: F.concat(F.lit('<IMAGE id="'), F.coalesce(real(t), F.lit("")), F.lit('"/>')))
        return F.when(F.size(found) == 0, x).when(F.forall(found, lambda t: real(t).isNotNull()), swapped)

    lines = F.filter(F.transform(F.split(kept, "\n"), line), lambda x: x.isNotNull())
    start = F.struct(F.lit("").alias("prev"), F.lit("x").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        caption = X.strip(x).rlike(X.uni(fixed.FIGURE_LINE)) & (s["last"] != "")
        drop = caption & ~F.contains(s["prev"], F.lit("<IMAGE id="))
        return F.when(drop, s).otherwise(F.struct(
            F.when(X.strip(x) != "", x).otherwise(s["prev"]).alias("prev"), x.alias("last"),
            F.concat(s["out"], F.array(x)).alias("out")))

    return rows.withColumn("_lines", lines).select(
        "key", F.array_join(F.aggregate("_lines", start, step, lambda s: s["out"]), "\n").alias("content"))
