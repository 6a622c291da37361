"""Column functions over text.  All stay in the JVM; none uses a Python UDF.

Patterns are kept in `fixed` in their portable form; `uni` switches ``\\s``,
``\\w``, ``\\d``, ``\\b`` and case folding to Unicode (Java's default is ASCII).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def uni(pattern: str) -> str:
    return "(?U)" + pattern


PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.trim(c, F.lit(fixed.WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(fixed.WS_CHARS))


def collapse(c: Column) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), uni(r"\s+"), " "))


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, value in rules:
        c = F.regexp_replace(c, pattern, value)
    return c


# ---------------------------------------------------------------- tokens

def _split_tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def tokens(c: Column) -> Column:
    """Lower-cased ``[A-Za-z0-9_]+`` runs, in order, repeats kept."""
    return _split_tokens(F.lower(F.regexp_replace(text_or_empty(c), "[^A-Za-z0-9_]+", " ")))


def tokens_min3(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: F.length(t) > 2)


def alnum_tokens(c: Column) -> Column:
    """``[a-z0-9]+`` runs of the lower-cased text."""
    return _split_tokens(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(alnum_tokens(c))


def content_terms(c: Column, stop: list[str] = fixed.QUESTION_STOP) -> Column:
    """Distinct alphanumeric terms longer than two characters, stop words removed."""
    stop_array = F.array(*[F.lit(w) for w in stop])
    return F.array_except(F.filter(alnum_tokens(c), lambda t: F.length(t) > 2), stop_array)


def expand_terms(c: Column) -> Column:
    """Sorted distinct tokens of a query plus the tokens of their synonyms."""
    table = F.create_map(*[
        part
        for word, phrases in fixed.QUERY_SYNONYMS.items()
        for part in (F.lit(word), tokens(F.lit(" ".join(phrases))))
    ])
    own = tokens(c)
    extra = F.flatten(F.transform(own, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))
    return F.sort_array(F.array_distinct(F.concat(own, extra)))


# ---------------------------------------------------------------- cleaning

def clean_text(c: Column) -> Column:
    c = replace_all(F.replace(c, F.lit("\r"), F.lit("\n")), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    return strip(c)


def dehyphenate(c: Column) -> Column:
    return clean_text(F.replace(c, F.lit("-\n"), F.lit("")))


def cell_text(c: Column) -> Column:
    """A cell as text: null is empty, a whole number loses its trailing ``.0``."""
    return F.regexp_replace(strip(text_or_empty(c.cast("string"))), r"^(-*[0-9]+)\.0$", "$1")


def date_cell_text(c: Column) -> Column:
    return text_or_empty(F.date_format(c, "yyyy-MM-dd"))


def _title_key(c: Column, prefix: str) -> Column:
    c = F.regexp_replace(text_or_empty(c), prefix, "")
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    return F.lower(collapse(F.regexp_replace(c, uni(PUNCTUATION), " ")))


def norm_title(c: Column) -> Column:
    """Comparison key of a clause title: numbering, punctuation and case removed."""
    return _title_key(c, uni(fixed.TITLE_PREFIX))


def norm_check_title(c: Column) -> Column:
    """As `norm_title`, with the narrower numbering rule of the content checks."""
    return _title_key(c, uni(fixed.CHECK_TITLE_PREFIX))


def norm_alnum_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def norm_body(c: Column) -> Column:
    return F.lower(collapse(c))


def norm_doc_name(c: Column) -> Column:
    path = F.replace(strip(text_or_empty(c)), F.lit("\\"), F.lit("/"))
    return F.lower(F.element_at(F.split(path, "/"), -1))


def section_sort_key(c: Column) -> Column:
    """Array that orders dotted ids: numbers before words, numbers by value."""
    return F.transform(
        F.split(c, r"\."),
        lambda p: F.when(
            p.rlike("^[0-9]+$"),
            F.struct(F.lit(0).alias("kind"), p.cast("long").alias("num"), F.lit("").alias("word")),
        ).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("num"), F.lower(p).alias("word"))),
    )


# ---------------------------------------------------------------- previews

def snippet(text: Column, terms: Column, max_chars: int = fixed.SNIPPET_CHARS) -> Column:
    """Window of `max_chars` around the first of the sorted `terms` found in `text`."""
    text = text_or_empty(text)
    size = F.length(text)
    low = F.lower(text)
    hit = F.get(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0), F.lit(0))
    start = F.greatest(F.lit(0), hit - 1 - int(max_chars * fixed.SNIPPET_LEAD))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.substring(text, start + 1, F.lit(max_chars)),
        F.when(start + max_chars < size, "…").otherwise(""),
    )
    head = F.concat(F.left(text, F.lit(max_chars)), F.when(size > max_chars, "…").otherwise(""))
    return F.when(hit.isNull(), head).otherwise(cut)


def content_preview(c: Column, limit: int = 520) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(rstrip(F.left(flat, F.lit(limit))), F.lit("...")))


def result_preview(c: Column) -> Column:
    return F.left(collapse(c), F.lit(140))


def chat_title_text(c: Column) -> Column:
    flat = collapse(c)
    return F.concat(F.left(flat, F.lit(60)), F.when(F.length(flat) > 60, "…").otherwise(""))


def image_caption(caption: Column, image_id: Column, heading: Column, page: Column) -> Column:
    cap = strip(text_or_empty(caption))
    own = (cap != "") & (F.lower(cap) != F.lower(text_or_empty(image_id))) & ~cap.rlike("(?i)^[0-9a-f]{8,}$")
    head = F.rtrim(strip(text_or_empty(heading)), F.lit(":"))
    named = (head != "") & ~F.lower(head).isin(fixed.CAPTION_SKIP_HEADINGS)
    paged = page.isNotNull() & (page != 0)
    return (
        F.when(own, cap).when(named, head)
        .when(paged, F.concat(F.lit("Figure (p."), page.cast("string"), F.lit(")")))
        .otherwise("Figure")
    )


def is_non_answer(c: Column) -> Column:
    low = F.lower(strip(text_or_empty(c)))
    hedged = [F.contains(low, F.lit(w)) for w in fixed.HEDGES]
    found = text_or_empty(c) == ""
    for test in hedged:
        found = found | test
    return found


def embed_text_prep(c: Column) -> Column:
    return F.left(strip(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit(8000))


def is_empty_text(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(fixed.EMPTY_WORDS)


def is_empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


# ---------------------------------------------------------------- tags, locators, citations

def normalize_image_tags(c: Column) -> Column:
    return F.regexp_replace(c, fixed.IMAGE_TAG_ANY, '<IMAGE id="$1"/>')


def image_ids(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit('<IMAGE id="([^"]+)"/>'), F.lit(1))


def strip_image_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, '<IMAGE id="[^"]+"/>', ""))


def strip_locators(c: Column) -> Column:
    c = replace_all(text_or_empty(c), *[(uni(p), "") for p in fixed.LOCATORS])
    return strip(replace_all(c, (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")))


def _tidy_after_citations(c: Column) -> Column:
    return strip(replace_all(c, (r"[ \t]{2,}", " "), (r" +([.,;:)])", "$1"), (r"[ \t]+(\n|\z)", "$1")))


def strip_citations(c: Column) -> Column:
    return _tidy_after_citations(F.regexp_replace(text_or_empty(c), r"\[[0-9]+\]", ""))


def citation_refs(c: Column) -> Column:
    """Every ``[n]`` of an answer as a number, in order."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"\[([0-9]+)\]"), F.lit(1)),
                       lambda n: n.cast("int"))


def citation_order(c: Column, passages: Column) -> Column:
    """Distinct in-range citation numbers by first appearance; position = new number."""
    return F.array_distinct(F.filter(citation_refs(c), lambda n: (n >= 1) & (n <= passages)))


def renumber_citations(c: Column, passages: Column) -> Column:
    """Rewrite ``[n]`` to 1..k by first appearance; out-of-range markers are dropped."""
    order = citation_order(c, passages)
    marker = r"\[[0-9]+\]"
    pieces = F.split(text_or_empty(c), marker)
    marks = F.transform(
        citation_refs(c),
        lambda n: F.when(
            F.array_position(order, n) > 0,
            F.concat(F.lit("["), F.array_position(order, n).cast("string"), F.lit("]")),
        ).otherwise(""),
    )
    return strip(F.array_join(
        F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))


def image_topic(c: Column) -> Column:
    """A question without the words that only ask to see something."""
    drop = F.array(*[F.lit(w) for w in fixed.QUESTION_STOP + fixed.IMAGE_REQUEST_WORDS])
    return F.array_join(
        F.filter(alnum_tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(drop, t)), " ")
