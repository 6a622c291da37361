"""Clean-up of drafted text: HTML to markdown, table rows, stray headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as X
from .arrays import let
from .structure import detect_heading, lines, word_count

TABLE_TAG = r"(?is)<table[^>]*>.*?</table>"
IMAGE_TAG = r"(?i)<IMAGE\b[^>]*/>"


def sub_each(text: Column, pattern: str, group: int, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of `pattern` by ``fn(group)``."""
    return let(text, lambda t: F.array_join(F.zip_with(
        F.split(t, pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)),
        lambda piece, m: F.concat(piece, F.when(m.isNull(), "").otherwise(fn(m)))), ""))


def untag(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def html_table(html: Column) -> Column:
    """One ``<table>`` as a pipe table padded to its widest row; empty if it has no cells."""
    cell = "(?is)<t[hd][^>]*>(.*?)</t[hd]>"
    rows = F.filter(F.transform(
        F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)),
                              lambda c: X.strip(F.replace(untag(c), F.lit("\n"), F.lit(" "))))),
        lambda r: F.size(r) > 0)

    def draw(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, lambda r: F.size(r)))

        def line(values: Column) -> Column:
            return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

        padded = F.transform(rs, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        return F.when(F.size(rs) == 0, "").otherwise(F.concat(
            F.lit("\n"), F.get(padded, F.lit(0)), F.lit("\n"), line(F.array_repeat(F.lit("---"), width)),
            F.when(F.size(rs) > 1, F.concat(F.lit("\n"), F.array_join(F.slice(padded, F.lit(2), F.size(rs)), "\n"))).otherwise(""),
            F.lit("\n")))

    return let(rows, draw)


def html_tables_to_markdown(c: Column) -> Column:
    return sub_each(c, TABLE_TAG, 0, html_table)


def drop_placeholder_rows(c: Column) -> Column:
    """Drop pipe rows that are blank or hold placeholders only; separator rows stay."""
    def keep(line: Column) -> Column:
        s = X.strip(line)
        row = s.startswith("|") & s.endswith("|") & ~F.contains(s, F.lit("---"))
        values = F.filter(F.transform(F.split(F.trim(s, F.lit("|")), r"\|"), lambda v: X.strip(v)), lambda v: v != "")
        return ~(row & F.forall(values, lambda v: v.rlike(fixed.PLACEHOLDER)))

    return F.array_join(F.filter(lines(c), keep), "\n")


def normalize_table_text(c: Column) -> Column:
    """Re-space the rows of every complete table; other text is kept unless blank."""
    table = X.uni(fixed.STRICT_TABLE)

    def tidy(t: Column) -> Column:
        return F.array_join(F.transform(F.split(X.strip(t), "\n"), lambda row: F.concat(
            F.lit("| "),
            F.array_join(F.transform(F.split(F.regexp_replace(X.strip(row), r"^\||\|\z", ""), r"\|"), lambda v: X.strip(v)), " | "),
            F.lit(" |"))), "\n")

    pieces = F.split(c, table)
    tables = F.regexp_extract_all(c, F.lit(table), F.lit(0))
    woven = F.flatten(F.zip_with(pieces, tables, lambda p, t: F.array(p, F.when(t.isNull(), "").otherwise(tidy(t)))))
    joined = F.array_join(F.filter(woven, lambda p: X.strip(p) != ""), "\n")
    return F.when(F.size(tables) > 0, joined).otherwise(c)


def _close_gaps(items: Column) -> Column:
    return X.strip(F.regexp_replace(F.array_join(items, "\n"), "\n{3,}", "\n\n"))


def strip_invented_headings(c: Column, known_ids: Column) -> Column:
    """Drop short lines that read as ``Section N`` or as a numbered known section."""
    def keep(line: Column) -> Column:
        return let(F.regexp_replace(X.strip(line), X.uni(r"^#{1,6}\s*"), ""), lambda bare: ~(
            let(detect_heading(bare), lambda head: F.coalesce(
                head.isNotNull() & ((head["kind"] == "section") | F.array_contains(known_ids, head["id"])), F.lit(False)))
            & (word_count(bare) <= 8)))

    return _close_gaps(F.filter(lines(c), keep))


def strip_empty_headings(c: Column) -> Column:
    """Drop ``#`` and all-bold heading lines with nothing under them."""
    def is_heading(s: Column) -> Column:
        return s.rlike(X.uni(r"^#{1,6}\s+\S")) | s.rlike(r"^\*\*[^*]{1,60}\*\*:?\z")

    def build(ls: Column) -> Column:
        filled = F.filter(F.transform(ls, lambda x, i: let(X.strip(x), lambda s: F.struct(
            i.alias("i"), (s != "").alias("filled"), is_heading(s).alias("head")))), lambda r: r["filled"])
        empty = let(filled, lambda fs: F.transform(
            F.filter(fs, lambda r, j: r["head"] & F.coalesce(F.get(fs, j + 1)["head"], F.lit(True))), lambda r: r["i"]))
        return let(empty, lambda gone: F.filter(ls, lambda x, i: ~F.array_contains(gone, i)))

    return _close_gaps(let(lines(c), build))


def strip_redundant_headers(c: Column, section_id: Column) -> Column:
    """Drop ``# N`` lines whose number starts with the section's top number."""
    top = F.get(F.split(section_id, r"\."), F.lit(0))

    def keep(line: Column) -> Column:
        number = F.regexp_extract(X.strip(line), X.uni(r"^#{1,6}\s+([\d.]+)\b"), 1)
        return ~((number != "") & F.startswith(number, top))

    return F.ltrim(F.array_join(F.filter(lines(c), keep), "\n"), F.lit("\n"))


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\xa0"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Tags to plain markdown; tables and image tags are kept as they are.

    Protected spans are swapped for one NUL each while the tags are replaced.
    """
    guard = "(?:" + TABLE_TAG + "|" + IMAGE_TAG + ")"

    def bold(inner: Column) -> Column:
        return let(X.strip(untag(inner)), lambda bare: F.when(bare == "", "").otherwise(F.concat(F.lit("**"), bare, F.lit("**"))))

    def plain(source: Column) -> Column:
        text = F.array_join(F.split(source, guard), "\x00")
        text = sub_each(text, "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1, bold)
        text = sub_each(text, "(?is)<title[^>]*>(.*?)</title>", 1, bold)
        text = sub_each(text, "(?is)<li[^>]*>(.*?)</li>", 1, lambda m: F.concat(F.lit("- "), X.strip(untag(m))))
        text = X.replace_all(
            text,
            ("(?i)</(?:p|div|section|article|blockquote|ul|ol)>", "\n"),
            ("<[^>]+>", ""), ("\n{3,}", "\n\n"))
        return X.strip(F.array_join(F.zip_with(
            F.split(unescape(text), "\x00"), F.regexp_extract_all(source, F.lit(guard), F.lit(0)),
            lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))

    return let(c, plain)


def html_to_text(c: Column, max_chars: int) -> Column:
    """A web page as text: scripts and styles removed, blank runs closed, cut at `max_chars`."""
    body = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", "")
    body = F.regexp_replace(body, r"(?is)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?is)^.*<body[^>]*>|</body>.*\z", "")
    flat = strip_html(body)
    return F.when(F.length(flat) <= max_chars, flat).otherwise(
        F.concat(X.rstrip(F.left(flat, F.lit(max_chars))), F.lit("\n\n...(truncated)")))
