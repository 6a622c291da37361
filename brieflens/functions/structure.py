"""Lines, headings, sections and tables of one document, inside its row.

A document is one row, so all of this is array work: no explode, no window and
no shuffle.  Order-dependent rules are folds (`aggregate`) over the row's lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as X
from .arrays import let

LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def lines(c: Column) -> Column:
    return F.split(X.text_or_empty(c), "\n")


def indexed(items: Column) -> Column:
    """``array<struct<i, line>>`` of the lines."""
    return F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("line")))


# ---------------------------------------------------------------- headings

def detect_heading(line: Column) -> Column:
    """struct<kind, id, title> of a section or numbered line; null otherwise."""
    def found(text: Column, pattern: str, kind: str) -> Column:
        p = X.uni(pattern)
        return F.when(text.rlike(p), F.struct(
            F.lit(kind).alias("kind"), F.regexp_extract(text, p, 1).alias("id"),
            X.strip(F.regexp_extract(text, p, 2)).alias("title")))

    return let(X.strip(X.text_or_empty(line)), lambda text: F.coalesce(
        found(text, fixed.SECTION_LINE, "section"), found(text, fixed.NUMBERED_PUNCT_LINE, "numbered"),
        found(text, fixed.NUMBERED_LINE, "numbered")))


def word_count(c: Column) -> Column:
    return let(X.collapse(c), lambda flat: F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))))


def headingish(title: Column) -> Column:
    """Short, few words, no closing punctuation, first letter upper case."""
    t = X.strip(X.text_or_empty(title))
    short = (t != "") & (F.length(t) <= 70) & ~t.rlike(r"[.;,]\z") & (word_count(t) <= 8)
    return short & t.rlike(r"(?s)^\P{L}*[\p{Lu}\p{Lt}]")


def is_toc_line(line: Column, style: Column) -> Column:
    low = F.lower(X.strip(X.text_or_empty(line)))
    return (
        F.contains(F.lower(X.text_or_empty(style)), F.lit("toc"))
        | low.isin("contents", "table of contents")
        | X.text_or_empty(line).rlike(X.uni(r"\.{2,}\s*\d+\s*\z"))
    )


def clean_toc_text(c: Column) -> Column:
    """A contents line without its page cells and dot leaders."""
    no_pages = F.regexp_replace(X.text_or_empty(c), X.uni(r"(?:(?:^|\t)[\s&&[^\t]]*[0-9]+[\s&&[^\t]]*)+\z"), "")
    return X.collapse(F.regexp_replace(X.strip(no_pages), X.uni(r"[ \t]*\.{2,}[ \t]*\d+\s*\z"), ""))


def assign_section_ids(entries: Column) -> Column:
    """Ids for contents entries ``array<struct<title, level>>``.

    A number inside the title wins and re-syncs the counters; other entries
    count up at their level and reset the deeper ones.
    """
    width = 12
    number = X.uni(fixed.SECTION_NUMBER)
    out = "array<struct<id:string,title:string,level:int>>"
    start = F.struct(
        F.array_repeat(F.lit(0).cast("decimal(38,0)"), width).alias("count"), F.array().cast(out).alias("rows"))

    def step(state: Column, e: Column) -> Column:
        title = X.strip(X.text_or_empty(e["title"]))
        own = F.regexp_extract(title, number, 1)
        numbered = own != ""
        parts = F.transform(F.split(own, r"\."), lambda p: p.try_cast("decimal(38,0)"))
        level = F.when(numbered, F.least(F.size(parts), F.lit(width))).otherwise(
            F.greatest(F.lit(1), F.least(F.coalesce(e["level"], F.lit(1)), F.lit(width))))
        counters = F.transform(state["count"], lambda n, i: F.when(i >= level, F.lit(0).cast("decimal(38,0)"))
                               .when(numbered, F.get(parts, i))
                               .when(i == level - 1, (n + 1).cast("decimal(38,0)")).otherwise(n))
        made = let(counters, lambda cs: F.array_join(F.slice(cs.cast("array<string>"), F.lit(1), level), "."))
        row = F.struct(
            F.when(numbered, own).otherwise(made).alias("id"),
            F.when(numbered, X.strip(F.regexp_extract(title, number, 2))).otherwise(title).alias("title"),
            level.cast("int").alias("level"))
        return F.struct(counters.alias("count"), F.concat(state["rows"], F.array(row)).alias("rows"))

    return F.aggregate(entries, start, step, lambda s: s["rows"])


def is_meta_title(title: Column) -> Column:
    return F.lower(X.strip(X.text_or_empty(title))).isin("table of contents", "toc")


# ---------------------------------------------------------------- sections

def segments(items: Column, marks: Column) -> Column:
    """Cut lines at marks ``array<struct<i, id, title>>`` into struct<id, title, body>."""
    return F.transform(marks, lambda m, j: F.struct(
        m["id"].alias("id"), m["title"].alias("title"),
        F.slice(items, m["i"] + 2, F.coalesce(F.get(marks, j + 1)["i"], F.size(items)) - m["i"] - 1).alias("body")))


def merge_by_id(segs: Column) -> Column:
    """Segments of one id joined in order, under the first title."""
    ids = F.array_distinct(F.transform(segs, lambda s: s["id"]))
    return F.transform(ids, lambda sid: let(F.filter(segs, lambda s: s["id"] == sid), lambda own: F.struct(
        sid.alias("id"), F.get(own, F.lit(0))["title"].alias("title"),
        F.flatten(F.transform(own, lambda s: s["body"])).alias("body"))))


def outline(items: Column) -> Column:
    """Numbered headings open sections; other lines join the open one.

    ``array<struct<id, title, content>>``; contents lines and lines before the
    first heading are dropped, a repeated id re-opens its section.
    """
    flat = F.filter(F.transform(items, lambda x: X.collapse(x)),
                    lambda x: (x != "") & ~is_toc_line(x, F.lit("")))

    def marks(ls: Column) -> Column:
        heads = F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("line"), detect_heading(x).alias("h")))
        kept = F.filter(heads, lambda m: m["h"].isNotNull() & ((m["h"]["kind"] == "section") | headingish(m["h"]["title"])))
        return F.transform(kept, lambda m: F.struct(
            m["i"].alias("i"), m["h"]["id"].alias("id"),
            F.when(m["h"]["title"] == "", m["line"]).otherwise(m["h"]["title"]).alias("title")))

    def build(ls: Column) -> Column:
        return let(segments(ls, marks(ls)), lambda segs: F.transform(merge_by_id(segs), lambda s: F.struct(
            s["id"].alias("id"), s["title"].alias("title"), F.array_join(s["body"], "\n\n").alias("content"))))

    return let(flat, build)


def split_marked(text: Column, allowed: Column) -> Column:
    """Split at ``### id`` lines whose id is allowed: ``array<struct<id, content>>``.

    A later block of the same id replaces the earlier one.
    """
    marker = X.uni(fixed.SECTION_MARKER)

    def build(ls: Column) -> Column:
        marks = F.filter(
            F.transform(ls, lambda x, i: F.struct(
                i.alias("i"), F.regexp_extract(x, marker, 1).alias("id"), F.lit("").alias("title"))),
            lambda m: (m["id"] != "") & F.array_contains(allowed, m["id"]))
        return let(marks, lambda ms: let(segments(ls, ms), lambda segs: F.transform(
            F.filter(segs, lambda s, j: ~F.exists(F.slice(ms, j + 2, F.size(ms)), lambda m: m["id"] == s["id"])),
            lambda s: F.struct(s["id"].alias("id"), X.strip(F.array_join(s["body"], "\n")).alias("content")))))

    return let(lines(text), build)


def heading_path_chunks(paragraphs: Column, size: int = fixed.PARAGRAPHS_PER_CHUNK) -> Column:
    """Chunks of styled paragraphs ``array<struct<style, text>>`` under their heading path.

    A heading of level n keeps the first n-1 headings above it; bodies are cut
    every `size` paragraphs.  Result: ``array<struct<path, body>>``.
    """
    level = r"(?i)^heading\s+([0-9]+)"

    def trail(heads: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

        def step(state: Column, h: Column) -> Column:
            stack = F.concat(F.slice(state["stack"], F.lit(1), F.greatest(h["level"] - 1, F.lit(0))), F.array(h["text"]))
            return F.struct(stack.alias("stack"), F.concat(state["paths"], F.array(F.array_join(stack, " > "))).alias("paths"))

        return F.aggregate(heads, start, step, lambda s: s["paths"])

    kept = F.filter(F.transform(paragraphs, lambda p: F.struct(
        F.regexp_extract(X.strip(X.text_or_empty(p["style"])), level, 1).try_cast("int").alias("level"),
        X.strip(X.text_or_empty(p["text"])).alias("text"))), lambda p: p["text"] != "")

    def build(ps: Column) -> Column:
        heads = F.filter(F.transform(ps, lambda p, i: F.struct(
            i.alias("i"), p["level"].alias("level"), p["text"].alias("text"))), lambda h: h["level"].isNotNull())

        def cut(hs: Column) -> Column:
            texts = F.transform(ps, lambda p: p["text"])
            marks = F.concat(
                F.array(F.struct(F.lit(-1).alias("i"), F.lit("(No Heading)").alias("id"), F.lit("").alias("title"))),
                let(trail(hs), lambda paths: F.transform(hs, lambda h, j: F.struct(
                    h["i"].alias("i"), F.get(paths, j).alias("id"), F.lit("").alias("title")))))
            groups = let(marks, lambda ms: let(texts, lambda ts: segments(ts, ms)))
            pieces = F.flatten(F.transform(groups, lambda g: F.when(F.size(g["body"]) > 0, F.transform(
                F.sequence(F.lit(1), F.size(g["body"]), F.lit(size)), lambda s: F.struct(
                    g["id"].alias("path"), X.clean_text(F.array_join(F.slice(g["body"], s, size), "\n")).alias("body"))))
                .otherwise(F.array().cast("array<struct<path:string,body:string>>"))))
            return F.filter(pieces, lambda p: p["body"] != "")

        return let(heads, cut)

    return let(kept, build)


# ---------------------------------------------------------------- tables

def cells(row: Column) -> Column:
    """Trimmed cells of a pipe row."""
    return F.transform(F.split(F.trim(row, F.lit("|")), r"\|"), lambda c: X.strip(c))


def is_pipe_line(line: Column) -> Column:
    return line.startswith("|") & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def extract_tables(text: Column) -> Column:
    """Tables as ``array<array<array<string>>>`` (table, row, cell).

    A table is a run of pipe lines; separator rows are dropped, and so are
    tables with fewer than two rows.
    """
    stripped = F.transform(F.split(X.text_or_empty(text), LINE_BREAK), lambda x, i: F.struct(i.alias("i"), X.strip(x).alias("line")))
    pipes = F.filter(stripped, lambda r: is_pipe_line(r["line"]))

    def build(rows: Column) -> Column:
        keyed = F.filter(
            F.transform(rows, lambda r, j: F.struct((r["i"] - j).alias("run"), cells(r["line"]).alias("cells"))),
            lambda r: F.exists(r["cells"], lambda c: (c != "") & ~c.rlike(r"^:?-{2,}:?\z")))
        return let(keyed, lambda ks: F.filter(
            F.transform(F.array_distinct(F.transform(ks, lambda r: r["run"])), lambda run: F.transform(
                F.filter(ks, lambda r: r["run"] == run), lambda r: r["cells"])),
            lambda t: F.size(t) >= 2))

    return let(pipes, build)


def extract_tables_strict(text: Column) -> Column:
    """Tables with a separator row: ``array<struct<headers, rows>>``; misfit rows dropped."""
    def parse(table: Column) -> Column:
        def filled(line: Column) -> Column:
            return F.filter(F.transform(F.split(line, r"\|"), lambda c: X.strip(c)), lambda c: c != "")

        return let(F.split(X.strip(table), "\n"), lambda ls: let(filled(F.get(ls, F.lit(0))), lambda head: F.struct(
            head.alias("headers"),
            F.filter(F.transform(F.slice(ls, 3, F.size(ls)), lambda x: filled(x)),
                     lambda r: F.size(r) == F.size(head)).alias("rows"))))

    return F.transform(F.regexp_extract_all(X.text_or_empty(text), F.lit(X.uni(fixed.STRICT_TABLE)), F.lit(0)), parse)


def split_adjacent_tables(items: Column) -> Column:
    """Tables of one run of pipe lines; a row followed by a separator starts a new one."""
    full = F.filter(F.transform(items, lambda x: X.strip(x)), lambda x: x.startswith("|") & x.endswith("|"))
    separator = X.uni(r"^\|[\s\-:|]+\|\z")

    def build(rows: Column) -> Column:
        tagged = F.transform(rows, lambda r, i: F.struct(
            i.alias("i"), r.rlike(separator).alias("sep"), F.coalesce(F.get(rows, i + 1), F.lit("")).rlike(separator).alias("head")))
        heads = F.filter(tagged, lambda t: t["head"] & ~t["sep"])

        def group(hs: Column) -> Column:
            return F.transform(hs, lambda h, j: let(
                F.slice(rows, h["i"] + 3, F.greatest(F.lit(0), F.coalesce(F.get(hs, j + 1)["i"], F.size(rows)) - h["i"] - 2)),
                lambda body: F.concat(F.array(cells(F.get(rows, h["i"]))), F.transform(
                    F.filter(body, lambda x, n: ~F.exists(F.slice(body, F.lit(1), n + 1), lambda y: y.rlike(separator))),
                    lambda x: cells(x)))))

        return let(heads, group)

    def whole(ls: Column) -> Column:
        rows = F.filter(
            F.transform(F.filter(F.transform(ls, lambda x: X.strip(x)), lambda x: x.startswith("|")), lambda x: cells(x)),
            lambda r: F.exists(r, lambda c: ~c.rlike(r"^:?-+:?\z")))
        return let(rows, lambda rs: F.when(F.size(rs) > 0, F.array(rs)).otherwise(F.array().cast("array<array<array<string>>>")))

    return let(let(full, build), lambda groups: F.when(F.size(groups) > 0, groups).otherwise(whole(items)))


# ---------------------------------------------------------------- packing

def pack_parts(blocks: Column, budget: int) -> Column:
    """Part number of each block ``array<struct<label, text>>``, contiguous and in order.

    Everything is one part if it fits the budget; else parts aim at an even
    share.  Nothing is dropped or cut.
    """
    sizes = F.transform(blocks, lambda b: F.length(b["label"]) + F.length(b["text"]) + 2)

    def build(ns: Column) -> Column:
        total = F.aggregate(ns, F.lit(0), lambda a, n: a + n)
        target = F.ceil(total / F.ceil(total / budget))
        start = F.struct(F.lit(1).alias("part"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, n: Column) -> Column:
            full = (s["size"] > 0) & (s["size"] + n > target)
            part = F.when(full, s["part"] + 1).otherwise(s["part"])
            return F.struct(
                part.alias("part"), F.when(full, n).otherwise(s["size"] + n).alias("size"),
                F.concat(s["out"], F.array(part)).alias("out"))

        packed = F.aggregate(ns, start, step, lambda s: s["out"])
        return F.when(total <= budget, F.array_repeat(F.lit(1), F.size(ns))).otherwise(packed)

    return let(sizes, build)


def pack_paragraphs(text: Column, limit: int = fixed.CHUNK_CHARS, overlap: int = fixed.OVERLAP_CHARS) -> Column:
    """Chunks of a text at paragraph borders: ``array<struct<text, char_start, char_end>>``.

    Paragraphs are added while their lengths (line breaks not counted) fit
    `limit`; a longer paragraph is never cut.  The next chunk repeats the
    trailing whole paragraphs that fit `overlap`.
    """
    paragraphs = F.filter(F.transform(lines(text), lambda p: X.strip(p)), lambda p: p != "")
    out = "array<struct<text:string,char_start:int,char_end:int>>"
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).alias("size"), F.lit(0).alias("from"),
        F.array().cast(out).alias("done"))

    def flushed(s: Column) -> Column:
        body = F.array_join(s["parts"], "\n")
        # locate() counts from 1 and from a position; 0 means not found
        at = F.call_function("locate", F.get(s["parts"], F.lit(0)), text, s["from"] + 1) - 1
        return let(F.struct(body.alias("text"), F.when(at < 0, s["from"]).otherwise(at).alias("start")), lambda b: F.struct(
            b["text"].alias("text"), b["start"].cast("int").alias("char_start"),
            F.least(b["start"] + F.length(b["text"]), F.length(text)).cast("int").alias("char_end")))

    def carried(parts: Column) -> Column:
        """Trailing whole paragraphs within `overlap`."""
        keep = F.aggregate(
            F.reverse(parts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
            lambda s, p: let(s["open"] & (s["size"] + F.length(p) <= overlap), lambda ok: F.struct(
                F.when(ok, s["n"] + 1).otherwise(s["n"]).alias("n"),
                F.when(ok, s["size"] + F.length(p)).otherwise(s["size"]).alias("size"), ok.alias("open"))))
        return keep

    def step(s: Column, p: Column) -> Column:
        full = (s["size"] + F.length(p) > limit) & (F.size(s["parts"]) > 0)

        def cut(chunk: Column) -> Column:
            raw_end = chunk["char_start"] + F.length(chunk["text"])
            return let(carried(s["parts"]), lambda k: F.struct(
                F.concat(F.slice(s["parts"], F.size(s["parts"]) - k["n"] + 1, k["n"]), F.array(p)).alias("parts"),
                (k["size"] + F.length(p)).alias("size"), (raw_end - k["size"]).alias("from"),
                F.concat(s["done"], F.array(chunk)).alias("done")))

        more = F.struct(
            F.concat(s["parts"], F.array(p)).alias("parts"), (s["size"] + F.length(p)).alias("size"),
            s["from"].alias("from"), s["done"].alias("done"))
        return F.when(full, let(flushed(s), cut)).otherwise(more)

    def finish(s: Column) -> Column:
        return F.when(F.size(s["parts"]) > 0, F.concat(s["done"], F.array(flushed(s)))).otherwise(s["done"])

    return F.aggregate(paragraphs, start, step, finish)
