"""Benchmark decontamination by a distributed positional inverted index.

Index.  Each task cuts its texts into segments of whole documents.  A segment
holds its documents (id, number, place of the first word) and a positional
inverted list: the distinct terms, sorted, each with the sorted places of its
words.  Places run through the segment; one place stays free between documents,
so consecutive places never cross documents.  Segments are rows of a stored
table: nothing is shuffled, and an index serves any number of test sets.

Search.  The distinct windows of the test items are packed into blocks of a
bounded number of words, and each segment meets each block.  A window whose terms
are not all in the segment is dropped at once.  For the others the list of the
rarest term, moved back by its offset in the window, is intersected with the
lists of the next rarest ones.  What remains are exact phrase places.  A proximity
search takes the windows as sets of terms and keeps those that lie whole within a
span of words.

Words are maximal runs of digits, ASCII letters (lower-cased) and code points from
U+0080.  A term is known by 128 bits of its bytes, computed for all words of a
segment at once from running sums over the bytes.

Cases: null text and text without words have no words; an item of fewer words
than the width is one window, one without words is none; repeated items and equal
windows are looked for once and reported for every item; a null item id is
reported as a match without an id; repeated documents are documents of their own;
a text of any length is one document of one segment; empty tables give an empty
result or documents without hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, small_batches, stored, whole_text

SEGMENT = 1 << 22  # bytes of text after which a segment is closed
CHUNK = 1 << 18  # bytes hashed at once
BLOCK = 1 << 18  # words (two bytes at least) of test items after which a block is closed

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLES = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of a word, and what each becomes in lower case."""
    inside = np.zeros(256, bool)
    lower = np.arange(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        inside[low:high + 1] = True
    lower[0x41:0x5B] += 32
    return inside, lower


INSIDE, LOWER = letters()


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunk_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, start) of each word in some bytes that begin and end between words."""
    inside = INSIDE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(BASE, len(data)), powers(INVERSE, len(data))
    parts = []
    for table in TABLES:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[LOWER[data]] * up, out=total[1:])
        h = (total[end] - total[start]) * down[start] if len(start) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append(h ^ (h >> np.uint64(32)))
    return parts[0], parts[1], start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, byte offset) of all words, hashed in chunks that are cut between words."""
    view = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(view):
        end = min(at + CHUNK, len(view))
        while end < len(view) and INSIDE[view[end]]:  # to the next gap; as long as the word, if that is longer than a chunk
            gap = np.flatnonzero(~INSIDE[view[end:end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(view))
        low, high, start = chunk_hashes(view[at:end])
        found.append((low, high, start + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- the index --------------------------------------------------------------------------------------------------------------
SEGMENT_COLUMNS = ("starts", "terms", "ends", "places")
WINDOW_COLUMNS = ("low", "high", "window_ends", "items", "item_ends")
TERM = np.dtype([("low", "<u8"), ("high", "<u8")])


@dataclass
class Segment:
    """starts[k]: place of the first word of document k, starts[-1] the end; term t has places[ends[t - 1]:ends[t]]."""

    starts: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Segment:
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        low, high, offset = word_hashes(b" ".join([*texts, b""]))
        doc = np.searchsorted(edges, offset, side="right") - 1
        place = (np.arange(len(doc)) + doc).astype(np.int64)
        counts = np.bincount(doc, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        order = np.argsort(low, kind="stable")
        if (np.diff(low[order].view(np.int64)) == 0).any() and (np.diff(high[order].view(np.int64)) != 0)[
                np.diff(low[order].view(np.int64)) == 0].any():
            order = np.lexsort((high, low))
        low, high = low[order], high[order]
        last = np.flatnonzero(np.concatenate([(low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]])) if len(low) else np.zeros(0, np.int64)
        terms = np.empty(len(last), TERM)
        terms["low"], terms["high"] = low[last], high[last]
        return cls(starts.astype(np.uint32), terms, (last + 1).astype(np.uint32), place[order].astype(np.uint32))

    def columns(self) -> tuple[bytes, ...]:
        """As binary columns, named in SEGMENT_COLUMNS."""
        return tuple(x.tobytes() for x in (self.starts, self.terms, self.ends, self.places))

    @classmethod
    def read(cls, *columns: bytes) -> Segment:
        return cls(*(np.frombuffer(x, kind) for x, kind in zip(columns, ("<u4", TERM, "<u4", "<u4"), strict=True)))

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(len(low), -1)
        mine = np.ascontiguousarray(self.terms["low"])
        at = np.minimum(np.searchsorted(mine, low), len(mine) - 1)
        for k in np.flatnonzero((mine[at] == low) & (self.terms["high"][at] != high)):  # equal low halves stand side by side
            while at[k] + 1 < len(mine) and mine[at[k]] == low[k] and self.terms["high"][at[k]] != high[k]:
                at[k] += 1
        return np.where((mine[at] == low) & (self.terms["high"][at] == high), at, -1)

    def of_term(self, t: int) -> np.ndarray:
        return self.places[self.ends[t - 1] if t else 0:self.ends[t]].astype(np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted array `of`."""
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values if len(of) else np.zeros(len(values), bool)


@dataclass
class Windows:
    """Distinct windows: low and high are their words one after another; window w has words ends[w - 1]:ends[w]; items are
    item numbers, those of w are items[item_ends[w - 1]:item_ends[w]]."""

    low: np.ndarray
    high: np.ndarray
    ends: np.ndarray
    items: np.ndarray
    item_ends: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], width: int) -> Windows:
        seen: dict[bytes, list[int]] = {}
        for item, text in enumerate(texts):
            low, high, _ = word_hashes(text)
            both = np.stack([low, high], axis=1)
            for k in range(max(len(low) - width, 0) + 1 if len(low) else 0):
                here = seen.setdefault(both[k:k + width].tobytes(), [])
                if not here or here[-1] != item:
                    here.append(item)
        words = np.frombuffer(b"".join(seen), "<u8").reshape(-1, 2)
        return cls(words[:, 0], words[:, 1], np.cumsum([len(x) // 16 for x in seen]).astype(np.int64),
                   np.array([i for x in seen.values() for i in x], np.int64), np.cumsum([len(x) for x in seen.values()]).astype(np.int64))

    def columns(self) -> tuple[bytes, ...]:
        """As binary columns, named in WINDOW_COLUMNS."""
        return tuple(x.tobytes() for x in (self.low, self.high, self.ends, self.items, self.item_ends))

    @classmethod
    def read(cls, *columns: bytes) -> Windows:
        return cls(*(np.frombuffer(x, kind) for x, kind in zip(columns, ("<u8", "<u8", "<i8", "<i8", "<i8"), strict=True)))

    def present(self, segment: Segment) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its term numbers) of the windows all of whose terms occur in the segment."""
        if not len(self.ends):
            return
        terms = segment.find(self.low, self.high)
        begins = np.concatenate([[0], self.ends[:-1]])
        for w in np.flatnonzero(np.minimum.reduceat(terms, begins) >= 0):
            yield int(w), terms[begins[w]:self.ends[w]]

    def of_window(self, w: int) -> np.ndarray:
        return self.items[self.item_ends[w - 1] if w else 0:self.item_ends[w]]


def phrase(segment: Segment, terms: np.ndarray) -> np.ndarray:
    """Places at which the terms stand one after another, by offset-adjusted lists from the rarest on."""
    sizes = np.diff(segment.ends, prepend=np.uint32(0))[terms]
    order = np.argsort(sizes, kind="stable")
    at = segment.of_term(terms[order[0]]) - order[0]
    for k in order[1:]:
        if not len(at):
            break
        at = at[among(at + k, segment.of_term(terms[k]))]
    return at


def proximity(segment: Segment, terms: np.ndarray, span: int) -> np.ndarray:
    """(first, last) of the least stretches of at most `span` words of a document that hold all the terms, in any order."""
    terms = np.unique(terms)
    lists = sorted((segment.of_term(t) for t in terms), key=len)
    first = np.unique(np.concatenate([x[np.searchsorted(lists[0], x) < np.searchsorted(lists[0], x + span)] for x in lists]))
    last = first.copy()
    for x in lists:
        if not len(first):
            break
        at = np.searchsorted(x, first)
        first, last, at = first[at < len(x)], last[at < len(x)], at[at < len(x)]
        last = np.maximum(last, x[at])
        near = last - first < span
        first, last = first[near], last[near]
    same = segment.document(first) == segment.document(last)
    first, last = first[same], last[same]
    least = np.concatenate([last[1:] != last[:-1], [True]]) if len(last) else np.zeros(0, bool)  # of one end the latest start
    return np.stack([first[least], last[least]], axis=1)


# -- Spark ------------------------------------------------------------------------------------------------------------------
def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """Stored, a row per segment: segment, ids and n_words (arrays, one place per document), starts, terms, ends, places."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def closed(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        made = Segment.of(texts)
        flat = pa.concat_arrays(ids)
        one = pa.array([0, len(flat)], pa.int32())
        counts = pa.array(np.diff(made.starts.astype(np.int64)) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, flat), pa.ListArray.from_arrays(one, counts), *(pa.array([x], pa.binary()) for x in made.columns())],
            names=["ids", "n_words", "starts", "terms", "ends", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            begin = 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= size:
                    yield closed([*ids, batch.column(0).slice(begin, k + 1 - begin)], texts)
                    ids, texts, held, begin = [], [], 0, k + 1
            ids.append(batch.column(0).slice(begin))
        if texts:
            yield closed(ids, texts)

    made = rows.mapInArrow(run, f"ids array<{kind}>, n_words array<long>, starts binary, terms binary, ends binary, places binary")
    with small_batches(docs.sparkSession):
        return stored(made.withColumn("segment", F.monotonically_increasing_id()), "postings", **WIDE_ROWS)


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored, a row per block of about BLOCK words of item text: item_ids (array) and the arrays of `Windows`."""
    rows = items.select(F.col(id_col).alias("item_id"), whole_text(text_col).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def closed(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        made = Windows.of(texts, width)
        flat = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), *(pa.array([x], pa.binary()) for x in made.columns())],
            names=["item_ids", *WINDOW_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                ids.append(batch.column(0).slice(k, 1))
                texts.append(text.as_py())
                held += len(texts[-1]) // 2 + 1
                if held >= BLOCK:
                    yield closed(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield closed(ids, texts)

    with small_batches(items.sparkSession):
        return stored(rows.mapInArrow(run, f"item_ids array<{kind}>, " + ", ".join(f"{x} binary" for x in WINDOW_COLUMNS)), "windows", **WIDE_ROWS)


def merged(first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Stretches of words in order, those that touch as one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1] + 1])
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[new], last[np.concatenate([new[1:], [True]])], strict=True)]


def matches(index: DataFrame, items: DataFrame, width: int = 10, span: int | None = None, id_col: str = "item_id",
            text_col: str = "text") -> DataFrame:
    """Documents of an index that hold windows of `width` words of the items: segment, number, doc_id, item_ids (of all items
    with a window there), stretches (array of first, last: word numbers, from 0).

    Without `span` a window must stand as it is; with it, its words must lie within `span` words, in any order.  A
    document has one row for each block of test windows it holds any of.  They are stored: segments are read in small batches.
    """
    blocks = windows(items, width, id_col, text_col)
    kind, item = (x.split("<")[1][:-1] for x in (index.schema["ids"].dataType.simpleString(), blocks.schema["item_ids"].dataType.simpleString()))
    shape = (f"segment long, number int, doc_id {kind}, item_ids array<{item}>, "
             "stretches array<struct<first: long, last: long>>")
    kinds = (pa.int64(), pa.int32(), None, None, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))

    def rows_of(segment: Segment, tests: Windows) -> Iterator[tuple[int, np.ndarray, list[dict[str, int]]]]:
        spots, which = [], []
        for w, terms in tests.present(segment):
            if span is None:
                at = phrase(segment, terms)
                here = np.stack([at, at + len(terms) - 1], axis=1)
            else:
                here = proximity(segment, terms, span)
            if len(here):
                spots.append(here)
                which.append(np.full(len(here), w))
        if not spots:
            return
        spots, which = np.concatenate(spots), np.concatenate(which)
        doc = segment.document(spots[:, 0])
        order = np.argsort(doc, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            number = int(doc[part[0]])
            found = np.unique(np.concatenate([tests.of_window(w) for w in np.unique(which[part])]))
            yield number, found, merged(*(spots[part] - int(segment.starts[number])).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                tests = Windows.read(*(one[x].as_py() for x in WINDOW_COLUMNS))
                segment = Segment.read(*(one[x].as_py() for x in SEGMENT_COLUMNS))
                out = list(rows_of(segment, tests))
                if not out:
                    continue
                numbers = [x[0] for x in out]
                lists = [one["item_ids"].values.take(pa.array(x[1])) for x in out]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["segment"].as_py()] * len(out), kinds[0]), pa.array(numbers, kinds[1]),
                     one["ids"].values.take(pa.array(numbers)), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(lists)),
                     pa.array([x[2] for x in out], kinds[4])], names=["segment", "number", "doc_id", "item_ids", "stretches"])

    pairs = index.select("segment", "ids", *SEGMENT_COLUMNS).crossJoin(blocks)  # each segment meets each block of the test set
    with small_batches(index.sparkSession):
        return stored(pairs.mapInArrow(run, shape), "matches")


def covered(stretches: Column) -> Column:
    """Words inside any of the stretches, which may overlap and come in any order."""
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["last"]).alias("end"),
        (s["total"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(s["end"], x["first"] - 1))).alias("total"))
    return F.aggregate(F.array_sort(stretches), none, step, lambda s: s["total"])


def contamination(index: DataFrame, items: DataFrame, width: int = 10, span: int | None = None, id_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document of an index: doc_id, n_words, n_hit (words inside any match), n_items (distinct item ids),
    item_ids (array of string, sorted), contaminated."""
    found = matches(index, items, width, span, id_col, text_col).groupBy("segment", "number").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(
            "item_ids", lambda x: F.coalesce(x.cast("string"), F.lit(""))))))).alias("item_ids"),
        covered(F.flatten(F.collect_list("stretches"))).alias("n_hit"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("number", "doc"))
    docs = docs.select("segment", "number", F.col("doc.ids").alias("doc_id"), F.col("doc.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    return docs.join(found, ["segment", "number"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
