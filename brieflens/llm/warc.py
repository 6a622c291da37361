"""WARC archives of pages, read back and ordered by an external index merge.

`write` turns every page into a WARC/1.0 record with SQL functions and saves the
records with Spark's committed text writer: each part file is one gzip archive
whose records are separated as the format asks.  Equal payloads of MIN_REVISIT
bytes or more become one response (smallest page id) and revisits that refer to it.

`read` walks each archive as a stream of blocks (an archive is read by one task,
as gzip cannot be split) and takes a record's length from its header alone, so a
payload may hold anything.  It gives the index rows: URL key, timestamp, digest.

`histories` orders the index globally.  Each task sorts its captures into a run
and cuts the run into blocks of at most BLOCK rows at the bounds of the key
ranges; a range's blocks meet in one task, ordered by their first key, and a loser
tree merges the blocks that are open.  The bounds come from a bounded sample of
whole index keys (URL key, time, page), so a URL or host with a third of all
captures spreads over many ranges.

Cases: null html is an empty payload; null URLs get an empty key; a null page id
is kept and is the largest of its group; repeated rows are records of their own
(those with the smallest page id all responses); empty tables write no archive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

MIN_REVISIT = 100
BLOCK = 1024
RANGE_ROWS = 20_000
MAX_RANGES, PER_RANGE = 4096, 16  # so at most about 65,536 keys are sampled
CRLF = "\r\n"
GAP = CRLF + CRLF
EPOCH = "2024-01-01T00:00:00Z"


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to (null: a response).

    The smallest page of a payload is found on narrow rows; the join back is one
    row per payload against its pages, which adaptive execution may split.
    """
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = (rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return rows.join(first, ["digest", "bytes"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def record(page_id: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column, when: Column) -> Column:
    """The text of one record: header, empty line, block.  A revisit has no block; `X-Payload-Length` keeps its length."""
    revisit = refers_to.isNotNull()
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]+", "%0A")
    ident = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    line = lambda name, x: F.concat(F.lit(CRLF + name + ": "), x)
    return F.concat(
        F.lit("WARC/1.0"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(page_id.isNotNull(), line("WARC-Record-ID", ident(page_id))).otherwise(F.lit("")),
        line("WARC-Target-URI", clean), line("WARC-Date", when), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("X-Payload-Length", size.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(refers_to)),
                                 line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))), F.lit(GAP),
        F.when(revisit, F.lit("")).otherwise(payload))


def capture_time(page_id: Column) -> Column:
    """Pages carry no time; one second per page id after a fixed day keeps captures ordered and repeatable."""
    base = F.lit(EPOCH).cast("timestamp")
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(base) + F.coalesce(page_id.cast("long"), F.lit(0)) % (1 << 30)),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under `path`, one .gz file per task."""
    rows = decided(pages)
    text = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("bytes"), F.col("digest"), F.col("refers_to"),
                  capture_time(F.col("page_id")))
    rows.select(text.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").text(path)


INDEX = ("urlkey string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, intact boolean")


def url_key(url: str) -> str:
    """Host labels reversed, then the path and query, in lower case: captures of a site are neighbours."""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return url.lower()
    host = (parts.netloc.rpartition("@")[2]).lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    name, _, port = host.partition(":")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(name.split('.')))}{':' + port if port else ''}){parts.path or '/'}{query}".lower()


def parsed(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, from the pieces of the archives between empty lines."""
    gap = GAP.encode()
    for piece in blocks:
        head = piece.lstrip(b"\r\n")
        while head:  # what follows a block in the same piece is the next header
            if not head.startswith(b"WARC/1.0\r\n"):
                raise ValueError(f"no record where one should begin: {head[:40]!r}")
            header = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
            want = int(header["Content-Length"])
            parts, size = [], -len(gap)
            while size < want:
                part = next(blocks, None)
                if part is None:
                    raise ValueError("cut archive")
                parts.append(part)
                size += len(part) + len(gap)
            stream = gap.join(parts)
            yield header, stream[:want]
            head = stream[want:].lstrip(b"\r\n")


def indexed(header: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x else None
    said = header["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = header["WARC-Type"]
    if kind == "response":
        size, digest = len(block), hashlib.sha256(block).hexdigest()
    else:
        size, digest = int(header["X-Payload-Length"]), said
    url = header["WARC-Target-URI"]
    return (url_key(url), header["WARC-Date"], number(header.get("WARC-Record-ID", "")), url, kind,
            number(header.get("WARC-Refers-To", "")), size, digest, digest == said)


def arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all records in the archives under `path`; payload digests are computed from the bytes read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x.as_py() or b"" for batch in batches for x in batch.column(0))
        rows = []
        for header, block in parsed(pieces):
            rows.append(indexed(header, block))
            if len(rows) >= 4096:
                yield arrow_rows(rows)
                rows = []
        if rows:
            yield arrow_rows(rows)

    lines = spark.read.schema("value string").option("lineSep", GAP).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, the top the winner."""

    def __init__(self) -> None:
        self.lists: list[list[tuple]] = []
        self.at: list[int] = []
        self.tree: list[int] = []

    def head(self, k: int) -> tuple | None:
        return self.lists[k][self.at[k]] if k >= 0 and self.at[k] < len(self.lists[k]) else None

    def wins(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def open(self, rows: list[tuple]) -> None:
        """Add a list; the tree is played again, over the lists that still have rows."""
        left = [self.lists[k][self.at[k]:] for k in range(len(self.lists)) if self.at[k] < len(self.lists[k])]
        self.lists, self.at = [*left, rows], [0] * (len(left) + 1)
        n = len(self.lists)
        self.tree = [-1] * n
        winners = [-1] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self.wins(a, b) else (b, a)
        self.tree[0] = winners[1] if n > 1 else 0

    def top(self) -> tuple | None:
        return self.head(self.tree[0]) if self.tree else None

    def pop(self) -> tuple:
        k = self.tree[0]
        row = self.lists[k][self.at[k]]
        self.at[k] += 1
        node = (k + len(self.lists)) // 2
        while node:
            if self.wins(self.tree[node], k):
                self.tree[node], k = k, self.tree[node]
            node //= 2
        self.tree[0] = k
        return row


KEY = ["urlkey", "ts", "page_id"]


def sort_key(row: dict) -> tuple:
    return row["urlkey"], row["ts"], row["page_id"] is None, row["page_id"] or 0


def bounds(index: DataFrame, rows: int, ranges: int) -> list[tuple]:
    """`ranges` - 1 keys that cut the index evenly, from a sample of about PER_RANGE keys a range, picked by their hashes."""
    share = min(1.0, ranges * PER_RANGE / max(1, rows))
    picked = F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = sorted(sort_key(x.asDict()) for x in index.select(*KEY).filter(picked).distinct().collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index rows with `range_id` and `place`: ordered by (range_id, place), captures are in order of URL key, time, page."""
    count = index.count()
    ranges = min(max(1, -(-count // range_rows)), MAX_RANGES)
    edges = bounds(index, count, ranges)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's captures come sorted: cut them into blocks inside one range."""
        block, at = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), *(pa.array([block[0][c]]) .cast(t) for c, t in zip(KEY, (pa.string(), pa.string(), pa.int64()), strict=True)),
                 pa.array([block], pa.list_(ROW))], names=["range_id", *KEY, "rows"])

        for batch in batches:
            for row in batch.to_pylist():
                key, here = sort_key(row), at
                while here < len(edges) and edges[here] <= key:
                    here += 1
                if block and (here != at or len(block) >= BLOCK):
                    yield packed()
                    block = []
                at = here
                block.append(row)
        if block:
            yield packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come by range and first key: open each before anything that could follow it is given out."""
        tree, current, place, out = LoserTree(), None, 0, []

        def give(limit: tuple | None) -> Iterator[pa.RecordBatch]:
            nonlocal place, out
            while (top := tree.top()) is not None and (limit is None or top[0] < limit):
                row = tree.pop()[2]
                out.append(row | {"range_id": current, "place": place})
                place += 1
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=OUT)
                    out = []

        count = 0
        for batch in batches:
            for item in batch.to_pylist():
                first = sort_key(item["rows"][0])
                if item["range_id"] != current:
                    yield from give(None)
                    tree, current, place = LoserTree(), item["range_id"], 0
                yield from give(first)
                rows = [(sort_key(r), count + k, r) for k, r in enumerate(item["rows"])]
                count += len(rows)
                tree.open(rows)
        yield from give(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=OUT)

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    fields = [pa.field(a, b) for a, b in zip(names, kinds, strict=True)]
    ROW = pa.struct(fields)  # noqa: N806
    OUT = pa.schema([*fields, pa.field("range_id", pa.int32()), pa.field("place", pa.int64())])  # noqa: N806
    local = index.sortWithinPartitions("urlkey", "ts", F.col("page_id").asc_nulls_last())
    blocks = local.mapInArrow(runs, f"range_id int, urlkey string, ts string, page_id long, rows array<struct<{INDEX.replace(' ', ':').replace(',:', ',')}>>")
    met = blocks.repartition(ranges, "range_id").sortWithinPartitions("range_id", "urlkey", "ts", F.col("page_id").asc_nulls_last())
    return met.mapInArrow(merge, INDEX + ", range_id int, place long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, order them: `histories` rows of all pages."""
    spark = pages.sparkSession
    path = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return histories(stored(read(spark, path), "index"))
