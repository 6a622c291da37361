"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

`tokenised` gives every document's pieces (narrow rows: place, length, checksum)
and stores them in the shared folder, so no text is tokenised twice.  Pieces are
dealt by a hash of a row number into blocks of about BLOCK pieces, whatever
their documents are; a block is the largest thing one task holds.  Each block is
packed by ISLANDS populations with seeds of their own; after each round the best
packing of an island moves on to the next one.  A packing's genes are whole
sequences: crossover injects the other parent's best filled sequences, removes
the ones that repeat a piece, and places the displaced pieces by best fit.  A
block that reaches its lower bound stops at once.

Cases: a null or empty text is one piece that holds the end id alone; repeated
rows are packed as often as they occur; an empty table gives an empty result;
ties are broken by place, so a packing depends on the stored pieces alone; a
text's own end mark (MARK) counts as `tokenizers` counts it.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

CAPACITY = 2048
BLOCK = 8192
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 4, 4
KEPT_WORDS = 600_000
END = b"\0\0\0\0"  # id 0 after each document
MARK, MARK_ID = "<|endoftext|>", 50256  # the vocabulary's added token, which is no rank
ODD_SPACE = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
BEFORE_WORD = re.compile(r"(?= \S)")


class Words(dict):
    """Word -> its ids as little-endian bytes, filled on demand; when full, the older half goes."""

    def __init__(self, coding: tiktoken.Encoding, lead: str):
        super().__init__()
        self.coding, self.lead, self.older = coding, lead, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.coding.encode_ordinary(self.lead + word), "<u4").tobytes()
        if len(self) >= KEPT_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Tokens:
    """Byte-level BPE ids of whole texts, word by word.

    The split pattern always begins a new word at a space before a visible
    character and at a line end between visible ones, so the words can be
    encoded one at a time and remembered.  Text with other white space is cut
    at the first kind of place only.  MARK is taken out before any splitting and
    has the id MARK_ID.
    """

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.next = Words(coding, ""), Words(coding, " ")
        self.line = np.array(coding.encode_ordinary("\n"), "<u4").tobytes()
        self.mark = np.array([MARK_ID], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.mark.join(map(self.between, text.split(MARK)))

    def between(self, text: str) -> bytes:
        """The ids of a text without MARK."""
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return b"".join(map(self.first.__getitem__, filter(None, BEFORE_WORD.split(text))))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.next.__getitem__, words[1:])))
        return self.line.join(lines)


@lru_cache(maxsize=2)
def tokens(ranks_file: str, pattern: str) -> Tokens:
    """One encoder per worker process."""
    return Tokens(ranks_file, pattern)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: all full but the first."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(x, capacity) for x in range(head, n, capacity)]


PIECES = "uid long, doc_id {}, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, ranks_file: str, pattern: str, capacity: int = CAPACITY,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per piece: uid, doc_id, piece, start, length, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(ranks_file, pattern)
        for batch in batches:
            row, rows = [], []
            for k, text in enumerate(batch.column(1)):
                data = tool.encode(text.as_py() or "") + END
                for piece, (start, n) in enumerate(cut_points(len(data) // 4, capacity)):
                    row.append(k)
                    rows.append((piece, start, n, zlib.crc32(data[4 * start:4 * (start + n)])))
            made = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *made],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = PIECES.format(rows.schema["doc_id"].dataType.simpleString()).removeprefix("uid long, ")
    return stored(rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Packing:
    """Sequences as lists of item numbers, with their filled lengths."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def add(self, items: list[int]) -> None:
        """Place `items` in this order by best fit: the sequence with the least room that is enough."""
        sizes, capacity, bins, room = self.sizes, self.capacity, self.bins, self.room
        open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        there = 0  # bit r: some sequence has r ids of room
        for b, r in enumerate(room):
            open_by_room[r].append(b)
            there |= 1 << r
        for item in items:
            n = sizes[item]
            fits = there >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = open_by_room[r].pop()
                if not open_by_room[r]:
                    there ^= 1 << r
                bins[b].append(item)
            else:
                b, r = len(bins), capacity
                bins.append([item])
                room.append(capacity)
            room[b] = left = r - n
            if left:
                open_by_room[left].append(b)
                there |= 1 << left

    def value(self) -> tuple[int, int]:
        """Smaller is better: the number of sequences, then how evenly they are filled."""
        return len(self.bins), -sum((self.capacity - r) ** 2 for r in self.room)

    def assignment(self) -> list[int]:
        where = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for item in items:
                where[item] = b
        return where


def of_assignment(sizes: list[int], capacity: int, where: list[int]) -> Packing:
    packing = Packing(sizes, capacity)
    packing.bins = [[] for _ in range(max(where, default=-1) + 1)]
    for item, b in enumerate(where):
        packing.bins[b].append(item)
    packing.room = [capacity - sum(sizes[i] for i in items) for items in packing.bins]
    return packing


def crossed(one: Packing, other: Packing, rng: random.Random) -> Packing:
    """Whole well-filled sequences of `other` injected into `one`; duplicates go, displaced pieces are placed anew."""
    order = sorted(range(len(other.bins)), key=other.room.__getitem__)
    best = order[:max(1, len(order) // 2)]
    share = best[rng.randrange(2)::2]
    injected = [other.bins[b] for b in share]
    there = set().union(*map(set, injected)) if injected else set()
    child = Packing(one.sizes, one.capacity)
    child.bins, child.room = [list(x) for x in injected], [other.room[b] for b in share]
    loose = []
    drop = set(rng.sample(range(len(one.bins)), max(1, len(one.bins) // 50)) if one.bins else [])
    for b, items in enumerate(one.bins):
        if b in drop and one.room[b] or not there.isdisjoint(items):
            loose += [x for x in items if x not in there]
        else:
            child.bins.append(list(items))
            child.room.append(one.room[b])
    loose.sort(key=lambda x: (-one.sizes[x], x))
    child.add(loose)
    return child


def evolved(sizes: list[int], capacity: int, seed: int, elites: list[list[int]]) -> list[int]:
    """The best packing of one island after a round, as the sequence number of each item."""
    rng = random.Random(seed)
    floor = -(-sum(sizes) // capacity)
    falling = sorted(range(len(sizes)), key=lambda x: (-sizes[x], x))
    people = [of_assignment(sizes, capacity, x) for x in elites]
    if not people:
        people.append(Packing(sizes, capacity))
        people[0].add(falling)
    while len(people) < POPULATION and min(len(p.bins) for p in people) > floor:
        noisy = sorted(falling, key=lambda x: -sizes[x] * rng.uniform(0.8, 1.0))
        people.append(Packing(sizes, capacity))
        people[-1].add(noisy)
    for _ in range(GENERATIONS):
        people.sort(key=Packing.value)
        if len(people[0].bins) <= floor:
            break
        children = [crossed(*rng.sample(people[:3], 2), rng) for _ in range(POPULATION)]
        people = sorted(people + children, key=Packing.value)[:POPULATION]
    return min(people, key=Packing.value).assignment()


STATE = "block int, island int, lengths array<int>, place array<int>, sequences int, evenness double"


def one_round(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Each row (block, island, lengths, elites) gets its island's best packing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = evolved(row["lengths"], capacity, hash((row["block"], row["island"], turn)), row["elites"] or [])
                count, even = of_assignment(row["lengths"], capacity, place).value()
                made = [[row["block"]], [row["island"]], [row["lengths"]], [place], [count], [float(even)]]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)],
                                                 names=["block", "island", "lengths", "place", "sequences", "evenness"])

    return state.select("block", "island", "lengths", "elites").mapInArrow(run, STATE)


def packed(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """`tokenised` rows with sequence_id and offset."""
    full = pieces.filter(F.col("length") == capacity).select(
        "*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.filter(F.col("length") < capacity)
    n_blocks = max(1, -(-open_.count() // block))
    blocks = stored(
        open_.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("uid", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("items")), "blocks")
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                          F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"),
                          F.lit(None).cast("array<array<int>>").alias("elites"))
    state = state.repartition(F.col("block"), F.col("island"))
    for turn in range(ROUNDS):
        ended = stored(one_round(state, capacity, turn), "islands")
        guests = ended.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
                              F.col("place").alias("guest"))
        state = ended.join(guests, ["block", "island"]).select(
            "block", "island", "lengths", F.array("place", "guest").alias("elites"))
    best = ended.groupBy("block").agg(F.min_by("place", F.struct("sequences", "evenness", "island")).alias("place"))
    # A sequence holds at most `capacity` pieces, so its window is small.
    rows = (blocks.join(best, "block")
            .select("block", F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("place").alias("place"))).alias("x"))
            .select("block", "x.item.*", F.col("x.place").alias("place")))
    before = Window.partitionBy("block", "place").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("uid", "doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("block").cast("long") * (1 << 31) + F.col("place")).alias("sequence_id"),
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return full.unionByName(placed)
