"""Exact n-gram Jaccard self-join: count-vector R-tree over blocks of sets that share a group's content.

A document is the set of its distinct word n-grams; two sets link when their
Jaccard similarity reaches num/den.  Equal sets are one class from the start.

Candidates.  Hash the n-grams of a set into groups.  Sets that link differ in at
most H n-grams, H known from their sizes, so at most H groups differ and some
group that is not empty has the same content in both, once a set has more than H
filled groups.  The hash of (size band, group, content) is a key; by the
prefix-filter argument the H + 1 smallest keys of each set are enough.  Sets with
too few filled groups also give every n-gram as a key, which covers pairs of
such sets.  A common line or passage rarely fills a group alone, so it rarely
makes a key, and no n-gram statistics are needed.

Equal sets are reduced to one row before their keys are dealt out.

Links.  In a block (the sets of one key) every set is first compared with the
set that has the most keys in common with others, then with one of another
component; verified links contract blocks of near copies to few components.
Each such pair first meets the bound below on its count vectors, so that whole
sets are moved only for pairs that survive it.
Blocks that still hold several components are indexed: the points
are the counts of n-grams by hash group, the nodes of a packed R-tree hold the
largest and smallest counts below them, and the sum of coordinate minima bounds
the overlap of a query with all sets of a node.  Pairs of different components
that survive the bound are verified on the sets.  Links inside a component are
not looked for, as they cannot change it.  Large blocks are cut into tiles and
every pair of tiles is a task of its own, so no block has to fit in one task.

Cases: null text, no text or white space alone: an empty set that links with
nothing; fewer words than n: the whole sequence is the one n-gram; repeated rows
and equal texts are one class; a null id takes part but is never the smallest; an
empty table gives an empty result.  Sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, free_name, stored, whole_text
from .components import components

DIMS = 256  # coordinates of a count vector
LEAF, FANOUT = 16, 16
TILE = 2048
STARS = 2  # rounds in which a block is compared with one of its sets
SPARE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28  # bits a value in the membership bitmaps sent to tasks; at most 32 MB
SEED = 0x9E3779B97F4A7C15


def odd(k: int) -> np.uint64:
    """A constant of its own for each small number."""
    return np.uint64(k * SEED % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; only A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x100000001B3) + mixed(h[k:len(h) - width + 1 + k])
    return np.unique(mixed(total))


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Likeness:
    """Jaccard similarity of at least num/den."""

    num: int
    den: int

    def links(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)

    def overlap(self, a, b):
        """The least overlap of linked sets of sizes a and b (numbers or arrays)."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, a: int, b: int) -> int:
        """The most n-grams in which linked sets of sizes a and b differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def smallest(self, b: int) -> int:
        return -(-b * self.num // self.den)


def band_edges() -> list[int]:
    """First sizes of the bands: each half as large again as the one before."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


EDGES = band_edges()


@lru_cache(maxsize=None)
def group_count(band: int, like: Likeness) -> int:
    """So many groups that a set of the band's smallest size fills more than enough of them, six deviations off."""
    low, high = EDGES[band], EDGES[band + 1] - 1
    need = like.differ(high, like.largest(high)) + 1
    g = need
    while g < 4 * low + 4:
        q, q2 = (1 - 1 / g) ** low, (1 - 2 / g) ** low if g > 1 else 0.0
        spread = sqrt(max(0.0, g * q + g * (g - 1) * q2 - (g * q) ** 2))
        if g * (1 - q) - 6 * spread >= need:
            break
        g += max(1, g // 16)
    return g


def keys_in(grams: np.ndarray, band: int, most: int, like: Likeness) -> np.ndarray:
    """Keys of a set in a band: the `most` + 1 smallest of its filled groups; every n-gram too if those are too few."""
    groups = group_count(band, like)
    at = (grams >> np.uint64(20)) % np.uint64(groups)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    content = np.add.reduceat(mixed(grams[order] ^ odd(1)), first)
    keys = np.sort(mixed(content + mixed(at[first] * odd(1) + np.uint64(band + 1))))
    if len(keys) > most:
        return keys[:most + 1]
    return np.concatenate([keys, mixed(grams + odd(band + 2))])


def set_keys(grams: np.ndarray, like: Likeness) -> np.ndarray:
    """Keys in the set's own band and in each lower band that has sets it may link with."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    parts = [keys_in(grams, band, like.differ(n, like.largest(n)), like)]
    low = like.smallest(n)
    while band and EDGES[band] - 1 >= low:
        parts.append(keys_in(grams, band - 1, like.differ(n, EDGES[band] - 1), like))
        band -= 1
    return np.concatenate(parts)


def count_vector(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)


def packed_counts(grams: np.ndarray) -> bytes:
    """The count vector in bytes where all counts fit one, else in four each; the length tells."""
    counts = count_vector(grams)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def counts_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "u1" if len(packed) == DIMS else "<u4").astype(np.int32)


# -- the index ------------------------------------------------------------------------------------------------------------
class CountTree:
    """Packed R-tree over count vectors; nodes know the largest counts and the range of sizes below them."""

    def __init__(self, points: np.ndarray, like: Likeness):
        sizes = points.sum(axis=1)
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2] if len(points) else [0, 0]
        # Sort-tile: by size, then slices of some leaves by the two coordinates that vary most.
        order = np.argsort(sizes, kind="stable")
        run = LEAF * FANOUT
        self.order = np.concatenate([part[np.lexsort((points[part, spread[1]], points[part, spread[0]] // 4))]
                                     for part in (order[a:a + run] for a in range(0, len(order), run))]) if len(order) else order
        self.points, self.sizes, self.like = points[self.order], sizes[self.order], like
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while True:
            cuts = np.arange(0, len(top), step)
            if not len(cuts):
                break
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))
            step = FANOUT
            if len(top) == 1:
                break

    def near(self, q: np.ndarray) -> np.ndarray:
        """Places (in the given order of points) of all points whose bound lets them link with q."""
        n = int(q.sum())
        least, most = self.like.smallest(n), self.like.largest(n)
        nodes = np.zeros(min(1, len(self.levels)), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (high[nodes] >= least) & (low[nodes] <= most)
            nodes = nodes[fits]
            bound = np.minimum(top[nodes], q).sum(axis=1)
            nodes = nodes[bound >= self.like.overlap(n, np.maximum(low[nodes], least))]
            below = LEAF if depth == 0 else FANOUT
            count = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            nodes = (nodes[:, None] * below + np.arange(below)).ravel()
            nodes = nodes[nodes < count]
        sizes = self.sizes[nodes]
        nodes = nodes[(sizes >= least) & (sizes <= most)]
        bound = np.minimum(self.points[nodes], q).sum(axis=1)
        return self.order[nodes[bound >= self.like.overlap(n, self.sizes[nodes])]]


def block_pairs(rows: dict[str, np.ndarray], like: Likeness) -> Iterator[tuple[int, int]]:
    """Pairs of a block's tiles that may link: different components, neither a hub of the block, bound passed."""
    points, sid, comp, tile, hub = rows["vec"], rows["sid"], rows["comp"], rows["tile"], rows["hub"]
    tree = CountTree(points, like)
    apart = len(np.unique(tile)) > 1
    for k in range(len(sid)):
        if hub[k]:  # tested against all of the block
            continue
        hits = tree.near(points[k])
        hits = hits[(comp[hits] != comp[k]) & ~hub[hits] & (sid[hits] > sid[k])]
        if apart:
            hits = hits[tile[hits] != tile[k]]
        for other in sid[hits]:
            yield int(sid[k]), int(other)


# -- Spark ----------------------------------------------------------------------------------------------------------------
def shingled(docs: DataFrame, n: int, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Stored: doc_id, n_shingles, sid (null: empty set), keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, keys, ends = [], [], [], [0]
            for text in batch.column(1):
                grams = ngram_set(text.as_py() or "", n)
                sizes.append(len(grams))
                ids.append(set_id(grams) if len(grams) else None)
                keys.append(set_keys(grams, like))
                ends.append(ends[-1] + len(keys[-1]))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "n_shingles", "sid", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, sid long, keys array<long>"), "shingles")


def bitmap(values: DataFrame) -> np.ndarray:
    """Which hash values the one column of `values` holds: SPARE bits for each, MOST_BITS at most; more values than
    that let more others through, which the exact joins that follow take out."""
    count = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARE * count).bit_length()))
    slot = F.pmod(F.col(values.columns[0]), F.lit(bits))
    found = values.select((slot / 64).cast("int").alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def occurs(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have their bit set in a `bitmap`."""
    slot = values % (64 * len(words))
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1


def repeated(sets: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The sets (sid, keys) that may occur in several rows, one row each, and the bitmap that tells them."""
    again = stored(sets.groupBy("sid").agg(F.count("*").alias("rows")).filter("rows > 1").select("sid"), "again")
    words = bitmap(again)
    shared = sets.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(seen) > 1_000_000:
                seen.clear()
            new = [k for k in np.flatnonzero(occurs(shared.value, ids)) if not (ids[k] in seen or seen.add(ids[k]))]
            yield batch.take(pa.array(new, pa.int64()))

    rows = sets.mapInArrow(run, "sid long, keys array<long>")
    return stored(rows.groupBy("sid").agg(F.first("keys").alias("keys")), "repeated"), words


def key_rows(sets: DataFrame, known: np.ndarray | None = None, leave: np.ndarray | None = None) -> DataFrame:
    """(key, sid) of `sets` (sid, keys) but those in the bitmap `leave`; with the bitmap `known` only its keys, and
    how many of the set's keys are in it."""
    shared = sets.sparkSession.sparkContext.broadcast((known, leave))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, without = shared.value
        for batch in batches:
            if without is not None:
                batch = batch.filter(pa.array(~occurs(without, batch.column(0).to_numpy())))
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                keys = part.column(1).flatten().to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(len(part)), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                made = [keys, part.column(0).to_numpy()[place]]
                if there is not None:
                    use = occurs(there, keys)
                    common = np.bincount(place[use], minlength=len(part))
                    made = [keys[use], made[1][use], common[place[use]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["key", "sid", "common"][:len(made)])

    return sets.mapInArrow(run, "key long, sid long" + (", common long" if known is not None else ""))


def gram_rows(docs: DataFrame, n: int, known: np.ndarray, text_col: str) -> DataFrame:
    """Stored by sid: sid, vec, grams of the sets in the bitmap, one row each; see `bucketed`."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        seen: set[int] = set()
        for batch in batches:
            out, held = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            for text in batch.column(0):
                grams = ngram_set(text.as_py() or "", n)
                if len(grams):
                    sid = set_id(grams)
                    if sid not in seen and occurs(there, np.int64(sid)):
                        seen.add(sid)
                        out.append((sid, packed_counts(grams), grams.view(np.int64)))
                        held += len(grams)
                        if held >= 500_000:  # some megabytes at once, however long the texts
                            yield rows_of(out)
                            out, held = [], 0
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(x[2]) for x in out])
        flat = np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["sid", "vec", "grams"])

    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "sid long, vec binary, grams array<long>")
    once = rows.groupBy("sid").agg(F.first("vec").alias("vec"), F.first("grams").alias("grams"))
    return bucketed(once, "grams", "sid")[0]


def with_column(pairs: DataFrame, grams: DataFrame, column: str) -> DataFrame:
    """a, b and this column of both sets, as x and y.

    b, which is in few pairs, is joined where its row lies; a, which may be the
    hub of very many, by a shuffle of the rows that pairs ask for.  Those are
    stored first: bucketed rows would not be shuffled, and adaptive execution
    splits the pairs of a hub between two shuffles only.
    """
    asked = grams.join(pairs.select(F.col("a").alias("sid")).distinct(), "sid", "left_semi")
    asked = stored(asked.select(F.col("sid").alias("a"), F.col(column).alias("x")), "asked")
    of_b = grams.select(F.col("sid").alias("b"), F.col(column).alias("y"))
    return pairs.join(of_b, "b").join(asked, "a").select("a", "b", "x", "y")


def tested(pairs: DataFrame, grams: DataFrame, column: str, test, name: str) -> DataFrame:
    """Stored: the (a, b) of `pairs` whose values of `column` pass the test."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [test(x[k], y[k]) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(with_column(pairs, grams, column).mapInArrow(run, "a long, b long"), name)


def verified(pairs: DataFrame, grams: DataFrame, like: Likeness) -> DataFrame:
    """The (a, b) of `pairs` that link: first the bound on count vectors, then the whole sets of those that pass it."""
    def bounded(x: pa.Scalar, y: pa.Scalar) -> bool:
        p, q = counts_of(x.as_py()), counts_of(y.as_py())
        return like.links(int(np.minimum(p, q).sum()), int(p.sum()), int(q.sum()))

    def linked(x: pa.Scalar, y: pa.Scalar) -> bool:
        p, q = x.values.to_numpy(), y.values.to_numpy()
        return like.links(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))

    return tested(tested(pairs, grams, "vec", bounded, "bounded"), grams, "grams", linked, "links")


def different_blocks(members: DataFrame) -> DataFrame:
    """One block of those that hold the same sets: two near copies share many keys, but need one comparison."""
    blocks = members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("one"),
                                        F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("two"))
    first = blocks.filter("size > 1").groupBy("size", "one", "two").agg(F.min("key").alias("key")).select("key")
    return members.join(first, "key", "left_semi")


def of_several(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored: the blocks of `members` (key, sid, common, hub) that hold several components, with comp, size and
    `near`, the component of the block's hubs."""
    labelled = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", "common", "hub", F.coalesce("root", "sid").alias("comp"))
    blocks = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"),
                                         F.max(F.when(F.col("hub"), F.col("comp"))).alias("near"))
    return stored(labelled.join(blocks.filter("low < high AND size > 2").drop("low", "high"), "key"), "blocks")


def central(members: DataFrame) -> DataFrame:
    """(key, first, home) of each block: its set with the most common keys, and that set's component.

    Edits make keys that no other set has, so this is the least edited copy of a
    block of near copies, and most of the block links with it.
    """
    best = members.groupBy("key").agg(F.max(F.struct("common", "sid", "comp")).alias("best"))
    return best.select("key", F.col("best.sid").alias("first"), F.col("best.comp").alias("home"))


def residual_pairs(members: DataFrame, grams: DataFrame, like: Likeness) -> DataFrame:
    """Pairs that the index lets through in blocks that still hold several components."""
    rows = members.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    rows = rows.join(grams.select("sid", "vec"), "sid")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.select("key", "sid", "hub", "comp", "tile", "vec", other.alias("other"))
    rows = rows.select("key", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "sid", "hub", "comp", "tile", "vec")
    cell = ["key", "one", "two"]
    rows = rows.repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            rows = {c: table.column(c).to_numpy() for c in ("sid", "comp", "tile", "hub")}
            rows["vec"] = np.stack([counts_of(x) for x in table.column("vec").to_pylist()])
            made: list[tuple[int, int]] = []
            for pair in block_pairs(rows, like):
                made.append(pair)
                if len(made) >= 65536:
                    yield packed(made)
                    made = []
            if made:
                yield packed(made)

        def packed(made: Iterable[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(made, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        waiting: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1)))) if len(ids) else []
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                here = tuple(ids[a])
                if here != current and waiting:
                    yield from pairs(waiting)
                    waiting = []
                current = here
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from pairs(waiting)

    return rows.mapInArrow(run, "a long, b long").distinct()


def joined(docs: DataFrame, n: int = 5, like: Likeness = Likeness(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest id that links lead to)."""
    sets = shingled(docs, n, like, id_col, text_col)
    filled = sets.filter("sid IS NOT NULL").select("sid", "keys")
    few, again = repeated(filled)
    keys = key_rows(filled, leave=again).union(key_rows(few))
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "keys")
    known = bitmap(shared)
    keys = key_rows(filled, known, again).union(key_rows(few, known))
    members = keys.join(shared, "key", "left_semi").distinct()
    members = stored(different_blocks(stored(members, "members")), "members")
    grams = gram_rows(docs, n, bitmap(members.select("sid").distinct()), text_col)
    blocks = members.withColumns({"comp": F.col("sid"), "hub": F.lit(False)})
    links = None
    for turn in range(STARS):
        hubs = stored(central(blocks.filter("NOT hub AND comp != near") if turn else blocks), "hubs")
        met = blocks.join(hubs, "key")
        pairs = stored(met.filter("comp != home").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct(), "pairs")
        found = verified(pairs, grams, like)
        links = found if links is None else links.union(found)
        marked = met.select("key", "sid", "common", (F.col("hub") | (F.col("sid") == F.col("first"))).alias("hub"))
        blocks = of_several(marked, components(links))
    links = links.union(verified(stored(residual_pairs(blocks, grams, like), "pairs"), grams, like))
    roots = components(links)
    rows = sets.select("doc_id", "n_shingles", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "sid").alias("node"))
    least = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, n: int = 5, like: Likeness = Likeness(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, with all their columns; rows without an id stay."""
    found = joined(docs, n, like, id_col, text_col)
    gone = free_name(docs.columns, "gone_id")
    others = found.filter("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col(id_col) == F.col(gone), "left_anti")
