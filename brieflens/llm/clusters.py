"""Centroid clustering (k-means in integers) with PCA-rotated filtering.

A vector becomes the integers floor(scale * x).  Its leading coordinates in the
frame of the principal components and the norm of the rest are stored with it.
For a vector x and a centroid c

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

as the rest of a difference is at least the difference of the norms.  The
centroid with the least bound is measured first; those whose bound, less a
margin for rounding, does not exceed that distance survive and are measured in
integers, so the rotation never decides a result.

Moments, sums and counts are partial in each task and added by Spark; what comes
to the driver has k * (dims + 2) or dims^2 / 2 numbers, whatever the row count.

Cases: vectors that are null, of another length, or with a null or non-finite
component are left out; a component of 2^19 or more in size (at scale 256) raises
an overflow error, as its squared distance has no place in a long; fewer vectors
than k: as many centroids as vectors; no vector: an empty result; ties go to the
smaller centroid number; an empty centroid stays where it is; repeated rows are
vectors of their own; a null id is kept and hashes as the empty string; equal
hashes are ordered by components; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAD = 16  # leading rotated coordinates kept with a vector
LARGEST = 1 << 27  # of an integer component: squared distances then fit in a long
SLICE = 2048  # vectors filtered at once
PAIRS = 1 << 16  # survivors measured at once


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of int) of the vectors that are kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("x") == dims) & fine).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of `seed:id`, in that order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


# -- the rotation -----------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # columns: principal axes, by falling variance
    lead: int

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest."""
        y = (x - self.mean) @ self.axes
        return y[:, :self.lead], np.sqrt((y[:, self.lead:] ** 2).sum(axis=1))


def fitted_rotation(kept: DataFrame, dims: int, lead: int) -> Rotation:
    """Principal axes of all vectors, from their summed products."""
    up = np.triu_indices(dims + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(np.float64)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += x.T @ x
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(up[0]), dtype=np.int32)), pa.array(total[up])],
                                             names=["cell", "value"])

    sums = kept.select("v").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    full = np.zeros((dims + 1, dims + 1))
    for row in sums:
        full[up[0][row["cell"]], up[1][row["cell"]]] = row["value"]
    full += np.triu(full, 1).T
    n = max(full[0, 0], 1.0)
    mean = full[0, 1:] / n
    values, axes = np.linalg.eigh(full[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, np.argsort(-values, kind="stable")], min(lead, dims))


def rotated(kept: DataFrame, rotation: Rotation) -> DataFrame:
    """Stored: vec_id, v, lead, rest."""
    dims = len(rotation.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            if len(x) and max(-int(x.min()), int(x.max())) > LARGEST:
                raise OverflowError("a component is too large for squared distances in 64 bits")
            lead, rest = rotation.apply(x.astype(np.float64))
            ends = pa.array(np.arange(0, lead.size + 1, rotation.lead, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)],
                names=["vec_id", "v", "lead", "rest"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return stored(kept.mapInArrow(run, f"vec_id {kind}, v array<int>, lead array<double>, rest double"), "rotated")


# -- assignment -------------------------------------------------------------------------------------------------------------
class Nearest:
    """The nearest of some centroids: filtered by the bound, decided in integers."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation):
        self.centroids, self.measured = centroids, 0
        self.lead, self.rest = rotation.apply(centroids.astype(np.float64))
        self.square = (self.lead ** 2).sum(axis=1) + self.rest ** 2

    def distance(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        self.measured += len(k)
        return ((x - self.centroids[k]) ** 2).sum(axis=1)

    def of(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, for each row of x."""
        square = (lead ** 2).sum(axis=1) + rest ** 2
        both = square[:, None] + self.square
        bound = both - 2 * (lead @ self.lead.T + np.outer(rest, self.rest))
        best = bound.argmin(axis=1)
        least = self.distance(x, best)
        alive = bound - (1e-9 * both + 1e-6) <= least[:, None]
        alive[np.arange(len(x)), best] = False
        row, k = np.nonzero(alive)
        for a in range(0, len(row), PAIRS):
            r, c = row[a:a + PAIRS], k[a:a + PAIRS]
            d = self.distance(x[r], c)
            order = np.lexsort((c, d, r))
            order = order[np.unique(r[order], return_index=True)[1]]
            r, c, d = r[order], c[order], d[order]
            better = (d < least[r]) | ((d == least[r]) & (c < best[r]))
            best[r[better]], least[r[better]] = c[better], d[better]
        return best, least


def slices(batches: Iterator[pa.RecordBatch], near: Nearest) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, cluster numbers and distances, some rows at a time."""
    dims, lead = near.centroids.shape[1], near.lead.shape[1]
    for batch in batches:
        for a in range(0, len(batch), SLICE):
            part = batch.slice(a, SLICE)
            x = matrix(part.column(1), dims).astype(np.int64)
            yield part.column(0), x, *near.of(x, matrix(part.column(2), lead), part.column(3).to_numpy())


def totals(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> dict[int, list[int]]:
    """Of each cluster that is not empty: the sum of each component, the distance sum, the number of vectors; exact."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for _, x, best, least in slices(batches, Nearest(centroids, rotation)):
            for k in np.unique(best):
                here = best == k
                one = [*x[here].sum(axis=0).tolist(), sum(least[here].tolist()), int(here.sum())]
                sums[int(k)] = [p + q for p, q in zip(sums.get(int(k), [0] * len(one)), one, strict=True)]
        for k, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                 pa.array(map(Decimal, values), pa.decimal128(38, 0))], names=["cluster", "cell", "value"])

    rows = table.mapInArrow(run, "cluster int, cell int, value decimal(38,0)").groupBy("cluster", "cell").agg(
        F.sum("value").alias("value")).collect()
    found = {r["cluster"]: [0] * (dims + 2) for r in rows}
    for r in rows:
        found[r["cluster"]][r["cell"]] = int(r["value"])
    return found


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2,
             lead: int = LEAD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of int), centroid_sha256."""
    kept = integers(vectors, dims, scale, id_col, vec_col)
    centroids = first_centroids(kept, k, seed)
    kind = kept.schema["vec_id"].dataType.simpleString()
    shape = (f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, "
             "centroid_sha256 string")
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], shape)
    rotation = fitted_rotation(kept, dims, lead)
    table = rotated(kept, rotation)
    for _ in range(rounds):
        for c, sums in totals(table, centroids, rotation).items():
            centroids[c] = [s // sums[-1] for s in sums[:dims]]
    spread = {c: sums[-2] for c, sums in totals(table, centroids, rotation).items()}
    whole = sum(spread.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inertia = np.array([spread.get(c, 0) for c in range(len(centroids))], np.int64)
        for ids, x, best, least in slices(batches, Nearest(centroids, rotation)):
            ends = pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(best.astype(np.int32)), pa.array(least), pa.array(inertia[best]),
                 pa.array(np.full(len(x), whole, np.int64)),
                 pa.ListArray.from_arrays(ends, pa.array(centroids[best].ravel())), pa.array([names[c] for c in best])],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"])

    return table.mapInArrow(run, shape)


def oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same in DuckDB, without a filter: every vector is measured against every centroid."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c
  FROM v QUALIFY k < {k})"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS best
  FROM (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            parts.append(f"""s{t} AS (
  SELECT best.k AS k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {dims + 1}) g(i) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (
  SELECT c{t}.k, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY k) m ON m.k = c{t}.k)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k
"""
