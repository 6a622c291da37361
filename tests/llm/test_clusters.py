"""Centroid clustering against a loop in exact integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.errors import PythonException

from brieflens.llm import clusters as C

SHAPE = "vec_id long, embedding array<float>, cluster int, Inertia string"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cent = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cent[n] = [sum(col) // len(vs) for col in zip(*vs)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in last)
    return sorted(((i, n, d, sum(e for _, m, e in last if m == n), total,
                    hashlib.sha256(",".join(map(str, cent[n])).encode()).hexdigest()) for i, n, d in last), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.drop("centroid").collect()), key=repr)


def made(n, dims, seed=3, groups=6):
    r = np.random.default_rng(seed)
    mid = r.normal(0, 0.4, (groups, dims))
    return [(int(i), [float(x) for x in mid[r.integers(groups)] + r.normal(0, 0.1, dims)], 0, "x") for i in range(n)]


def test_equals_brute_force(spark):
    rows = made(300, 8)
    rows += [rows[0], rows[1]] * 40  # repeated rows
    rows += [(1000, None, 0, None), (1001, [0.5] * 7, 0, None), (1002, [0.5] * 9, 0, None), (1003, [None] + [0.5] * 7, 0, None),
             (1004, [float("nan")] * 8, 0, None), (1005, [float("inf")] * 8, 0, None), (1006, [], 0, None), (None, [0.25] * 8, 0, None)]
    for lead in (2, 5, 8):
        got = C.clusters(spark.createDataFrame(rows, SHAPE).repartition(5), k=12, rounds=3, dims=8, lead=lead)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
        assert found(got) == brute(rows, 12, 3, 8)


def test_ties_and_empty_centroids(spark):
    # four equal first centroids: all vectors go to the first of them, the others stay empty
    rows = [(i, [1.0, 1.0], 0, "") for i in range(6)] + [(i, [float(i % 3), -0.001], 0, "") for i in range(6, 20)]
    for k in (4, 30):  # 30: more centroids than vectors
        assert found(C.clusters(spark.createDataFrame(rows, SHAPE), k=k, rounds=4, dims=2)) == brute(rows, k, 4, 2)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 0, "")]):
        df = C.clusters(spark.createDataFrame(rows, SHAPE), dims=2)
        assert df.collect() == [] and "centroid_sha256" in df.columns


def test_equal_vectors_have_no_axes(spark):
    rows = [(i, [0.5] * 4, 0, "") for i in range(30)]
    assert found(C.clusters(spark.createDataFrame(rows, SHAPE), k=3, rounds=2, dims=4)) == brute(rows, 3, 2, 4)


def test_too_large_components_raise(spark):
    with pytest.raises(PythonException, match="too large"):
        C.clusters(spark.createDataFrame([(1, [1e6, 0.0], 0, "")], SHAPE), dims=2).collect()


def test_filter_leaves_few_to_measure_and_loses_none():
    rows = np.floor(256 * np.array([v for _, v, *_ in made(2000, 64, groups=40)])).astype(np.int64)
    mean = rows.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(rows.T))
    turn = C.Rotation(mean, axes[:, ::-1], C.LEAD)
    near = C.Nearest(rows[:40].copy(), turn)
    best, least = near.of(rows, *turn.apply(rows.astype(float)))
    every = ((rows[:, None, :] - rows[None, :40, :]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert near.measured < 0.4 * every.size


def test_oracle_at_small_scale(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(C.oracle())
    at = [[c[0] for c in cur.description].index(x) for x in
          ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    want = sorted((tuple(r[c] for c in at) for r in cur.fetchall()), key=repr)
    assert found(C.clusters(spark.read.parquet(f"{sf}/embeddings.parquet"))) == want
