"""Fresh answers against a plain loop, also for one busy key without a gap."""

import numpy as np
from pyspark.sql import functions as F

from brieflens.operators import answers as A


def brute(rows, ttl):
    since, fresh = {}, set()
    seen = {}
    for key, at, i in rows:
        if at is not None:
            seen[key, at] = min(i, seen.get((key, at), i))
    for (key, at), i in sorted(seen.items(), key=lambda x: (x[0][0] or "", x[0][0] is None, x[0][1])):
        if key not in since or at - since[key] > ttl:
            since[key] = at
            fresh.add(i)
    return fresh


def found(spark, rows, ttl):
    df = A.answer_first_seen(spark.createDataFrame(rows, "key string, at double, id long"), ttl)
    out = df.collect()
    assert len(out) == len(rows)
    return {r["id"] for r in out if r["fresh"]}


def test_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(A, "FAN", 3)
    r = np.random.default_rng(4)
    rows = []
    for key, n, span in (("a", 120, 300.0), ("b", 60, 2000.0), (None, 50, 500.0), ("", 20, 400.0), ("c", 1, 9.0)):
        at = np.round(r.uniform(-span / 2, span, n), 1)
        rows += [(key, float(x), len(rows) + k) for k, x in enumerate(at)]
    rows += [("d", 10.0 * k, 10_000 + k) for k in range(40)] + [("d", 100.0, 20_000), ("d", None, 20_001)]  # steps as long as an answer serves
    assert found(spark, rows, 10.0) == brute(rows, 10.0)


def test_no_questions(spark):
    assert found(spark, [], 10.0) == set() and found(spark, [("a", None, 1)], 10.0) == set()


def test_one_busy_key_is_many_tasks(spark):
    n, ttl = 1_000_000, 3600.0
    df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7.25 + F.pmod(F.xxhash64("id"), F.lit(7))).alias("at"), "id")
    got = {r["id"] for r in A.answer_first_seen(df, ttl).filter("fresh").select("id").collect()}
    at = df.select("at").toArrow().column("at").to_numpy()
    order, since, want = np.argsort(at, kind="stable"), None, set()
    for i in order.tolist():
        if since is None or at[i] - since > ttl:
            since = at[i]
            want.add(i)
    assert got == want and len(want) > 1900
