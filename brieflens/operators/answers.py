"""Repeated questions: which are answered afresh, when an answer serves for a time.

The clock of a key runs from its last fresh answer, so the rule is a fold over the
key's times.  It is cut up by composing functions of the state.  Time is dealt
into ranges as long as an answer serves, and `FAN` ranges make a block.  What a
block does depends on the last fresh time only if that lies in the range just
before it; older ones all act alike.  So a block is a finite function: from each
distinct time of the range before it, or none, to its own last fresh time, or none
if that is not in its last range.  Functions of `FAN` neighbours are composed into
one, level by level, until a key has one; then the state each block meets is handed
down the levels, and every block lists its fresh times.

A task sees one block of one key (or the functions of `FAN` blocks), so a key with a
third of all questions is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.shared import stored

FAN = 32
FUNCTION = "block bigint, dom array<double>, outs array<double>, out_none double"


def later(times: np.ndarray, since: np.ndarray, ttl: float) -> np.ndarray:
    """For each `since` the first place whose time less `since` exceeds `ttl`; times ascend."""
    at = np.searchsorted(times, since + ttl, side="right")
    while True:  # the sum may round otherwise than the difference
        low = (at > 0) & (times[np.maximum(at - 1, 0)] - since > ttl)
        high = (at < len(times)) & ~(times[np.minimum(at, len(times) - 1)] - since > ttl)
        if not (low.any() or high.any()):
            return at
        at = at - low + (high & ~low)


def last_fresh(times: np.ndarray, ttl: float) -> np.ndarray:
    """For each time, if it is fresh, the place of the last fresh time."""
    n = len(times)
    step = later(times, times, ttl)
    end = np.where(step < n, step, np.arange(n))
    while True:
        further = end[end]
        if (further == end).all():
            return end
        end = further


def block_function(times: np.ndarray, ranges: np.ndarray, before: np.ndarray, last: int, ttl: float) -> tuple[np.ndarray, float]:
    """Last fresh time, nan unless in range `last`, for each last fresh time of `before`, and for none."""
    end = last_fresh(times, ttl)
    out = np.where(ranges[end] == last, times[end], np.nan)
    at = later(times, before, ttl)
    return np.where(at < len(times), out[np.minimum(at, len(times) - 1)], np.nan), float(out[0])


def applied(state: np.ndarray, dom: np.ndarray, outs: np.ndarray, out_none: float) -> np.ndarray:
    """A block's function for some states (nan: none)."""
    if not len(dom):
        return np.full(len(state), out_none)
    at = np.minimum(np.searchsorted(dom, np.nan_to_num(state, nan=dom[0])), len(dom) - 1)
    return np.where(np.isnan(state), out_none, outs[at])


def walked(times: np.ndarray, since: float, ttl: float) -> np.ndarray:
    """The fresh times, after a fresh one at `since` (nan: none)."""
    found = []
    at = 0 if np.isnan(since) else int(later(times, np.array([since]), ttl)[0])
    while at < len(times):
        found.append(times[at])
        at = int(later(times, times[at:at + 1], ttl)[0])
    return np.array(found)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _functions(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    rows = table.select(["block", "dom", "outs", "out_none"]).sort_by("block").to_pylist()
    return [(r["block"], np.array(r["dom"], float), np.array(r["outs"], float), r["out_none"]) for r in rows]


def answer_first_seen(questions: DataFrame, ttl: float = fixed.ANSWER_TTL_SECONDS) -> DataFrame:
    """Questions answered afresh; repeats within `ttl` seconds of the last fresh answer are marked: key, id, fresh.

    `questions`: key (string), at (epoch seconds, double), id.  Of several questions of one key and time the
    smallest id is the fresh one.  A null key is a key; a question without a time is not fresh.
    """
    known = questions.select("key", F.coalesce("key", F.lit("")).alias("k"), F.col("key").isNull().alias("nk"), "at", "id").filter("at IS NOT NULL")
    firsts = known.groupBy("k", "nk", "at").agg(F.min("id").alias("id"))
    firsts = stored(firsts.withColumn("range", F.floor(F.col("at") / ttl)), "asked")
    span = firsts.agg(F.min("range").alias("low"), F.max("range").alias("high")).first()
    marked = lambda fresh: questions.join(fresh, "id", "left").select("key", "id", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    if span["low"] is None:
        return questions.select("key", "id", F.lit(False).alias("fresh"))
    low, high = span["low"], (span["high"] - span["low"]) // FAN
    times = firsts.withColumn("range", F.col("range") - low).withColumn("block", F.floor(F.col("range") / FAN))

    def first_level(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at, ranges, own = (_numbers(group.column(c)) for c in ("at", "range", "own"))
        k, nk, block = (group.column(c)[0].as_py() for c in ("k", "nk", "block"))
        if not own.any():
            return pa.Table.from_pylist([], schema=shape)
        outs, none = block_function(at[own], ranges[own], at[~own], (block + 1) * FAN - 1, ttl)
        return pa.Table.from_pylist([{"k": k, "nk": nk, "block": block, "dom": at[~own].tolist(), "outs": outs.tolist(), "out_none": none}], schema=shape)

    shape = pa.schema([("k", pa.string()), ("nk", pa.bool_()), ("block", pa.int64()), ("dom", pa.list_(pa.float64())),
                       ("outs", pa.list_(pa.float64())), ("out_none", pa.float64())])
    # the last range of a block goes to the next block as well
    sent = times.select("k", "nk", "at", "range", F.explode(F.when(F.col("range") % FAN == FAN - 1, F.array(
        F.struct("block", F.lit(True).alias("own")), F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct("block", F.lit(True).alias("own"))))).alias("to")).select("k", "nk", "at", "range", "to.*")
    ddl = f"k string, nk boolean, {FUNCTION}"
    levels = [stored(sent.groupBy("k", "nk", "block").applyInArrow(first_level, ddl), "answer-functions")]

    def composed(group: pa.Table) -> pa.Table:
        children = _functions(group)
        parent = children[0][0] // FAN
        dom = children[0][1] if children[0][0] % FAN == 0 else np.zeros(0)
        state, before = np.append(dom, np.nan), children[0][0] - 1
        for block, own, outs, none in children:
            state = applied(state if block == before + 1 else np.full(len(state), np.nan), own, outs, none)
            before = block
        if before % FAN != FAN - 1:
            state[:] = np.nan
        return pa.Table.from_pylist([{"k": group.column("k")[0].as_py(), "nk": group.column("nk")[0].as_py(), "block": parent, "dom": dom.tolist(),
                                      "outs": state[:-1].tolist(), "out_none": float(state[-1])}], schema=shape)

    while high > 0:
        up = levels[-1].withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(stored(up.groupBy("k", "nk", "parent").applyInArrow(composed, ddl), "answer-functions"))
        high //= FAN

    def handed(group: pa.Table) -> pa.Table:
        state, rows = np.array([group.column("met")[0].as_py()], float), []
        before = None
        for block, dom, outs, none in _functions(group):
            if before is not None and block != before + 1 or before is None and block % FAN:
                state = np.array([np.nan])
            rows.append({"k": group.column("k")[0].as_py(), "nk": group.column("nk")[0].as_py(), "block": block, "met": float(state[0])})
            state, before = applied(state, dom, outs, none), block
        return pa.Table.from_pylist(rows, schema=pa.schema([*list(shape)[:3], ("met", pa.float64())]))

    met = levels[-1].select("k", "nk", "block", F.lit(float("nan")).alias("met"))
    for functions in reversed(levels[:-1]):
        parents = met.withColumnRenamed("block", "parent")
        down = functions.withColumn("parent", F.floor(F.col("block") / FAN)).join(parents, ["k", "nk", "parent"])
        met = stored(down.groupBy("k", "nk", "parent").applyInArrow(handed, "k string, nk boolean, block bigint, met double"), "answer-states")

    def listed(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at = _numbers(group.column("at"))
        fresh = walked(at, group.column("met")[0].as_py(), ttl)
        return pa.table({"id": group.column("id").take(pa.array(np.searchsorted(at, fresh)))})

    kind = questions.schema["id"].dataType.simpleString()
    fresh = times.join(met, ["k", "nk", "block"]).select("k", "nk", "block", "at", "id", "met").groupBy("k", "nk", "block").applyInArrow(
        listed, f"id {kind}")
    return marked(fresh.withColumn("fresh", F.lit(True)))
