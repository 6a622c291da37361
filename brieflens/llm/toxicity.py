"""Toxicity scores from a factorization machine over hashed terms.

Beside a weight per term the machine learns a vector per term, whose products
score pairs of terms in one text (an insult with a group mention).  It is fitted
on the driver on a bounded sample of labelled rows: `max_rows` of them at most in
expectation, chosen by a hash of the id, so the sample does not depend on how
the table is split.  Scores are computed inside Arrow batches with the small
model (the terms that tell most: MIN_ROWS sample rows and a log-likelihood gain
of MIN_GAIN at least, MAX_TERMS at most).

Cases: null or empty texts get the score of a text without known terms; a row
without label or id is scored but never learnt from; of several labels for one
id the larger counts; without any usable label (or an empty table) every score
is 0; repeated rows get equal scores; a text of any length is scored whole.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

BUCKETS = 1 << 24
MAX_ROWS = 20_000
MIN_ROWS, MIN_GAIN, MAX_TERMS, FACTORS = 4, 16.0, 4096, 4
EPOCHS, MIN_STEPS, BATCH, RATE, LASSO, RIDGE = 12, 400, 256, 0.05, 2e-4, 1e-3
REJECT = 0.7
WORD = re.compile(r"[^\W_]+")


def is_held_out(ident):
    """Rows that nothing may be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(ident.cast("string").cast("binary")) % 3 == 1


def terms(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


@dataclass
class Machine:
    """score = squash(bias + sum of weights + half of (square of the vectors' sum - sum of their squares))."""

    known: np.ndarray  # bucket of each term, rising
    weight: np.ndarray
    vector: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows given as positions in `known`."""
        out = np.full(len(rows), self.bias)
        for k, at in enumerate(rows):
            if len(at):
                v = self.vector[at]
                s = v.sum(axis=0)
                out[k] += self.weight[at].sum() + 0.5 * (s @ s - (v * v).sum())
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.margin(rows) * self.scale + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))

    def places(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, buckets)
        at[at == len(self.known)] = 0
        return at[self.known[at] == buckets] if len(self.known) else at[:0]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int) -> pa.Table:
    """(toxic, buckets) of at most about `max_rows` labelled rows that are not held out."""
    ident = F.col(id_col)
    usable = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic")))
    share = min(1.0, max_rows / max(1, usable.count()))
    chosen = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(ident.alias("label_id"), whole_text(text_col).alias("text")).filter(~is_held_out(ident) & chosen(ident))
    rows = rows.join(usable.filter(chosen(F.col("label_id"))), "label_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({bucket(x) for x in terms(t.as_py())}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "buckets"])

    return rows.mapInArrow(run, "toxic int, buckets array<int>").toArrow()


def fitted(table: pa.Table, seed: int = 7) -> Machine:
    """Train on four fifths of the sample, set the scale on the last fifth so that the best cut is REJECT."""
    lists = table.column("buckets").combine_chunks()
    rows = np.split(lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    y = np.asarray(table.column("toxic").to_pylist(), float)
    order = sorted(range(len(rows)), key=lambda k: (zlib.crc32(rows[k].tobytes()), y[k]))
    rows, y = [rows[k] for k in order], y[order]
    if not len(rows) or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), -30.0)
    buckets, counts = np.unique(np.concatenate(rows), return_counts=True)
    toxic_rows = [r for r, t in zip(rows, y, strict=True) if t]
    hits = np.zeros(len(buckets))
    for r in toxic_rows:
        hits[np.searchsorted(buckets, r)] += 1
    base = y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):  # twice the log-likelihood ratio of a term's rows against all
        gain = 2 * (np.nan_to_num(hits * np.log(hits / (counts * base)))
                    + np.nan_to_num((counts - hits) * np.log((counts - hits) / (counts * (1 - base)))))
    use = np.flatnonzero((counts >= MIN_ROWS) & (gain >= MIN_GAIN))
    use = np.sort(use[np.argsort(-gain[use], kind="stable")[:MAX_TERMS]])
    rng = np.random.default_rng(seed)
    model = Machine(buckets[use], np.zeros(len(use)), rng.normal(0, 0.01, (len(use), FACTORS)), float(np.log(base / (1 - base))))
    rows = [model.places(r) for r in rows]
    held = len(rows) // 5
    learn, tune = range(held, len(rows)), range(held)
    sum_w, sum_v = np.full(len(use), 1e-2), np.full((len(use), FACTORS), 1e-2)
    for _ in range(max(EPOCHS, MIN_STEPS * BATCH // max(1, len(learn)))):
        turn = rng.permutation(learn)
        for a in range(0, len(turn), BATCH):
            part = turn[a:a + BATCH]
            sizes = np.array([len(rows[k]) for k in part])
            at = np.concatenate([rows[k] for k in part])
            if not len(at):
                continue
            owner = np.repeat(np.arange(len(part)), sizes)
            v = model.vector[at]
            s = np.stack([np.bincount(owner, v[:, f], len(part)) for f in range(FACTORS)], axis=1)
            square = np.bincount(owner, (v * v).sum(axis=1), len(part))
            z = model.bias + np.bincount(owner, model.weight[at], len(part)) + 0.5 * ((s * s).sum(axis=1) - square)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            model.bias -= RATE * slope.sum()
            g = np.bincount(at, slope[owner], len(use))
            sum_w += g * g
            step = RATE / np.sqrt(sum_w)
            w = model.weight - step * g
            model.weight = np.sign(w) * np.maximum(0, np.abs(w) - step * LASSO)
            pull = slope[owner][:, None] * (s[owner] - v)
            gv = np.stack([np.bincount(at, pull[:, f], len(use)) for f in range(FACTORS)], axis=1) + RIDGE * model.vector
            sum_v += gv * gv
            model.vector = model.vector - RATE * gv / np.sqrt(sum_v)
    return calibrated(model, [rows[k] for k in tune], y[list(tune)])


def calibrated(model: Machine, rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Shift the margins so that the cut with the best F1 (the middle of the gap) scores REJECT."""
    z = model.margin(rows)
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(y[order])
    if not len(z) or not hit[-1]:
        return model
    f1 = 2 * hit / (np.arange(len(z)) + 1 + hit[-1])
    k = int(np.argmax(f1))
    edge = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1
    gap = float(z[k] - edge)
    model.scale = min(20.0, max(1.0, 2 / gap)) if gap > 0 else 1.0
    model.shift = float(np.log(REJECT / (1 - REJECT)) - edge * model.scale)
    return model


class Places(dict):
    """Term -> position in the model or -1."""

    def __init__(self, model: Machine):
        super().__init__()
        self.at = {int(b): k for k, b in enumerate(model.known)}

    def __missing__(self, term: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        k = self[term] = self.at.get(bucket(term), -1)
        return k


def scored(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from REJECT up)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(model)
        for batch in batches:
            found = []
            for text in batch.column(1):
                at = {places[x] for x in terms(text.as_py())}
                at.discard(-1)
                found.append(np.array(sorted(at), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(found), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= REJECT).cast("int").alias("predicted"))


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted on labelled rows of `docs`."""
    return fitted(sample(docs, labels, id_col, text_col, max_rows))


def clean(docs: DataFrame, model: Machine, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under REJECT, with all their columns."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        places = Places(model)
        found = []
        for text in texts:
            at = {places[x] for x in terms(text or "")}
            at.discard(-1)
            found.append(np.array(sorted(at), np.int64))
        return pd.Series(model.score(found))

    return docs.filter(score(F.col(text_col).cast("string")) < REJECT)
