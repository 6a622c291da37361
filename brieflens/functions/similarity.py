"""Two Arrow UDFs over the standard library's sequence matcher.

Ratcliff/Obershelp similarity and unified diffs have no built-in equivalent;
both run only on pairs that a join already matched by key.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN_CHARS = 8_000_000  # characters of pairs a task remembers before it starts anew


@F.pandas_udf(T.DoubleType())
def seq_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2M/T similarity of two texts; null counts as empty.  A task compares a pair that comes again once only."""
    known: dict[tuple[str, str], float] = {}
    held = 0
    for a, b in pairs:
        out = []
        for x, y in zip(a, b):
            pair = (x or "", y or "")
            ratio = known.get(pair)
            if ratio is None:
                ratio = difflib.SequenceMatcher(None, *pair).ratio()
                size = len(pair[0]) + len(pair[1])
                if held + size > KNOWN_CHARS:
                    known.clear()
                    held = 0
                known[pair] = ratio
                held += size
            out.append(ratio)
        yield pd.Series(out, dtype="float64")


MAX_DIFF_LINES = 48


@F.pandas_udf(T.ArrayType(T.StringType()))
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff with two context lines, cut to 48 lines plus a notice."""
    def one(a: str | None, b: str | None) -> list[str]:
        rows = list(difflib.unified_diff(
            (a or "").splitlines(), (b or "").splitlines(),
            fromfile="saved-version", tofile="current-editor", lineterm="", n=2))
        left = len(rows) - MAX_DIFF_LINES
        return rows if left <= 0 else rows[:MAX_DIFF_LINES] + [f"... diff truncated, {left} more line(s)"]

    return pd.Series([one(a, b) for a, b in zip(before, after)])
