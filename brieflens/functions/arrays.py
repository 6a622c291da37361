"""Array helpers that count and pick inside one row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(words: Column) -> Column:
    """Distinct words as ``array<struct<term, n, first>>``, by a sort and its run lengths.

    `first` is the position of the first appearance.  Cost is n log n per row,
    against a corpus-wide shuffle for an explode and a group-by.
    """
    tagged = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))

    def starts(s: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]),
        )

    def runs(s: Column) -> Column:
        return let(starts(s), lambda b: F.transform(b, lambda i, j: F.struct(
            F.get(s, i)["term"].alias("term"),
            (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("n"),
            F.get(s, i)["pos"].alias("first"),
        )))

    empty = F.array().cast("array<struct<term:string,n:int,first:int>>")
    return let(tagged, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def count_in(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of `needle` in `haystack`."""
    gone = F.length(F.replace(haystack, needle, F.lit("")))
    return ((F.length(haystack) - gone) / F.length(needle)).cast("int")


def distinct_lower(values: Column) -> Column:
    """First appearance of each value, compared without case."""
    low = F.transform(values, lambda v: F.lower(v))
    return let(low, lambda keys: F.filter(
        values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1))
