"""Repeated questions in a stream, by built-in watermarked state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def question_key(question: str, scope: str, mode: str):
    return F.concat_ws("|", F.lower(X.strip(F.col(question))), F.col(scope), F.col(mode))


def first_seen(questions: DataFrame, key: str, at: str, delay: str | None = None) -> DataFrame:
    """First question of each key; repeats inside the watermark are dropped.

    State is bounded by the watermark (one hour by default).  It measures
    repeats from the first question kept in state; the batch twin
    `operators.answers.answer_first_seen` gives the exact rule.
    """
    span = delay or f"{fixed.ANSWER_TTL_SECONDS} seconds"
    return questions.withWatermark(at, span).dropDuplicatesWithinWatermark([key])
