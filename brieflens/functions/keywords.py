"""Term-frequency keywords and section classification of one passage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as X
from .arrays import let, term_counts


def keywords_tf(text: Column, limit: int = fixed.KEYWORDS_PER_CHUNK) -> Column:
    """Most frequent words plus Capitalised Phrases (weight two), first-seen ties."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(X.text_or_empty(text)), "[^a-z]+", " "), " "), lambda w: F.length(w) >= 3)
    phrases = F.filter(
        F.regexp_extract_all(X.text_or_empty(text), F.lit(X.uni(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+")), F.lit(0)),
        lambda p: F.length(p) > 5,
    )
    # stop words leave after counting: looked up once per distinct word
    counted = F.filter(term_counts(words), lambda t: ~t["term"].isin(fixed.KEYWORD_STOP))
    scored = F.concat(
        F.transform(counted, lambda t: F.struct(
            (-t["n"]).alias("rank"), F.lit(0).alias("kind"), t["first"].alias("first"), t["term"].alias("term"))),
        F.transform(term_counts(phrases), lambda t: F.struct(
            (t["n"] * -2).alias("rank"), F.lit(1).alias("kind"), t["first"].alias("first"), t["term"].alias("term"))),
    )
    def best(rows: Column) -> Column:
        named = F.exists(rows, lambda t: t["kind"] == 0)  # phrases count only beside words
        # capitals are set on the few words that stay
        top = F.transform(F.slice(F.sort_array(rows), 1, limit), lambda t: F.when(t["kind"] == 0, F.initcap(t["term"])).otherwise(t["term"]))
        return F.when(named, top).otherwise(F.array().cast("array<string>"))

    return let(scored, best)


def phrase_class(haystack: Column, phrases: dict[str, list[str]]) -> Column:
    """The class with most phrases contained; ties to the first listed; none is empty."""
    listed = F.array(*[F.array(*[F.lit(p) for p in words]) for words in phrases.values()])
    names = F.array(F.lit(""), *[F.lit(name) for name in phrases])

    # the text and the counts are bound once: written out, every class would repeat all phrases and the text's expression
    def pick(counts: Column) -> Column:
        best = F.array_max(counts)
        return F.element_at(names, F.when(best == 0, 1).otherwise(F.array_position(counts, best).cast("int") + 1))

    return let(haystack, lambda hay: let(
        F.transform(listed, lambda words: F.size(F.filter(words, lambda p: F.contains(hay, p)))), pick))


def classify_section(heading: Column, text: Column) -> Column:
    hay = F.lower(F.concat(X.text_or_empty(heading), F.lit(" "), F.left(X.text_or_empty(text), F.lit(400))))
    return phrase_class(hay, fixed.SECTION_PHRASES)


def useful_keyword(kw: Column, noise: list[str] = fixed.TOPIC_NOISE) -> Column:
    """Longer than four characters and not a lone noise word."""
    return (F.length(kw) > 4) & (F.contains(kw, F.lit(" ")) | ~F.lower(kw).isin(noise))
