"""Personal data: fixed patterns, and boosted trees over the proposals of high-recall generators.

Everything that touches a text is a built-in expression in the row that holds it;
nothing is shuffled.  The fixed patterns give the base spans.  Generators propose
further, overlapping spans (spelled-out addresses, national phone numbers, spaced
or dashed numbers, dotted numbers, account numbers).  Boosted trees score each from
its form and the words around it; the trees are one nested CASE expression.  A
proposal over its kind's threshold, which is set on held-out samples for a
precision of PRECISION, is added unless it meets a base span or a better proposal.

The trees are fitted on SAMPLES labelled phrases that `training_rows` makes with
SQL functions from templates; the driver sees their feature rows only.

Cases: null and empty texts have no spans; positions are code points, ends
exclusive; spans of one kind never overlap; repeated rows give equal rows; a text
of any length is read whole; no row is dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import cut, whole_text

# The contract's patterns, written without backtracking: a match begins where a run of its characters
# begins or where the last match ended, and runs are taken whole.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20@\x20?|@\x20)"
DOT = r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\x20?\.\x20?)"
GENERATORS = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,40}}{AT}[A-Za-z0-9-]{{1,40}}(?:{DOT}[A-Za-z0-9-]{{2,20}}){{1,3}}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{3,6}[\x20._/-]{1,3}){2,5}[0-9]{1,6}(?![A-Za-z0-9])",
    "ip": r"(?i)(?<![A-Za-z0-9.:])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|\x20dot)\x20?[0-9]{1,3}){3}(?![A-Za-z0-9.])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
# A cheap test for each generator, which every text with a match of it passes.
NEEDS = {"email": r"(?i)\bat\b|@", "phone": "[0-9]{2}", "card": "[0-9]{3}", "ip": "[0-9][^0-9]{1,7}[0-9]",
         "account": "[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-"}
CONTEXT = 32
CUES = {
    "cue_phone": r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|t[ée]l[ée]phone)\b",
    "cue_card": r"\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte)\b",
    "cue_mail": r"\b(?:mail|email|e-mail|contact|write|reach|send|correo|courriel)\b",
    "cue_host": r"\b(?:ip|host|server|address|login|logged|from|client)\b",
    "cue_bank": r"\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b",
    "cue_person": r"\b(?:ssn|social|security|passport|tax|id)\b",
    "cue_other": r"\b(?:order|invoice|version|release|ref|reference|page|pages|isbn|issn|date|year|price|total|model|part|serial|item|meet|look|arrived|chapter|section|score|figure)\b",
}


def unless(gate: Column, array: Column, kind: str = "array<string>") -> Column:
    """`array` where `gate` holds, else an empty one."""
    return F.when(gate, array).otherwise(F.array().cast(kind))


BLOCK = 128


def running(lengths: Column) -> Column:
    """Sum of the entries before each one.  Two levels of folds, so that long arrays cost little more than their length."""
    def before(x: Column) -> Column:
        fold = F.aggregate(x, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum")),
                           lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + n).alias("sum")))
        return fold["out"]

    n_blocks = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(n_blocks, F.lit(1))), lambda b: F.slice(lengths, (b - 1) * BLOCK + 1, BLOCK))
    starts = before(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda x: F.transform(before(x["b"]), lambda n: n + x["s"])))


def located(docs: DataFrame, text: str, prefix: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """`docs` with, per pattern name, a column prefix + name: array of (start, stop, m, left, right).

    The pieces between matches come from `split`, which cuts at the same places as
    `regexp_extract_all` finds.  Each step is a projection of its own, so no
    regular expression runs twice on a text.
    """
    name = lambda k, part="": f"{prefix}{k}{part}"
    out = docs.withColumns({name(k, "_m"): unless(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, gate) in patterns.items()})
    out = out.withColumns({name(k, "_p"): unless(F.size(name(k, "_m")) > 0, F.split(text, p, -1)) for k, (p, _) in patterns.items()})

    def advance(k: str) -> Column:
        return F.transform(name(k, "_m"), lambda m, i: F.length(m) + F.length(F.get(name(k, "_p"), i)))

    out = out.withColumns({name(k, "_n"): advance(k) for k in patterns})

    def made(k: str) -> Column:
        pieces = F.col(name(k, "_p"))
        starts = F.when(F.size(name(k, "_m")) > 0, running(F.col(name(k, "_n")))).otherwise(F.array().cast("array<int>"))
        zipped = F.arrays_zip(F.col(name(k, "_m")).alias("m"), starts.alias("at"))
        return F.transform(zipped, lambda x, i: F.struct(
            (x["at"] + F.length(F.get(pieces, i))).alias("start"), (x["at"] + F.length(F.get(pieces, i)) + F.length(x["m"])).alias("stop"),
            x["m"].alias("m"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(4)).alias("right")))

    out = out.withColumns({name(k): made(k) for k in patterns})
    return out.drop(*[name(k, part) for k in patterns for part in ("_m", "_p", "_n")])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the checksum?"""
    back = F.reverse(number)
    digit = lambda i: F.substring(back, i, F.lit(1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 0, F.translate(digit(i), "0123456789", "0246813579")).otherwise(digit(i)).cast("int"))
    return total % 10 == 0


def small_parts(x: Column) -> Column:
    """Are all dotted numbers at most 255?"""
    short = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(short(p)) > 3, False).otherwise(F.concat(F.lit("0"), short(p)).cast("int") <= 255))


def base_patterns(text: Column) -> dict[str, tuple[str, Column]]:
    """Pattern and a cheap test that every match's text passes."""
    return {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))),
            "card": (CARD, F.regexp_like(text, F.lit("[0-9][ -]?[0-9]"))), "phone": (PHONE, F.contains(text, F.lit("+")))}


def passing(kind: str, found: Column) -> Column:
    """The matches of a fixed pattern that pass its test."""
    n = lambda x: F.length(digits(x["m"]))
    test = {"ip": lambda x: small_parts(x["m"]), "phone": lambda x: n(x).between(9, 15),
            "card": lambda x: F.when(n(x).between(12, 19), luhn(digits(x["m"]))).otherwise(False)}.get(kind)
    return F.filter(found, test) if test else found


def features(kind: Column, x: Column) -> dict[str, Column]:
    """Numbers that describe a proposal: its form and the words before it."""
    m, left = x["m"], F.lower(x["left"])
    number = digits(m)
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    out = {f"is_{k}": (kind == k).cast("double") for k in GENERATORS}
    out |= {
        "digits": F.length(number).cast("double"), "length": F.length(m).cast("double"), "dots": count(r"\."),
        "dashes": count("-"), "spaces": count(" "), "slashes": count("/"), "brackets": count(r"[()\[\]]"),
        "letters": count("[A-Za-z]"), "groups": F.size(F.split(m, "[^0-9]+")).cast("double"),
        "first_group": F.length(F.regexp_extract(m, "[0-9]+", 0)).cast("double"),
        "last_group": F.length(F.regexp_extract(m, "[0-9]+$", 0)).cast("double"),
        "checksum": F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False).cast("double"),
        "year_like": F.regexp_like(m, F.lit(r"^(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)?[0-9]{2})$")).cast("double"),
        "marked": F.regexp_like(m, F.lit(r"(?i)[\[({]\x20?(?:at|dot|\.)")).cast("double"),
        "known_end": F.regexp_like(m, F.lit(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")).cast("double"),
        "spaced_dot": F.regexp_like(m, F.lit(r"\.\x20")).cast("double"),
        "glued": F.regexp_like(x["left"], F.lit(r"[#$€£=_*%&]\x20?$")).cast("double"),
    }
    return out | {name: F.regexp_like(left, F.lit(p)).cast("double") for name, p in CUES.items()}


def proposals(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """`docs` with prefix + "proposals": all generators' spans with kind and features, array of structs."""
    names = {f"g_{k}": (GENERATORS[k], F.regexp_like(text, F.lit(NEEDS[k]))) for k in GENERATORS}
    out = located(docs, text, prefix, names)

    def of(kind: str) -> Column:
        return F.transform(F.col(f"{prefix}g_{kind}"), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
            *[c.alias(k) for k, c in features(F.lit(kind), x).items()]))

    return out.withColumn(f"{prefix}proposals", F.concat(*[of(k) for k in GENERATORS])).drop(*[prefix + k for k in names])


# -- training ------------------------------------------------------------------------------------------------------------
SAMPLES = 3000
PRECISION = 0.995
NAMES = ["anna", "j.smith", "maria", "pedro", "info", "sales", "k.weber", "paul", "office", "lucie"]
HOSTS = ["example", "mail", "acme", "webhost", "firma", "tienda"]
ENDS = ["com", "org", "net", "de", "fr", "es"]
FILLER = ["the report was", "please note that", "as agreed on", "la reunion de", "wir haben", "they said", "it is about", "one of the"]
NOUNS = ["station", "office", "market", "noon", "home", "school", "work", "least"]


def training_rows(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text, label (the kind of personal data or none): `n` phrases from templates, picked by hashes of a row number."""
    def number(k: int, most: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most))

    def one(k: int, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number(k, len(values)) + 1).cast("int"))

    def num(k: int, width: int) -> Column:
        return F.lpad((number(k, 10 ** width)).cast("string"), width, "0")

    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    at, dot = one(1, [" at ", " [at] ", "(at)", " (at) ", " @ "]), one(2, [" dot ", " [dot] ", "(dot)", "."])
    sep = one(3, ["-", " ", "."])
    octet = lambda k: number(k, 256).cast("string")
    positive = [
        ("email", cat(one(4, ["email ", "contact ", "write to ", "reach me: ", "mail "]), one(5, NAMES), at, one(6, HOSTS), dot, one(7, ENDS))),
        ("email", cat(one(5, NAMES), one(4, [" [at] ", "(at)", " (at) "]), one(6, HOSTS), one(8, [" [dot] ", "(dot)", "."]), one(7, ENDS))),
        ("phone", cat(one(4, ["call ", "phone: ", "tel ", "mobile ", "fax: "]), num(5, 3), sep, num(6, 3), sep, num(7, 4))),
        ("phone", cat(one(4, ["call (", "phone (", "tel: ("]), num(5, 3), ") ", num(6, 3), "-", num(7, 4))),
        ("phone", cat(one(4, ["tel. ", "telefon ", "phone "]), "0", num(5, 3), one(3, ["/", " ", "-"]), num(6, 4), " ", num(7, 3))),
        ("card", cat(one(4, ["card ", "visa ", "credit card: ", "debit card "]), num(5, 4), sep, num(6, 4), sep, num(7, 4), sep, num(8, 4))),
        ("ip", cat(one(4, ["host ", "server ", "ip ", "login from "]), octet(5), one(3, ["[.]", "(.)", " dot "]), octet(6), one(3, ["[.]", "(.)", " dot "]), octet(7), one(3, ["[.]", "(.)", " dot "]), octet(8))),
        ("account", cat(one(4, ["iban ", "account ", "bank transfer to "]), one(5, ["DE", "FR", "ES", "GB"]), num(6, 2), " ", num(7, 4), " ", num(8, 4), " ", num(9, 4), " ", num(10, 4))),
        ("ssn", cat(one(4, ["ssn ", "social security ", "tax id "]), num(5, 3), "-", num(6, 2), "-", num(7, 4))),
    ]
    negative = [
        cat(one(4, ["meet at ", "look at ", "arrived at "]), one(5, NOUNS), ". ", one(6, ["then", "and", "the", "but"]), " we went"),
        cat(one(4, NOUNS), " at ", one(5, NOUNS), ". ", one(6, ["this", "they", "after", "Es", "De", "It", "En"])),
        cat(one(4, ["is ", "to ", "was "]), "at ", one(5, NOUNS), ". ", one(6, ["Es", "De", "Com", "Fr", "The"]), " ", one(7, NOUNS)),
        cat(one(4, NOUNS), " at the ", one(5, NOUNS), ".", one(6, ["the", "this", "de"])),
        cat(one(4, ["on ", "date ", "since ", ""]), "20", num(5, 2), one(3, ["-", "/", "."]), num(6, 2), one(3, ["-", "/", "."]), num(7, 2)),
        cat(one(4, ["on ", "date ", ""]), num(5, 2), one(3, ["-", "/", "."]), num(6, 2), one(3, ["-", "/", "."]), "20", num(7, 2)),
        cat(one(4, ["order ", "invoice ", "ref ", "part ", "serial ", "item "]), num(5, 3), sep, num(6, 3), sep, num(7, 4)),
        cat(one(4, ["isbn ", "order ", "serial "]), num(5, 4), sep, num(6, 4), sep, num(7, 4), sep, num(8, 4)),
        cat(one(4, ["version ", "release ", "section ", "chapter "]), number(5, 20).cast("string"), one(3, [".", " . ", ". "]), number(6, 20).cast("string"), ".", number(7, 20).cast("string"), ". ", number(8, 20).cast("string")),
        cat(one(4, ["pages ", "score ", "figure ", "", "total "]), num(5, 2), one(3, ["-", " ", "/"]), num(6, 3)),
        cat(one(4, FILLER), " ", num(5, 3), one(3, [" ", ". ", " - "]), num(6, 4), " ", num(7, 3)),
        cat(one(4, FILLER), " ", num(5, 4), " ", num(6, 4), " ", num(7, 4), " ", num(8, 4)),
        cat(one(4, ["model ", "part ", "serial "]), one(5, ["AB", "XK", "PR"]), num(6, 2), " ", num(7, 4), " ", num(8, 4)),
        cat(one(4, ["part ", "item ", "ref "]), num(5, 3), "-", num(6, 2), "-", num(7, 4)),
    ]
    pick = lambda rows, k: reduce(lambda rest, i: F.when(number(k, len(rows)) == i, rows[i]).otherwise(rest), range(len(rows)), rows[0])
    personal = number(20, 2) == 1
    body = F.when(personal, pick([x for _, x in positive], 21)).otherwise(pick(negative, 22))
    label = F.when(personal, pick([F.lit(k) for k, _ in positive], 21)).otherwise(F.lit(""))
    return spark.range(n).select("id", label.alias("label"), F.concat(one(23, FILLER), F.lit(" "), body, F.lit(" "), one(24, FILLER)).alias("text"))


class Redactor:
    """The fitted trees and each kind's threshold."""

    def __init__(self, trees: boosting.Boosted, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds


_KEPT: dict[int, Redactor] = {}


def learnt(spark: SparkSession, n: int = SAMPLES) -> Redactor:
    """Trees from `training_rows` (fitted once a process): two thirds for the trees, a third for the thresholds."""
    if n not in _KEPT:
        rows = proposals(cut(training_rows(spark, n)), "text", "pii_").select("id", "label", F.explode("pii_proposals").alias("p"))
        table = rows.select("id", "label", "p.*").orderBy("id", "kind", "start").collect()
        names = [c for c in rows.select("p.*").columns if c not in ("kind", "start", "stop")]
        x = np.array([[r[k] for k in names] for r in table])
        y = np.array([r["label"] == r["kind"] for r in table], float)  # a proposal is right if its kind is, too
        held = np.array([r["id"] % 3 == 0 for r in table])
        trees = boosting.fitted(x[~held], y[~held], names)
        margin = trees.margin(x[held])
        kinds = np.array([r["kind"] for r in table])[held]
        cuts = {k: boosting.safe_threshold(margin[kinds == k], y[held][kinds == k], PRECISION) for k in GENERATORS}
        _KEPT[n] = Redactor(trees, {k: max(c, 0.0) for k, c in cuts.items()})
    return _KEPT[n]


def added(found: Column, base: Column, model: Redactor) -> Column:
    """Selected proposals: array of (start, stop, kind), best first, none meeting a base span or a better one."""
    cuts = F.create_map(*[F.lit(v) for k, c in model.thresholds.items() for v in (k, float(min(c, 1e9)))])
    scored = F.transform(found, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
        model.trees.expression({k: x[k] for k in model.trees.names}).alias("score")))
    sure = F.filter(scored, lambda x: x["score"] > F.element_at(cuts, x["kind"]))
    free = F.filter(sure, lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    ranked = F.array_sort(F.transform(free, lambda x: F.struct((-x["score"]).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return F.aggregate(ranked, F.array().cast("array<struct<start:int,stop:int,kind:string>>"), lambda acc, x: F.when(
        F.exists(acc, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))))


ORDER = [*KINDS, "account", "ssn"]


SPANS = "array<struct<start:int,order:int,kind:string,stop:int>>"


def spans(docs: DataFrame, prefix: str, text_col: str = "text", model: Redactor | None = None) -> DataFrame:
    """`docs` with prefix + "base" and prefix + "added": arrays of (start, order, kind, stop), by start, then kind as listed."""
    model = model or learnt(docs.sparkSession)
    text = prefix + "text"
    place = F.create_map(*[F.lit(v) for k, name in enumerate(ORDER) for v in (name, k)])
    told = lambda found, kind: F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.element_at(place, kind(x)).alias("order"), kind(x).alias("kind"), x["stop"].alias("stop")))
    rows = docs.withColumn(text, whole_text(text_col))
    rows = located(rows, text, prefix, base_patterns(F.col(text)))
    rows = rows.withColumn(prefix + "base", F.array_sort(F.concat(*[told(passing(k, F.col(prefix + k)), lambda x, k=k: F.lit(k)) for k in KINDS])))
    rows = proposals(rows.drop(*[prefix + k for k in KINDS]), text, prefix)
    rows = rows.withColumn(prefix + "added", F.when(F.size(prefix + "proposals") > 0, F.array_sort(told(
        added(F.col(prefix + "proposals"), F.col(prefix + "base"), model), lambda x: x["kind"]))).otherwise(F.array().cast(SPANS)))
    return rows.drop(prefix + "proposals", text)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts of the base kinds, the digest of the base spans, all spans."""
    rows = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "pii_")
    count = lambda k: F.size(F.filter("pii_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"),
                       joined(F.array_sort(F.concat("pii_base", "pii_added"))).alias("spans"))


def free_prefix(taken: list[str]) -> str:
    """A prefix that no column has."""
    prefix = "pii_"
    while any(x.lower().startswith(prefix) for x in taken):
        prefix += "_"
    return prefix


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in square brackets; other columns and null texts as they are.

    Spans that overlap are one hole, named after its first span.
    """
    prefix = free_prefix(docs.columns)
    hole = "struct<start:int,stop:int,kind:string>"
    rows = spans(docs, prefix, text_col)
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        F.array_sort(F.concat(prefix + "base", prefix + "added")), F.array().cast(f"array<{hole}>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["stop"] > x["start"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop"), last(acc)["kind"].alias("kind")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))))
    rows = rows.withColumn(prefix + "holes", merged)
    holes, text = F.col(prefix + "holes"), F.col(text_col)
    # What stands before each hole, the hole's name, and the rest: joined once, so a text with many holes is copied once.
    kept = F.transform(holes, lambda h, i: F.concat(
        F.substring(text, F.coalesce(F.get(holes, i - 1)["stop"], F.lit(0)) + 1, h["start"] - F.coalesce(F.get(holes, i - 1)["stop"], F.lit(0))),
        F.lit("["), F.upper(h["kind"]), F.lit("]")))
    rest = F.substring(text, last(holes)["stop"] + 1, F.length(text))
    rows = rows.withColumn(text_col, F.when(F.size(holes) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text))
    return rows.select(*docs.columns)
