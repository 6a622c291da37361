"""Golden numbers and rule fixtures of scorecards, verdicts, legal comparison and isolation."""

import difflib

import pytest
from pyspark.sql import functions as F

from brieflens.functions import fixed
from brieflens.operators import review as R
from brieflens.sources import tables as T

CODES = {"B": "✅ Best Practice", "M": "minimally meets", "F": "Does Not Meet", "N": "N/A"}
SHEET = ["BBMM", "BBM", "BMBM", "FFFF", "FMFMFF"[:5], "BMBMBM", "MMFFF", "BMFF", "BMMB", "BBBB", "BBBB", "FMBM", "MFF", "FFB"]


def ratings(spark, change=None, drop=()):
    rows = []
    for no, codes in enumerate(SHEET, 1):
        for i, code in enumerate(codes, 1):
            cid = f"{no}.{i}"
            code = (change or {}).get(cid, (change or {}).get(no, code))
            if no not in drop:
                rows.append(("p", cid, CODES[code]))
    return spark.createDataFrame(rows, "project_id string, criterion_id string, rating string")


def totals(spark, weights=None, **kw):
    rows = R.scorecard(T.criteria(spark), ratings(spark, **kw), weights)
    return {r["category_no"]: r for r in rows.collect()}, R.scorecard_total(rows).first()


def test_golden_total(spark):
    rows, total = totals(spark)
    averages = [1.5, 5 / 3, 1.5, 0.0, 0.4, 1.5, 0.4, 0.75, 1.5, 2.0, 2.0, 1.0, 1 / 3, 2 / 3]
    assert [rows[n]["avg"] for n in range(1, 15)] == pytest.approx(averages, abs=1e-9)
    assert total["total"] == pytest.approx(0.56825, abs=1e-9)
    assert (total["band"], total["unrated_count"], total["complete"]) == ("not ready", 0, True)


def test_not_applicable_and_unrated(spark):
    rows, _ = totals(spark, change={"1.1": "N"})
    assert rows[1]["avg"] == pytest.approx(4 / 3) and rows[1]["na_count"] == 1
    rows, total = totals(spark, change={4: "N"})
    assert rows[4]["effective_weight"] == 0 and sum(r["effective_weight"] for r in rows.values()) == pytest.approx(1)
    assert total["total"] > 0.56825
    rows, total = totals(spark, drop=(11,))
    assert rows[11]["unrated_count"] == 4 and rows[11]["effective_weight"] > 0
    assert total["total"] < 0.56825 and not total["complete"]
    _, total = totals(spark, change={n: "N" for n in range(1, 15)})
    assert (total["total"], total["band"]) == (0.0, "awaiting")


def test_weight_override(spark):
    over = spark.createDataFrame([("p", 4, "0")], "project_id string, category_no int, weight string")
    cats = T.criteria(spark).select("category_no", "weight").distinct()
    rows, _ = totals(spark, weights=R.effective_weights(cats, over))
    assert rows[4]["effective_weight"] == 0 and sum(r["effective_weight"] for r in rows.values()) == pytest.approx(1)


def test_bands_and_rating_text(spark):
    bands = spark.createDataFrame([(x,) for x in (0.8, 0.95, 0.79, 0.6, 0.59, 0.01, 0.0)], "t double")
    got = [r[0] for r in bands.select(R.score_band(F.col("t"))).collect()]
    assert got == ["ready", "ready", "needs work", "needs work", "not ready", "not ready", "awaiting"]
    texts = spark.createDataFrame([(x,) for x in ("⚠️ Minimally Meets", "na", "", None, "Excellent", "2", "partially meets")], "t string")
    assert [r[0] for r in texts.select(R.normalize_rating(F.col("t"))).collect()] == [
        "Minimally Meets", "Not Applicable", None, None, None, None, None]


VERDICT = ("project_id string, criterion_id string, part int, rating string, confidence string, evidence_status string, "
           "slides array<struct<doc:string,slide:int>>")


def test_verdicts(spark):
    deck = spark.createDataFrame([("Deck.pptx", 40)], "doc string, n int")
    rows = spark.createDataFrame([
        ("p", "1.1", 1, "Best Practice", "extremely sure", "found", [("Deck.pptx", 99), ("Deck.pptx", 12)]),
        ("p", "1.2", 1, "Best Practice", "HIGH", "", [("deck.PPTX", 3), (None, 5)]),
        ("p", "1.3", 1, "Excellent", "low", "", []), ("p", "99.1", 1, "Best Practice", "low", "", [])], VERDICT)
    out = {r["criterion_id"]: r for r in R.validate_verdicts(rows, T.criteria(spark), deck, "Deck.pptx").collect()}
    assert [s["slide"] for s in out["1.1"]["slides"]] == [12] and out["1.1"]["dropped_citations"] == 1
    assert out["1.1"]["confidence"] == "medium"
    assert [(s["doc"], s["slide"]) for s in out["1.2"]["slides"]] == [("Deck.pptx", 3), ("Deck.pptx", 5)]
    assert (out["1.3"]["problem"], out["99.1"]["problem"]) == ("unrecognised rating", "unknown criterion")


@pytest.mark.parametrize("flip", [False, True])
def test_merge_is_order_free(spark, flip):
    a, b = ("Minimally Meets", [("D", 3)]), ("Best Practice", [("D", 47), ("D", 48)])
    parts = [b, a] if flip else [a, b]
    rows = spark.createDataFrame([("p", "1.1", i, r, "low", "", s) for i, (r, s) in enumerate(parts)], VERDICT)
    got = R.merge_verdicts(rows).first()
    assert got["rating"] == "Best Practice" and {s["slide"] for s in got["slides"]} == {3, 47, 48}


def test_legal_compare(spark):
    clause = "The supplier keeps all personal data confidential and deletes it at the end of the term."
    clauses = spark.createDataFrame([(1, "13. Privacy", clause), (2, "14 Notices", "Notices are sent by post to the seat of each party."),
                                     (3, "15 Law", "The law of the seat applies.")], "ord int, title string, text string")
    drafted = spark.createDataFrame([
        ("same", "1", "Section 2: Privacy", clause), ("same", "2", "Notices", ""),
        ("lost", "1", "Privacy", "The supplier keeps all data safe and deletes it at the end of the term."),
        ("far", "2", "7. Notices", "Totally other words 12345")], "project_id string, section_id string, title string, content string")
    out = {(r["project_id"], r["clause_title"]): r for r in R.legal_compare(drafted, clauses).collect()}
    assert out["same", "13. Privacy"]["kind"] == "matched"
    assert out["same", "14 Notices"]["kind"] == "empty" and out["same", "15 Law"]["kind"] == "missing"
    assert out["lost", "13. Privacy"]["missing_phrases"] == ["confidential", "personal data"]
    far = out["far", "14 Notices"]
    ratio = difflib.SequenceMatcher(None, "notices are sent by post to the seat of each party.", "totally other words 12345").ratio()
    assert far["kind"] == "wording_deviation" and far["similarity"] == pytest.approx(round(ratio, 3))


def test_isolation(spark):
    companies = spark.createDataFrame([("p1", "Alpha"), ("p2", "Beta")], "project_id string, company string")
    state = spark.createDataFrame([
        ("p2", "1", "Reference Alpha throughout the text. Client company: Alpha"), ("p2", "2", "Reference Beta throughout")],
        "project_id string, section_id string, prompt string")
    approved = spark.createDataFrame([("p2", "1", "Work for Alpha begins"), ("p2", "2", "Work for Beta")],
                                     "project_id string, section_id string, content string")
    chunks = spark.createDataFrame([("p2", "p2"), ("p2", None), ("p2", "p1")], "scope string, project_id string")
    found = [tuple(r) for r in R.isolation_audit(companies, approved, state, chunks).select("kind", "place", "detail").collect()]
    assert sorted(found) == [("foreign_chunks", "chunks", "1"), ("foreign_prompt", "1", "alpha"), ("foreign_prompt", "1", "alpha"),
                             ("foreign_text", "1", "alpha")]
    cleaned = {r["section_id"]: r for r in R.clean_stale_prompts(state, companies).collect()}
    assert cleaned["1"]["prompt"] == "" and not cleaned["2"]["cleaned"]


def test_rubric_constants():
    assert sum(n for n, _ in fixed.RUBRIC) == 57 and round(sum(w for _, w in fixed.RUBRIC), 6) == 1.0
