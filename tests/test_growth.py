"""Costs that must not grow with the number of classes, projects or repeated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflens.functions import keywords as K


def test_phrase_class_is_written_once(spark):
    """The text's expression stands once in the plan, however many classes and phrases there are."""
    phrases = {f"class{i}": [f"p{i}x{j}" for j in range(10)] for i in range(12)}
    rows = spark.createDataFrame([("P3X1 and p3x2, p5x1",), ("nothing",), ("p7x1 p2x1",)], "t string")
    got = rows.select(K.phrase_class(F.lower(F.concat("t", F.lit("~mark~"))), phrases).alias("c"))
    assert [r.c for r in got.collect()] == ["class3", "", "class2"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("~mark~") == 1


def test_contract_lines_are_cut_once_per_document(spark, tmp_path):
    """The text is split below the explode, not once per section above it."""
    from brieflens.sources import contracts as D
    spark.createDataFrame([(7, ". ".join(f"line {i}" for i in range(47))), (8, "only one")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    made = D.contracts(spark, str(tmp_path)).cache()
    plan = D.contracts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[:plan.index("Generate")] and plan.count("split(") == 1
    held = [x for r in made.filter("project_id = 'd7'").collect() for x in r["content"].split("\n") if x.startswith("line ")]
    whole = {f"line {i}" for i in range(47)}
    gone = {o for o in range(20) if (7 + o) % 23 == 5 or (7 + o) % 17 == 3}
    assert set(held) == {x for x in whole if int(x[5:]) % 20 not in gone} and len(held) == len(set(held))


def test_clean_import_cleans_a_text_once(spark):
    """No filter repeats the clean-up, and nested replacements name their text once."""
    from brieflens.operators import sections as S
    rows = spark.createDataFrame([
        ("a", "4", "<h2>Big <b>one</b></h2><ul><li>x</li></ul><p>text</p>\n# 4.1 Extra\nSection 2: Other"), ("a", "5", "<p>\nSection 2</p>")],
        "project_id string, section_id string, content string")
    made = S.clean_import(rows, rows)
    assert [tuple(r) for r in made.collect()] == [("a", "4", "**Big one**- x\ntext")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("<li[^>]*>") <= 4


def test_repeated_pairs_keep_their_ratio(spark, monkeypatch):
    """A task compares a pair once, and the remembered ratios are the library's, also after the memory was emptied."""
    import difflib

    import pandas as pd

    from brieflens.functions import similarity as Y
    pairs = [("scope of work", "scope of works"), (None, "x"), ("", ""), ("a" * 300, "ab" * 150)] * 50
    want = [difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in pairs]
    assert [r.r for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(Y.seq_ratio("a", "b").alias("r")).collect()] == want
    made = []
    real = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *x: made.append(x) or real(*x))
    a, b = (pd.Series([p[i] for p in pairs]) for i in (0, 1))
    monkeypatch.setattr(Y, "KNOWN_CHARS", 10_000)
    assert [x for part in Y.seq_ratio.func(iter([(a, b), (a, b)])) for x in part] == want * 2 and len(made) == 4
    monkeypatch.setattr(Y, "KNOWN_CHARS", 100)
    assert [x for part in Y.seq_ratio.func(iter([(a, b)])) for x in part] == want


def test_coverage_counts_without_comparing(spark):
    """The counts equal those of `legal_compare`, and no similarity is computed for them."""
    from brieflens.operators import review as R
    shape = "project_id string, section_id string, title string, content string"
    sections = spark.createDataFrame([("p", "1", "1. Scope", "we work"), ("p", "2", "2. Terms", ""), ("q", "1", "Other", "x")], shape)
    clauses = spark.createDataFrame([(1, "Scope", "work"), (2, "Terms", "pay"), (3, "Exit", "leave")], "ord long, title string, text string")
    made = R.legal_coverage(sections, clauses)
    full = R.legal_compare(sections, clauses).groupBy("project_id").agg(
        F.count_if(F.col("kind") != "missing").alias("compared"), F.count_if(F.col("kind") == "missing").alias("missing"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, full.collect())) == [("p", 2, 1), ("q", 0, 3)]
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_substring_counts_move_no_word(spark, monkeypatch):
    """Equal to counting term by term, over several blocks of chunks and terms; no word of a text is exploded or exchanged."""
    from brieflens.operators import ranking as R
    texts = ["The cat\u00a0sat\u2003concatenated", None, "aaaa anana\x1fanana", "x\tabcdefghijklmnop  ABCDEFGHIJ", "", "ÄÖ straße"]
    rows = spark.createDataFrame([(i, t, f"Cat {t}") for i, t in enumerate(texts)], "chunk_id long, body string, head string").coalesce(1)
    terms = ["cat", "a", "aa", "anana", "abcdefghij", "defghijklmno", "ß", "äö", "missing", "\x1f"]
    for size, block in ((1024, 1000), (2, 3)):
        monkeypatch.setattr(R, "WORD_ROWS", size)
        monkeypatch.setattr(R, "TERM_BLOCK", block)
        made = R.substring_counts(rows, {"b": F.col("body"), "h": F.col("head")}, spark.createDataFrame([(t,) for t in terms * 2], "term string"))
        want = {(r.chunk_id, t, (r.body or "").lower().count(t), (r["head"] or "").lower().count(t)) for r in rows.collect() for t in terms}
        got = [tuple(r) for r in made.collect()]
        assert len(set(got)) == len(got) and set(got) == {w for w in want if w[2] or w[3]}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1  # chunks with terms


def test_foreign_names_meet_a_text_once(spark):
    """Names of one word are found without the text; the longer ones of a section are looked up in it together."""
    from brieflens.operators import review as R
    companies = spark.createDataFrame([("a", "Acme"), ("b", "Blue Sky"), ("c", "Blue Moon"), ("d", " ")], "project_id string, company string")
    approved = spark.createDataFrame([("a", "1", "ACMES met Blue  Sky and blue sky"), ("b", "1", "acme, Blue Moon"), ("c", "2", None)],
                                     "project_id string, section_id string, content string")
    made = R.foreign_mentions(approved, companies)
    assert sorted(map(tuple, made.collect())) == [("a", "1", "blue sky", 1), ("b", "1", "acme", 1), ("b", "1", "blue moon", 1)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(content" not in plan and "Filter Contains" not in plan and "collect_list" in plan


def test_vocabulary_meets_terms_without_grams(spark):
    """The words that contain a term, as by comparing all pairs; no word is cut into pieces that are exchanged."""
    from brieflens.operators import ranking as R
    words = ["anana", "banana", "cat", "concatenated", "aaaa", "x", "straße"]
    terms = ["ana", "cat", "aa", "x", "ß", "concatenated", "none"]
    made = R.matching_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(w, t, w.count(t)) for w in words for t in terms if t in w}
    assert {tuple(r) for r in made.collect()} == want and "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_topics_are_found_without_grams(spark, monkeypatch):
    """Equal to comparing every pair, over several blocks; a long phrase is not cut into pieces that are exchanged."""
    from brieflens.operators import topics as K
    long = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    words = [["Net Off", "demand", long], ["planning", "DEMAND", "abc"], ["Sites", "demand planning"], ["xyz"], None]
    chunks = spark.createDataFrame([(p, i, "d", w, "Head" if i else "4 Scope") for p in "pq" for i, w in enumerate(words)],
                                   "project_id string, chunk_id long, doc_name string, keywords array<string>, section_heading string")
    asked = ["demand", "wordab worddb", "wordaa wordba", "e", " net ", "", None, "xabcx", "sites of demand planning", "none", "heads"]
    wanted = spark.createDataFrame([("p", str(i), a) for i, a in enumerate(asked)], "project_id string, section_id string, topic string")
    rows = [r for r in K.topic_rows(chunks).collect() if r["project_id"] == "p"]
    want = set()
    for i, a in enumerate(asked):
        a = (a or "").strip().lower()
        close = [r for r in rows if r["topic"] == a] or [r for r in rows if a and (a in r["topic"] or r["topic"] in a)]
        if close:
            topic = min(close, key=lambda r: (r["chunk_id"], r["pos"]))["topic"]
            want |= {(str(i), r["chunk_id"]) for r in rows if r["topic"] == topic}
    for size in (500_000, 3):
        monkeypatch.setattr(K, "BLOCK_CHARS", size)
        made = K.resolve_topics(wanted, chunks)
        assert {(r["section_id"], r["chunk_id"]) for r in made.collect()} == want and len(want) > 6
    close = K.first_close_topics(wanted.select("project_id", F.col("topic").alias("asked")), K.topic_rows(chunks).select("project_id", "topic", "chunk_id", "pos"))
    plan = close._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan and "Contains" not in plan and "explode(sequence" not in plan


def test_scope_meets_files_on_what_it_names(spark, tmp_path):
    """No query compares its chunks with all its files: every join has equal keys and no alternative; a row of nulls frees a query."""
    from brieflens.operators import postings as P
    chunks = spark.createDataFrame([(p, f"f{i // 2}", i, f"N{i // 2}.docx", "", "x") for p in "ab" for i in range(8)],
                                   "project_id string, file_id string, chunk_id long, doc_name string, section_heading string, chunk_text string")
    index = P.build(chunks, str(tmp_path / "i"), kinds=("word",), groups=2)
    scores = spark.range(6).select(F.col("id").alias("q_id")).join(chunks.select("project_id", "chunk_id"))
    scope = spark.createDataFrame([(0, "a", None), (1, None, "n1.DOCX"), (2, "b", "n0.docx"), (3, None, None), (3, "a", None), (4, "a", "-")],
                                  "q_id long, project_id string, doc string")
    made = P.in_scope(scores, index, scope, None)
    got = {}
    for r in made.collect():
        got.setdefault(r["q_id"], []).append((r["project_id"], r["chunk_id"]))
    every = sorted((p, i) for p in "ab" for i in range(8))
    assert {q: sorted(v) for q, v in got.items()} == {
        0: [("a", i) for i in range(8)], 1: [(p, i) for p in "ab" for i in (2, 3)], 2: [("b", 0), ("b", 1)], 3: every, 5: every}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and " OR " in line]


def test_searches_sum_pairs_inside_blocks(spark, monkeypatch):
    """Equal to scoring pair by pair, with copies, ties, tags and listed files; no posting and no pair is exchanged."""
    import math

    from brieflens.functions import fixed
    from brieflens.operators import blocks as B
    from brieflens.operators import ranking as R
    words = "plan demand site zebra net supply of the".split()
    texts = {i: " ".join(words[(i * j + j) % 8] for j in range(2 + i % 5)) if i % 3 else "plan demand plan" for i in range(40)}
    texts[40], texts[41] = None, "  "
    chunks = spark.createDataFrame([(i, f"n{i % 4}.pdf", words[i % 8] if i % 2 else None, t, ["", "1", "2", None][i % 4]) for i, t in texts.items()],
                                   "chunk_id long, doc_name string, section_heading string, chunk_text string, brd_section_id string").coalesce(2)
    asked = {1: "plan the sites", 2: "zebra supply plan", 3: "nothing here", 4: "", 5: "demand"}
    queries = spark.createDataFrame([(q, t, str(q % 3)) for q, t in asked.items()], "q_id long, query string, section_id string")
    terms = {r["q_id"]: set(r["t"]) for r in queries.select("q_id", R.X.expand_terms(F.col("query")).alias("t")).collect()}
    head = {i: [words[i % 8]] if i % 2 else [] for i in texts}
    body = {i: (t or "").split() for i, t in texts.items()}
    avgdl = sum(len(head[i]) + len(body[i]) for i in texts) / len(texts)

    def score(q, i):
        norm, s = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * (len(head[i]) + len(body[i])) / avgdl), 0.0
        for t in terms[q]:
            df = sum(t in head[j] or t in body[j] for j in texts)
            for tf, w in ((head[i].count(t), fixed.HEADING_WEIGHT), (body[i].count(t), fixed.BODY_WEIGHT)):
                s += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * w * tf * (fixed.BM25_K1 + 1) / (tf + norm)
        return round(s, 9)

    docs = spark.createDataFrame([("N1.pdf",), ("n2.PDF",)], "doc_name string")
    cases = {"all": ({}, lambda q, i: True), "docs": ({"docs": docs}, lambda q, i: i % 4 in (1, 2)),
             "section": ({"section": True}, lambda q, i: ["", "1", "2", None][i % 4] in ("", str(q % 3)))}
    for (options, fits), rows, asks in zip(cases.values(), (3, 7, 5), (1, 2, 1000), strict=True):
        monkeypatch.setattr(B, "ROWS", rows)
        monkeypatch.setattr(B, "QUERIES", asks)
        made = R.bm25_search(queries, chunks, 3, **options)
        want = []
        for q in asked:
            best = sorted((-score(q, i), i) for i in texts if score(q, i) > 0 and fits(q, i))[:3]
            want += [(q, n, i) for n, (_, i) in enumerate(best, 1)]
        assert sorted((r["q_id"], r["rn"], r["chunk_id"]) for r in made.collect()) == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(coalesce(chunk_text" not in plan and "Aggregate [q_id" not in plan
