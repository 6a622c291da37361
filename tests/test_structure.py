"""Order-dependent folds and clean-up rules against small independent restatements."""

import random

from pyspark.sql import functions as F

from brieflens.functions import markdown as M
from brieflens.functions import structure as S
from brieflens.operators import context as C
from brieflens.operators.numbering import number_by_id


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def packed(text, limit, overlap):
    """Plain restatement of paragraph packing."""
    parts, size, out = [], 0, []
    for p in [p.strip() for p in text.split("\n") if p.strip()]:
        if parts and size + len(p) > limit:
            out.append("\n".join(parts))
            keep, n = [], 0
            for q in reversed(parts):
                if n + len(q) > overlap:
                    break
                keep, n = [q] + keep, n + len(q)
            parts, size = keep, n
        parts.append(p)
        size += len(p)
    return out + (["\n".join(parts)] if parts else [])


def test_pack_paragraphs(spark):
    rnd = random.Random(3)
    texts = ["", " \n ", "x" * 50, "a" * 20 + "\n" + "b" * 20 + "\n" + "c"]
    texts += ["\n".join("w" * rnd.randint(0, 15) + str(i) for i in range(rnd.randint(1, 25))) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", S.pack_paragraphs(F.col("t"), 40, 10).alias("c")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert [c["text"] for c in r["c"]] == packed(text, 40, 10)
        for c in r["c"]:
            assert c["char_start"] >= 0 and c["char_end"] <= len(text)


def test_pack_parts_keeps_all(spark):
    for count, size, budget in ((100, 1000, 200_000), (60, 1000, 10_000)):
        blocks = [(f"=== {i} ===", "y" * size) for i in range(count)]
        parts = one(spark, lambda c: S.pack_parts(c, budget), blocks, "array<struct<label:string,text:string>>")
        assert len(parts) == count and parts == sorted(parts)
        assert (max(parts) == 1) == (budget > 110_000)
        assert all(sum(size for p in parts if p == k) <= budget * 1.5 for k in set(parts))


def test_heading_paths(spark):
    paras = [("Normal", "intro"), ("Heading 1", "A"), ("Normal", "a1"), ("Heading 3", "A.x"), ("Normal", "a2"),
             ("Heading 2", "B"), ("Normal", "b1"), ("Heading 1", "C"), ("Normal", "c1")]
    got = one(spark, S.heading_path_chunks, paras, "array<struct<style:string,text:string>>")
    assert [(c["path"], c["body"]) for c in got] == [
        ("(No Heading)", "intro"), ("A", "a1"), ("A > A.x", "a2"), ("A > B", "b1"), ("C", "c1")]


def test_assign_section_ids(spark):
    toc = [("Intro", 1), ("Scope", 2), ("7.1.1 Deep", 1), ("Next", 3), ("After", 1)]
    got = one(spark, S.assign_section_ids, toc, "array<struct<title:string,level:int>>")
    assert [(e["id"], e["title"], e["level"]) for e in got] == [
        ("1", "Intro", 1), ("1.1", "Scope", 2), ("7.1.1", "Deep", 3), ("7.1.2", "Next", 3), ("8", "After", 1)]


def test_strict_tables(spark):
    text = "x\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |\n\n| no | sep |\n"
    got = one(spark, S.extract_tables_strict, text)
    assert [(t["headers"], t["rows"]) for t in got] == [(["a", "b"], [["1", "2"]])]
    assert one(spark, M.normalize_table_text, "p\n|a|b|\n|---|---|\n|1|  2|\nend") == "p\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\nend".replace("\n\n", "\n\n")


def test_html_page(spark):
    page = "<html><head><title>T</title></head><body><script>x()</script><h1>Head</h1><p>One &amp; two</p><ul><li> item </li></ul></body></html>"
    assert one(spark, lambda c: M.html_to_text(c, 500), page) == "**Head**One & two\n- item"
    assert one(spark, lambda c: M.html_to_text(c, 10), page).endswith("\n\n...(truncated)")


def test_cross_section_dedupe(spark):
    hits = [("p", o, f"s{o}", c, r) for o in range(3) for r, c in enumerate([1, 2, 3, 4, 5, 6, 7, 8], 1)]
    rows = spark.createDataFrame(hits, "project_id string, ord int, section_id string, chunk_id long, rn int")
    got = C.cross_section_dedupe(rows, 2).orderBy("section_id", "rn").collect()
    assert [(r["section_id"], r["chunk_id"]) for r in got] == [("s0", 1), ("s0", 2), ("s1", 3), ("s1", 4), ("s2", 5), ("s2", 6)]
    starved = C.cross_section_dedupe(rows, 3).orderBy("section_id", "rn").collect()
    assert [r["chunk_id"] for r in starved] == [1, 2, 3, 4, 5, 6, 1, 2, 3]  # two left: the last list is kept whole


def test_number_by_id_across_ranges(spark):
    rows = spark.range(0, 1000, 7).withColumn("g", (F.col("id") % 2).cast("string"))
    got = number_by_id(rows, ["g"], "id", "n", width=50).collect()
    for g in ("0", "1"):
        ids = sorted(r["id"] for r in got if r["g"] == g)
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])] == list(range(1, len(ids) + 1))
