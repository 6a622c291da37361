"""A cross-section of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, canonical_rows

SF = "/root/testdata/sf0.001"
NAMES = ["tokenize", "snippet", "bm25_search", "tfidf_search", "hybrid_search", "neighbor_expand", "keywords_tf",
         "outline_from_lines", "extract_tables", "check_term", "scorecard", "version_diff", "ttl_answer_dedupe",
         "image_search", "replace_file_chunks", "foreign_mentions"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = canonical_rows(df.columns, df.collect())
    cur = duck.execute(E.oracle_sql()[name])
    want = canonical_rows([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert E.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
