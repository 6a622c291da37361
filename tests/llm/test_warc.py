"""WARC archives: odd payloads come back whole, revisits refer to the smallest page, the merge orders globally."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from brieflens.llm import warc

SCHEMA = "page_id long, url string, html string, Bytes int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = h or ""
        keep = first.get(h, i)
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out)


def test_odd_payloads_and_global_order(spark):
    rng = random.Random(3)
    odd = ["", None, "\r\n", "\r\n\r\n", "a\r\n", "a\r\n\r\n", "\r\n\r\nWARC/1.0\r\nx: y\r\n\r\n", "WARC/1.0\r\n\r\n\r\n", "é" * 70, "\x00\r\r\n\n"]
    rows = [(i, f"http://h{i % 3}.example/{rng.randint(0, 9)}", h) for i, h in enumerate(odd)]
    for i in range(len(odd), 160):
        body = "".join(rng.choice(["\r", "\n", "\r\n", "w", "é"]) for _ in range(rng.randint(0, 12)))
        rows.append((i, None if i % 40 == 0 else f"https://www.Hot.example:443/p?q={rng.randint(0, 3)}", body + "z" * rng.choice([0, 0, 99, 100, 101])))
    frame = pages(spark, rows).repartition(5)
    found = [x.asDict() for x in warc.histories(warc.read(spark, written(frame)), range_rows=20).collect()]
    got = sorted((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in found)
    assert got == expected(rows)
    assert all(x["intact"] for x in found)
    found.sort(key=lambda x: (x["range_id"], x["place"]))
    keys = [(x["urlkey"], x["ts"], x["page_id"]) for x in found]
    assert keys == sorted(keys)
    assert len({x["range_id"] for x in found}) > 3


def written(frame):
    from brieflens.llm.common import shared_dir
    path = f"{shared_dir(frame.sparkSession)}/warc-test-{random.random()}"
    warc.write(frame, path)
    return path


def test_empty_table(spark):
    assert warc.archive(pages(spark, [])).count() == 0


def test_null_id_and_repeated_rows(spark):
    long = "k" * 200
    rows = [(None, "u", long), (4, "u", long), (4, "u", long), (2, "v", "short"), (2, "v", "short")]
    got = sorted((str(x.page_id), x.record_type, x.refers_to) for x in warc.archive(pages(spark, rows)).collect())
    assert got == [("2", "response", None), ("2", "response", None), ("4", "response", None), ("4", "response", None), ("None", "revisit", 4)]


@given(st.lists(st.lists(st.integers(0, 50), max_size=8), max_size=9))
def test_loser_tree_merges(lists):
    tree = warc.LoserTree()
    for k, x in enumerate(lists):
        tree.open([((v,), k * 100 + i, None) for i, v in enumerate(sorted(x))])
    out = []
    while tree.top() is not None:
        out.append(tree.pop()[0][0])
    assert out == sorted(v for x in lists for v in x)


def test_url_key():
    assert warc.url_key("http://www.Example.com:80/A?b=1") == "com,example)/a?b=1"
    assert warc.url_key("") == ")/"
