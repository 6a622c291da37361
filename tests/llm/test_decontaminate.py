"""Positional index, phrase and proximity search against plain loops over words."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brieflens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                here = wins.get(tuple(w[k:k + n]))
                if here:
                    hit |= set(range(k, k + n))
                    ids |= here
        out.append((doc, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, segment string, IDS int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number int")
    return D.contamination(D.indexed(d, size=more.pop("size", D.SEGMENT)), b, **more)


def texts(seed, n, longest, vocabulary):
    r = np.random.default_rng(seed)
    return [" ".join(vocabulary[k] for k in r.integers(len(vocabulary), size=r.integers(longest))) for _ in range(n)]


def test_equals_brute_force(spark):
    vocabulary = ["a", "b", "ab", "ñandú", "Ñ", "X9", "9x", "ÉA", "the"]
    docs = list(enumerate(texts(1, 80, 60, vocabulary)))
    long = " ".join(t for _, t in docs)
    items = [(7, docs[3][1]), (12, docs[3][1]), (12, docs[3][1]), (100, "a b"), (5, "The; ab"), (None, "b a"), (9, ""), (10, None),
             (11, docs[20][1][:40] + " zzz"), (2, long[100:180]), (3, "not there at all"), (4, "9x-x9")]
    docs += [(500, None), (501, ""), (502, " ;; "), (503, long), (3, docs[3][1]), (None, "x A b y")]
    for width, size in ((10, 64), (3, D.SEGMENT), (1, 1)):
        got = run(spark, docs, items, width=width, size=size)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, width)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]).collect() == []
    assert [tuple(r) for r in run(spark, [(1, "a b")], []).collect()] == [(1, 2, 0, 0, [], False)]


def test_blocks_of_test_items_add_up(spark, monkeypatch):
    docs = list(enumerate(texts(5, 30, 50, ["a", "b", "c"])))
    items = list(enumerate(texts(6, 30, 6, ["a", "b", "c"])))
    monkeypatch.setattr(D, "BLOCK", 8)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.windows(b, 10).count() > 5
    assert sorted((tuple(r) for r in run(spark, docs, items).collect()), key=repr) == brute(docs, items)


def test_words_do_not_cross_documents(spark):
    got = run(spark, [(1, "a b"), (2, "c d")], [(1, "b c"), (2, "b")], width=10).collect()
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 1, 2: 0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAZz09 /:`{ñÿ\u0080\u007f😀\n", max_size=30), max_size=6))
def test_words_of_a_segment(parts):
    segment = D.Segment.of([p.encode() for p in parts])
    counts = [len(words(p)) for p in parts]
    assert (np.diff(segment.starts.astype(int)) - 1).tolist() == counts
    for k, part in enumerate(parts):
        for at, word in enumerate(words(part)):
            low, high, _ = D.word_hashes(word.encode())
            assert segment.starts[k] + at in segment.of_term(int(segment.find(low, high)[0]))
    assert len(segment.terms) == len({w for p in parts for w in words(p)}) and len(segment.places) == sum(counts)


def test_hash_does_not_depend_on_place_or_chunk(monkeypatch):
    text = ("word " * 50 + "x" * 300 + " Word").encode()
    whole = D.word_hashes(text)
    for size in (7, 64, 300):
        monkeypatch.setattr(D, "CHUNK", size)
        assert all((a == b).all() for a, b in zip(whole, D.word_hashes(text)))
    assert len(set(whole[0][:50])) == 1 and whole[0][0] == whole[0][-1]


def near(text, window, span):
    """Places covered by the least stretches of at most `span` words that hold all the words."""
    w, want, out = words(text), set(window), set()
    for first in range(len(w)):
        for last in range(first, min(first + span, len(w))):
            if want <= set(w[first:last + 1]) and not want <= set(w[first + 1:last + 1]) and not want <= set(w[first:last]):
                out |= set(range(first, last + 1))
    return out


def test_proximity(spark):
    docs = list(enumerate(texts(9, 60, 40, ["a", "b", "c", "d", "e", "f"])))
    for item, span in (("a c e", 4), ("f f b", 2), ("d", 5), ("a b c d", 9)):
        got = run(spark, docs, [(1, item)], span=span, size=200)
        assert {r["doc_id"]: r["n_hit"] for r in got.collect()} == {i: len(near(t, words(item), span)) for i, t in docs}


def test_rarest_list_comes_first(monkeypatch):
    segment = D.Segment.of([b"the the the the the rare the the the the"])
    low, high, _ = D.word_hashes(b"the rare the")
    sizes = []
    real = D.among
    monkeypatch.setattr(D, "among", lambda values, of: sizes.append(len(values)) or real(values, of))
    assert D.phrase(segment, segment.find(low, high)).tolist() == [4]
    assert sizes == [1, 1]


def test_wide_rows_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Row groups are closed by their size, not after a hundred segments; batches are small only while a table is stored."""
    import pyarrow.parquet as pq

    from brieflens.llm import common
    monkeypatch.setitem(common.WIDE_ROWS, "parquet.block.size", "100000")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(40)], "doc_id long, text string").coalesce(1)
    own = spark.conf.get(common.BATCH_BYTES)
    index = D.indexed(docs, size=10_000)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert sum(m.num_rows for m in groups) == 40 and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 8
    found = D.contamination(index, spark.createDataFrame([(1, " ".join(f"w7x{j}" for j in range(50, 80)))], "item_id long, text string"))
    assert [(r["doc_id"], r["n_hit"]) for r in found.collect() if r["contaminated"]] == [(7, 30)]
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, "1m"):
        assert spark.conf.get(common.BATCH_BYTES) == "1m" and 1 / 0
    assert spark.conf.get(common.BATCH_BYTES) == own
