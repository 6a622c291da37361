"""The n-gram join against brute force: edits around the threshold, hot groups, shared passages, odd rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brieflens.llm import ngram_join as N
from brieflens.llm.components import components

SCHEMA = "doc_id long, text string, sid string, Node int"


def gram_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    width = min(n, len(words))
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute(rows, n, num, den):
    sets = [(i, gram_set(t, n)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k), i)) for k, (i, s) in enumerate(sets)), key=str)


def found(spark, rows, n, like, parts=3):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.joined(df, n, like).collect()), key=str)


def near_copies(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, ""), (1, None), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "One two\x0bthree"), (7, "é É"), (8, "É é"), (9, "one two")]
    passage = [f"p{k}" for k in range(50)]
    for group in range(6):  # groups of edited copies around the threshold
        base = [f"g{group}w{k}" for k in range(rng.choice([6, 12, 40, 200, 700]))]
        for _ in range(12):
            rows.append((len(rows), near_copies(rng, base, rng.randint(0, 2 + len(base) // 60))))
    hot = [f"h{k}" for k in range(60)]
    rows += [(len(rows) + k, near_copies(rng, hot, rng.randint(0, 2))) for k in range(80)]
    rows += [(len(rows) + k, " ".join(passage + [f"u{k}x{j}" for j in range(rng.randint(0, 30))])) for k in range(60)]
    rows += [(len(rows) + k, "same words in every row of this group here") for k in range(30)]
    return rows


@pytest.mark.parametrize(("n", "num", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, n, num, seed):
    rows = corpus(seed)
    assert found(spark, rows, n, N.Likeness(num, 100)) == brute(rows, n, num, 100)


def test_tiles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 8)  # so that blocks are cut into tiles
    rows = corpus(3)
    rows += [(None, rows[20][1]), (None, "lonely words of nobody at all"), rows[30], rows[30]]
    assert found(spark, rows, 3, N.Likeness(70, 100), parts=1) == brute(rows, 3, 70, 100)


def test_empty_table(spark):
    assert found(spark, [], 4, N.Likeness(85, 100)) == []


def test_survivors_keep_columns_and_rows_without_id(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (9, "")]
    kept = N.survivors(spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "sid", "Node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.data())
def test_linked_sets_share_a_key(size, data):
    """Whatever is exchanged between two sets that still link, some key is in both."""
    like = N.Likeness(*data.draw(st.sampled_from([(85, 100), (80, 100), (60, 100)])))
    rng = np.random.default_rng(data.draw(st.integers(0, 10 ** 6)))
    other = data.draw(st.integers(like.smallest(size), size))
    least = int(like.overlap(size, other))
    shared = data.draw(st.integers(min(least, other), other))
    pool = rng.integers(0, 1 << 63, size + other, dtype=np.uint64)
    a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:shared], pool[size:size + other - shared]]))
    if like.links(len(np.intersect1d(a, b)), len(a), len(b)):
        assert np.intersect1d(N.set_keys(a, like), N.set_keys(b, like)).size


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(0, 900))
def test_tree_finds_all_points_within_the_bound(seed, count):
    rng, like = np.random.default_rng(seed), N.Likeness(85, 100)
    base = rng.poisson(3, (max(1, count // 20), N.DIMS))
    points = np.maximum(0, base[rng.integers(0, len(base), count)] + rng.integers(-1, 2, (count, N.DIMS)))
    points[:, 0] += 1
    tree = N.CountTree(points, like)
    for q in points[:20]:
        want = [k for k, p in enumerate(points) if np.minimum(p, q).sum() >= like.overlap(int(p.sum()), int(q.sum()))
                and like.smallest(int(q.sum())) <= p.sum() <= like.largest(int(q.sum()))]
        assert sorted(tree.near(q).tolist()) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
