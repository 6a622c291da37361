"""Exact deduplication and PNG columns on small tables, with the odd cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brieflens.llm import exact_dedup, media

SCHEMA = "doc_id long, text string, H int, sha string, kept string"
ROWS = [(3, "a  b"), (1, "a\tb"), (7, "a b"), (2, ""), (9, None), (4, " "), (5, "x" * 200_000), (6, "x" * 200_000), (None, "a b"),
        (None, "alone"), (8, "é b"), (10, "é b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "k") for i, t in rows], SCHEMA)


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.add((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def told(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_decisions(spark):
    assert told(exact_dedup.decisions(frame(spark, ROWS))) == expected(ROWS)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    weak = lambda text: F.length(text).cast("string").cast("binary")
    assert told(exact_dedup.decisions(frame(spark, rows), digest=weak)) == expected(rows)


def test_repeated_rows_and_survivors(spark):
    rows = ROWS + [(1, "a\tb"), (1, "a\tb"), (1, "other")]
    kept = exact_dedup.survivors(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "H", "sha", "kept"]
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert got == sorted((str(i), t) for i, t in [(1, "a\tb"), (1, "other"), (2, ""), (4, " "), (5, "x" * 200_000), (None, "alone"), (8, "é b"), (10, "é b")])
    one = [r for r in exact_dedup.decisions(frame(spark, rows)).collect() if r.doc_id == 1 and r.kept]
    assert sorted((r.group_size, r.copies) for r in one) == [(1, 1), (6, 3)]


def test_empty_table(spark):
    assert exact_dedup.decisions(frame(spark, [])).count() == 0
    assert exact_dedup.survivors(frame(spark, [])).count() == 0
    assert media.decode(media.encode_text(frame(spark, []))).count() == 0


def test_media_round_trip(spark):
    rows = [r for r in ROWS if r[0] is not None]
    found = {r.doc_id: r for r in media.decode(media.encode_text(frame(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = found[i]
        assert (r.n_bytes, bytes(r.payload), r.payload_bytes) == (len(raw), padded, len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.error is None and len(r.phash) == 8
    assert found[5].feature == found[6].feature and found[5].media_sha256 == found[6].media_sha256


def filtered(rows, kinds, bpp):
    """PNG filters, written out from their definition."""
    out, up = [], [0] * len(rows[0])
    for row, kind in zip(rows, kinds, strict=True):
        line = [kind]
        for x, v in enumerate(row):
            a = row[x - bpp] if x >= bpp else 0
            c = up[x - bpp] if x >= bpp else 0
            b = up[x]
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
        up = row
    return np.array(out, np.uint8)


@given(st.data(), st.integers(1, 4), st.integers(1, 5), st.integers(1, 4))
def test_unfilter_undoes_all_filters(data, bpp, width, height):
    rows = [data.draw(st.lists(st.integers(0, 255), min_size=width * bpp, max_size=width * bpp)) for _ in range(height)]
    kinds = data.draw(st.lists(st.integers(0, 4), min_size=height, max_size=height))
    assert media.unfilter(filtered(rows, kinds, bpp), bpp).tolist() == rows


@pytest.mark.parametrize("at", [3, 20, 40, -20, -6])
def test_damage_is_found(at):
    good = bytearray(media.write_png(media.pad(b"some text " * 30)))
    good[at] ^= 1
    with pytest.raises((media.DamagedImage, zlib.error)):
        media.read_png(bytes(good))
    assert media.features(bytes(good))[-1]
    assert media.features(None)[-1]
    with pytest.raises(media.DamagedImage):
        media.read_png(bytes(media.write_png(b"x" * 64)[:-4]))
