"""Fill-in-middle: frames, cuts, forms and round trips against plain string work."""

import hashlib

import pytest

from brieflens.llm import infill as I

SHAPE = "doc_id long, text string, form string, N int"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(text), form, a, b - a, sha(out), sha(text)


TEXTS = ["", None, "a", "ab", "<", "<<P", "P>x", "<P>", "say <M> here", "naïve 😀 texts ñ" * 9, "<<<>>>" * 30, "\x00\n\t ", "x" * 5000,
         "a<S", "é" * 1000, "𝔘𝔫𝔦" * 333]


@pytest.mark.parametrize("size", [1, 3, 64, I.FRAME])
def test_equals_string_work(spark, size):
    rows = [(i, TEXTS[i % len(TEXTS)], "f", 1) for i in range(10 * len(TEXTS))] + [(None, "no id", None, None), (3, "again", "f", 1), (3, "again", "f", 1)]
    got = I.restored(I.transformed(I.framed(spark.createDataFrame(rows, SHAPE), size), size)).collect()
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert I.restored(I.transformed(I.framed(spark.createDataFrame([], SHAPE)))).collect() == []


def test_ranges_and_ends():
    text = "".join(chr(0x61 + k % 26) for k in range(1000))
    for size in (1, 7, 1000, 4096):
        packed = I.packed([text[:10], "", text[10:300], text[300:]], size)
        assert packed.ends[-1] == 1000 and len(packed.frames) == -(-1000 // size)
        for a, b in ((0, 0), (0, 1000), (999, 1000), (7, 14), (6, 15), (1000, 1000), (333, 777)):
            assert "".join(packed.pieces(a, b)) == text[a:b]


def test_a_cut_unpacks_only_its_frames(monkeypatch):
    packed = I.packed(["ab" * 500], 10)
    seen = []
    real = I.Frames.unpacked
    monkeypatch.setattr(I.Frames, "unpacked", lambda self, k: seen.append(k) or real(self, k))
    assert "".join(packed.pieces(495, 505)) == "ba" * 5
    assert seen == [49, 50]


def test_markers_across_frames():
    text = "xx<P>yy<P><P>"
    for size in range(1, 15):
        assert list(I.places(I.packed([text], size), "<P>")) == [2, 7, 10]


def test_very_long_text_streams(spark):
    text = "déjà vu " * 400_000
    rows = spark.createDataFrame([(5, text, "", 0)], SHAPE)
    assert tuple(I.restored(I.transformed(I.framed(rows))).first()) == brute(5, text)
