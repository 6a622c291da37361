"""The pipeline's stages on a small fixture, each against a plain restatement of what it should keep."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        toxic = i % 6 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), "vileinsult")
        if i % 7 == 1:
            text.insert(3, "x.y@mail.example")
        rows.append([i, " ".join(text)])
        labels.append((i, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    for k in range(20):
        rows.append([300 + k, clean[k][1].replace(" ", "  ", 1)])
        rows.append([400 + k, clean[40 + k][1] + " tail"])
    rows += [[500, ""], [501, None], [502, " "], [503, "word " * 5000]]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = fixture()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, exact, near, redacted = seen
    assert set(toxic) == {i for i, t in rows if "vileinsult" not in (t or "")}
    first = {}
    for i, t in sorted(toxic.items()):
        first.setdefault(" ".join((t or "").replace("  ", " ").split(" ")), i)
    assert set(exact) == set(first.values())
    assert set(near) == {i for i, _, least in brute(sorted(exact.items()), 5, 80, 100) if i == least}
    assert len(near) < len(exact) < len(toxic)
    for i, t in redacted.items():
        assert t == (near[i].replace("x.y@mail.example", "[EMAIL]") if near[i] else near[i])
    assert {r.doc_id: r.n_chars for r in docs.collect() if r.text is not None} == {i: len(t) for i, t in redacted.items() if t is not None}


def test_run_packs_what_the_stages_keep(spark, tables):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder).collect()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fills = {}
    for r in out:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048
    ids = tool.encode("word " * 5000, add_special_tokens=False).ids + [0]
    parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 503)
    at, want = 0, []
    for piece in range(-(-len(ids) // 2048)):
        n = (len(ids) - 1) % 2048 + 1 if piece == 0 else 2048
        want.append((piece, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at:at + n]))))
        at += n
    assert parts == want
