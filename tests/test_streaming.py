"""File uploads and repeated questions as streams."""

import shutil

import pytest
from pyspark.sql import functions as F

from brieflens.streaming import ingest, questions


@pytest.fixture
def upload(spark, tmp_path):
    """Run the stream over what lies in the folder; the store's rows as (project, id, file name, text)."""
    folder, store = tmp_path / "in", str(tmp_path / "store")

    def put(project, name, text):
        (folder / project).mkdir(parents=True, exist_ok=True)
        (folder / project / name).write_text(text)

    def run(checkpoint="cp"):
        ingest.start_ingest(spark, str(folder), store, str(tmp_path / "status"), str(tmp_path / checkpoint)).awaitTermination()

    def rows(version=None):
        return sorted((r["project_id"], r["chunk_id"], r["doc_name"], r["chunk_text"]) for r in ingest.read_store(spark, store, version).collect())

    return put, run, rows, tmp_path


def status(spark, path, batch):
    return {r["doc_name"]: (r["status"], r["chunk_count"]) for r in spark.read.parquet(f"{path}/status/batch={batch}").collect()}


def test_three_batches_with_a_replaced_file(spark, upload):
    put, run, rows, path = upload
    put("p1", "a.txt", "First line\nSecond line")
    put("p1", "empty.txt", " \n ")
    put("p2", "a.txt", "Elsewhere")
    run()
    first = [("p1", 0, "a.txt", "First line\nSecond line"), ("p2", 0, "a.txt", "Elsewhere")]
    assert rows() == first
    assert status(spark, path, 0) == {"a.txt": ("indexed", 1), "empty.txt": ("error", 0)}
    put("p1", "b.txt", "Other\n" + "z" * 2500)
    run()
    assert [r[:3] for r in rows()] == [("p1", 0, "a.txt"), ("p1", 1, "b.txt"), ("p1", 2, "b.txt"), ("p2", 0, "a.txt")]
    put("p1/again", "a.txt", "New text")
    put("p1", "c.txt", "Last")
    run()
    now = rows()
    assert {r[2]: r[3] for r in now if r[0] == "p1" and r[2] != "b.txt"} == {"a.txt": "New text", "c.txt": "Last"}
    assert sorted(r[1] for r in now if r[0] == "p1") == [1, 2, 3, 4] and len(now) == 5
    assert rows(0) == first  # an earlier version can still be read


def test_a_repeated_batch_changes_nothing(spark, upload):
    put, run, rows, path = upload
    files = spark.createDataFrame([("p", "a.txt", "one"), ("p", "b.txt", "two")], "project_id string, doc_name string, text string")
    store = str(path / "store")
    before = ingest.commit_batch(spark, store, files, "q", 0).count()
    want = rows()
    assert ingest.commit_batch(spark, store, files, "q", 0).count() == before == 2
    assert rows() == want and ingest.manifest(spark, store).select("version").distinct().count() == 1
    ingest.commit_batch(spark, store, files.limit(0), "q", 1)  # a batch without files
    assert rows() == want


def test_a_batch_that_failed_before_its_manifest_is_not_there(spark, upload):
    put, run, rows, path = upload
    files = spark.createDataFrame([("p", "a.txt", "one")], "project_id string, doc_name string, text string")
    store = str(path / "store")
    ingest.commit_batch(spark, store, files, "q", 0)
    ingest.commit_batch(spark, store, files.withColumn("text", F.lit("changed")), "q", 1)
    shutil.rmtree(f"{store}/manifest/version=1")
    assert [r[3] for r in rows()] == ["one"]
    ingest.commit_batch(spark, store, files.withColumn("text", F.lit("changed")), "q", 1)
    assert [r[3] for r in rows()] == ["changed"]


def test_lost_data_is_made_again_on_restart(spark, upload):
    put, run, rows, path = upload
    put("p1", "a.txt", "First")
    run()
    put("p1", "b.txt", "Second")
    run()
    want = rows()
    shutil.rmtree(path / "store" / "data" / "version=0")
    assert rows() != want
    put("p1", "c.txt", "Third")
    run()
    assert rows() == [*want, ("p1", 2, "c.txt", "Third")]
    shutil.rmtree(path / "store" / "data" / "version=1")
    (path / "in" / "p1" / "b.txt").unlink()
    with pytest.raises(ingest.StoreDamaged, match="b.txt"):
        run()


def test_no_silent_empty_start(spark, upload):
    put, run, rows, path = upload
    for n in range(3):
        put("p1", f"{n}.txt", f"Text {n}")
        run()
    shutil.move(path / "store" / "manifest" / "version=1", path / "kept")
    with pytest.raises(ingest.StoreDamaged, match="2 manifest versions of 3"):
        run()
    shutil.rmtree(path / "store")
    with pytest.raises(ingest.StoreDamaged, match="store is gone"):
        run()
    with pytest.raises(ingest.StoreDamaged, match="no manifest"):
        rows()


def test_repeated_questions(spark, tmp_path):
    rows = [("Same?", "2026-01-01 10:00:00"), ("same? ", "2026-01-01 10:10:00"), ("Other", "2026-01-01 10:20:00")]
    spark.createDataFrame(rows, "q string, t string").withColumn("at", F.to_timestamp("t")).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("q string, t string, at timestamp").parquet(str(tmp_path / "q"))
    keyed = stream.withColumns({"scope": F.lit("all"), "mode": F.lit("strict")}).withColumn("key", questions.question_key("q", "scope", "mode"))
    out = questions.first_seen(keyed, "key", "at")
    job = out.writeStream.format("memory").queryName("asked").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("asked").count() == 2
