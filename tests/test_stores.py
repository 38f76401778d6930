"""The store of vectors, office files, upload records and external labels."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import clauses, retrieval
from ledgerloom.sources import files, office
from ledgerloom.sources.vectors import VectorStore, routed

VECTORS = "shard string, id long, lang string, embedding array<float>"


def vectors(spark, *shards, lang=None):
    return spark.createDataFrame([(s, k, lang, [float(k), len(s) / 2]) for s in shards for k in range(50)], VECTORS)


def rows_of(df):
    return sorted((r["shard"], r["id"], tuple(r["embedding"])) for r in df.collect())


def test_only_changed_shards_are_written(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.versions() == []
    first = vectors(spark, "a", "b", "c")
    assert store.publish(first) == 0 and rows_of(store.read()) == rows_of(first)
    assert store.publish(first.orderBy(F.desc("id")).repartition(5)) == 1  # the same rows in another order
    assert store.manifest(0).select("folder").distinct().collect() == store.manifest(1).select("folder").distinct().collect()
    second = vectors(spark, "a", "d").union(vectors(spark, "b").where("id < 20"))
    assert store.publish(second) == 2 and rows_of(store.read()) == rows_of(second)
    folders = {r["shard"]: r["folder"] for r in store.manifest().collect()}
    assert set(folders) == {"a", "b", "d"} and folders["b"] == folders["d"] != folders["a"]
    # A reader that has chosen a version still has it.
    assert rows_of(store.read(0)) == rows_of(first)
    store.vacuum(keep=1)
    assert store.versions() == [2] and rows_of(store.read()) == rows_of(second)


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    store.publish(vectors(spark, "a", "b"))
    broken = vectors(spark, "a", "x").withColumn("embedding", F.when((F.col("id") == 7) & (F.col("shard") == "x"), F.raise_error("dead")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="dead"):
        store.publish(broken)
    os.makedirs(tmp_path / "store" / "manifest-1")  # begun, not finished
    assert store.versions() == [0] and rows_of(store.read()) == rows_of(vectors(spark, "a", "b"))


def test_broken_shards_are_told(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    store.publish(vectors(spark, "a"))
    store.publish(vectors(spark, "a", "b"))
    assert store.broken().count() == 0
    folder = {r["shard"]: r["folder"] for r in store.manifest().collect()}["b"]
    for path in glob.glob(str(tmp_path / "store" / folder / "*.parquet")):
        with open(path, "r+b") as f:
            f.truncate(30)
    assert [tuple(r) for r in store.broken().collect()] == [("b", 50, 0)]
    assert {r["shard"] for r in store.read(skip_broken=True).collect()} == {"a"}
    with pytest.raises(Exception):  # noqa: B017
        store.read().collect()


def test_routes(spark):
    both = routed(vectors(spark, "a", lang="en").union(vectors(spark, "b")))
    assert {(r["shard"], r["route"]) for r in both.select("shard", "route").distinct().collect()} == {("a", "en"), ("b", "zh")}


REPORT = "# 标题 & <x>\n\nFirst **bold** line\n| a | b |\n|---|:---:|\n| 1 | 2.50 |\n| x | -3 |\nlast \x01line"


def test_office_files_open_again(spark, tmp_path):
    office.register(spark)
    reports = spark.createDataFrame([("r.docx", REPORT), ("r.xlsx", REPORT), ("empty.docx", None)], "name string, text string")
    for _ in range(2):  # a file of the same name is replaced
        reports.write.format("office").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["empty.docx", "r.docx", "r.xlsx"]
    got = {r["name"]: r for r in files.read_materials(spark, str(tmp_path / "out")).collect()}
    assert "标题 & <x>" in got["r.docx"]["text"] and "First bold line" in got["r.docx"]["text"] and "2.50" in got["r.docx"]["text"] and "last line" in got["r.docx"]["text"]
    assert "1,2.50" in got["r.xlsx"]["text"] and "x,-3" in got["r.xlsx"]["text"] and got["empty.docx"]["note"] == ""


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    office.register(spark)
    for bad in ("bad.exe", "../up.docx", ".hidden.docx"):
        rows = spark.createDataFrame([(f"f{k}.docx", "text") for k in range(20)] + [(bad, "x")], "name string, text string").repartition(4)
        with pytest.raises(Exception, match="no name of an office file"):
            rows.write.format("office").mode("append").save(str(tmp_path / "out"))
    same = spark.createDataFrame([("a.docx", "1"), ("a.docx", "2")], "name string, text string").repartition(2)
    with pytest.raises(Exception, match="two rows have one name"):
        same.write.format("office").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_upload_records(spark):
    rows = [("p1", "a.txt", b"hello"), ("p1", "blank.txt", b" \n"), ("p2", "a.txt", b"hello"), ("p1", ".a.txt", b"x"), ("p1", "x\\a.txt", b"x")]
    got = {(r["project_id"], r["name"]): r for r in files.materials(spark.createDataFrame(rows, "project_id string, name string, content binary")).collect()}
    assert set(got) == {("p1", "a.txt"), ("p1", "blank.txt"), ("p2", "a.txt")}
    mid = hashlib.sha256(b"p1:a.txt:5").hexdigest()[:12]
    r = got["p1", "a.txt"]
    assert (r["material_id"], r["orig_ref"], r["text_ref"], r["text_len"]) == (mid, f"project_inputs/p1_{mid}_a.txt", f"project_inputs/p1_{mid}.txt", 5)
    assert got["p1", "blank.txt"]["text_ref"] is None and got["p2", "a.txt"]["material_id"] != mid


def test_labels_from_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"x_0": {"taxes": ["增值税"], "rules": []}, "x_1": {"subjects": ["s"]}}))
    (tmp_path / "2.json").write_text(json.dumps({"x_1": {"taxes": ["印花税"]}}))
    own = spark.createDataFrame([("x_0", ["old"], ["r"]), ("x_1", ["old"], ["r"]), ("x_2", ["old"], ["r"])], "id string, taxes array<string>, rules array<string>")
    got = clauses.overlay(own, files.read_labels(spark, str(tmp_path)), "id", ["taxes", "rules"])
    assert {r["id"]: (r["taxes"], r["rules"]) for r in got.collect()} == {"x_0": (["增值税"], []), "x_1": (["印花税"], ["r"]), "x_2": (["old"], ["r"])}


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    marks = str(tmp_path / "loads")
    os.makedirs(marks)

    def load():
        import uuid

        open(f"{marks}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t)), 3.0, 0.0] for t in texts]

    rows = spark.createDataFrame([(k, "x" * (k % 9) if k % 10 else None, 1.5) for k in range(400)], "id long, text string, embedding double").repartition(16)
    got = retrieval.embed(rows, f"test {marks}", load, at_once=7)
    for _ in range(2):
        found = {r["id"]: r["embedding"] for r in got.collect()}
    for k in range(400):
        n = k % 9
        want = None if k % 10 == 0 else [n / (n * n + 9) ** 0.5, 3 / (n * n + 9) ** 0.5, 0.0]
        assert found[k] is None if want is None else all(abs(a - b) < 1e-6 for a, b in zip(found[k], want))
    loads = [name.split("-")[0] for name in os.listdir(marks)]
    assert loads and len(loads) == len(set(loads))
