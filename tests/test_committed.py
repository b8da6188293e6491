"""Committed outputs: all rows or nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evalmill.sources import committed


def files(root):
    return [f for f in glob.glob(f"{root}/**/*", recursive=True) + glob.glob(f"{root}/.*") if os.path.isfile(f)]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.range(1000).repartition(4).withColumn("x", F.when(F.col("id") == 700, F.raise_error(F.lit("broken row"))).otherwise(1))
    with pytest.raises(Exception, match="broken row"):
        committed.write_committed(rows, root)
    assert committed.read_manifest(root)["commits"] == 0 and not os.path.exists(f"{root}/{committed.MANIFEST}")
    with pytest.raises(ValueError, match="nothing is published"):
        committed.read_committed(spark, root)
    committed.write_committed(spark.range(10), root, expected=10)  # what a failed run left doesn't matter
    assert committed.read_committed(spark, root).count() == 10


def test_commit_counts_rows_and_refuses_overwrite(spark, tmp_path):
    root = f"file:{tmp_path}/out"
    with pytest.raises(Exception, match="99 rows were written, 100 were expected"):
        committed.write_committed(spark.range(99).repartition(3), root, expected=100)
    assert files(tmp_path) == []
    committed.write_committed(spark.range(100).repartition(3), root, expected=100)
    with pytest.raises(Exception, match="nothing is overwritten"):
        committed.write_committed(spark.range(5), root)
    committed.write_committed(spark.range(100, 105), root, append=True)
    found = committed.read_manifest(root)
    assert found["rows"] == 105 and found["commits"] == 2
    assert sorted(r["id"] for r in committed.read_committed(spark, root).collect()) == list(range(105))
    assert len(files(tmp_path)) == len(found["files"]) + 1


def test_an_empty_output_is_an_output(spark, tmp_path):
    committed.write_committed(spark.range(0), str(tmp_path / "out"), expected=0)
    assert committed.read_manifest(str(tmp_path / "out"))["commits"] == 1


def test_predictions_need_every_input_once(spark, tmp_path):
    inputs = spark.createDataFrame([("a",), ("b",)], "path string")
    scores = lambda *rows: spark.createDataFrame(rows, "path string, s double")
    for n, rows in enumerate(([("a", 0.1)], [("a", 0.1), ("b", 0.2), ("b", 0.3)], [("a", 0.1), ("b", 0.2), ("c", 0.3)])):
        with pytest.raises(ValueError, match="inputs and"):
            committed.write_predictions(scores(*rows), inputs, str(tmp_path / f"no{n}"), "path", F.col("s"))
    committed.write_predictions(scores(("b", 0.2), ("a", 0.1)), inputs, str(tmp_path / "yes"), "path", F.col("s"))
    assert sorted(map(tuple, committed.read_committed(spark, str(tmp_path / "yes")).collect())) == [("a", 0.1), ("b", 0.2)]


CONTENT = "path string, sha string, size long, label int"


def test_contents_once_and_compared(spark, tmp_path):
    root = str(tmp_path / "contents")
    rows = lambda *r: spark.createDataFrame(r, CONTENT)
    first = committed.write_contents(rows(("x/a.PNG", "aa11", 5, 0), ("y/b.png", "aa11", 5, 1), ("c.jpg", "bb22", 7, 0)), root, "sha", "path", "size")
    assert sorted(map(tuple, first.collect())) == [("aa11", "new"), ("bb22", "new")]
    again = committed.write_contents(rows(("z.png", "aa11", 5, 0), ("d", "cc33", 1, 0)), root, "sha", "path", "size")
    assert sorted(map(tuple, again.collect())) == [("aa11", "known"), ("cc33", "new")]
    back = {r["sha256"]: (r["archive_path"], r["n_paths"]) for r in committed.read_committed(spark, root).collect()}
    assert back == {"aa11": ("images/aa/aa11.png", 2), "bb22": ("images/bb/bb22.jpg", 1), "cc33": ("images/cc/cc33", 1)}
    assert all("/prefix=" in f["name"] for f in committed.read_manifest(root)["files"])
    for wrong in (rows(("z.png", "aa11", 6, 0)), rows(("p", "dd44", 1, 0), ("q", "dd44", 2, 0))):
        with pytest.raises(ValueError, match="more than one size"):
            committed.write_contents(wrong, root, "sha", "path", "size")
    assert committed.read_committed(spark, root).count() == 3


def test_package_rewrites_manifests(spark, tmp_path):
    one = spark.createDataFrame([("x/a.png", "aa11", 5, 0), ("b.png", "bb22", 6, 1)], CONTENT)
    two = spark.createDataFrame([("q/z.png", "bb22", 6, 1)], CONTENT)
    report = {r["packaged_manifest"]: r for r in committed.write_package({"/train/list.jsonl": one, "/eval/list.jsonl": two}, str(tmp_path / "p"), "sha", "path", "size").collect()}
    assert {k: (r["source_manifest"], r["n_lines"]) for k, r in report.items()} == {"list.jsonl": ("/train/list.jsonl", 2), "eval-list.jsonl": ("/eval/list.jsonl", 1)}
    back = committed.read_committed(spark, str(tmp_path / "p" / "manifests" / "eval-list.jsonl")).collect()
    assert [r.asDict() for r in back] == [{"label": 1, "size": 6, "path": "../images/bb/bb22.png", "image_sha256": "bb22"}]
    assert committed.packaged_names(["/a/m", "/b/m", "n"]) == {"/a/m": "m", "/b/m": "b-m", "n": "n"}
    with pytest.raises(ValueError, match="no free name"):
        committed.packaged_names(["/a/m", "/x/b/m", "/y/b/m"])
