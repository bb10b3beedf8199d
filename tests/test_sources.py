from __future__ import annotations

import json

from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.sources import files
from patchlens.streaming import events


def test_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps([{"public_id": "1", "raw": "é"}, {"public_id": "2", "url": "u"}]), encoding="utf-8")
    (tmp_path / "a/bad.json").write_text("{ not json")
    (tmp_path / "a/y.txt").write_text("[]")
    assert files.read_json(spark, str(tmp_path / "a/x.json"), files.DETAIL_JSON).count() == 2
    d = files.read_json_folder(spark, str(tmp_path / "a"), files.DETAIL_JSON)
    assert sorted((r.public_id, r.raw) for r in d.collect()) == [("1", "é"), ("2", None)]
    files.write_json(d, str(tmp_path / "out"))
    assert spark.read.schema(files.DETAIL_JSON).json(str(tmp_path / "out")).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.json").write_text("[2]")
    assert {r.file_name: r.content for r in files.merged_by_file(spark, str(tmp_path)).collect() if r.file_name == "x.json"} == {"x.json": "[2]"}


def test_libraries_and_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("public_id,library_id,library_name,vendor,platform,version_id,version_number\nC2,1,b,v,p,9,10\nC1,1,b,v,p,8,10\nC1,1,a,v,p,7,9\n")
    assert [(r.library_name, r.public_id) for r in files.read_libraries(spark, str(tmp_path / "l.csv")).collect()] == [("a", "C1"), ("b", "C1"), ("b", "C2")]
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    for name, text in (("a.c", "int x;"), ("sub/b.HPP", "y" * 50), ("c.c", ""), ("d.py", "z")):
        (src / name).write_text(text)
    assert [r.path.rsplit("/", 1)[1] for r in files.find_sources(spark, str(src)).collect()] == ["b.HPP", "a.c"]
    (src / "bin").write_bytes(b"\x7fELF" + b"0" * 200)
    assert files.find_binaries(spark, str(src)).count() == 1


def test_listing(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert [(r.line_no, r.line) for r in files.read_listing(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a"), (1, "b"), (2, "")]


def test_details(spark):
    row = ("C1", "u", "raw", "h", "src/a.c", "f")
    d = spark.createDataFrame([row, row, ("C1", "u", "", "h", "a.c", "f"), ("C1", "u", "raw", "h", "a.py", "f"), ("C2", "u", "raw", "h", "x.HH/b.cc", None)], files.DETAIL_JSON)
    assert {r.public_id: len(r.details) for r in files.patch_details(d).collect()} == {"C1": 1, "C2": 1}


def test_scores(spark, tmp_path):
    d = spark.createDataFrame([(True, False, [(1, 0.5, 0.25)]), (True, True, []), (False, True, [(0, 1.0, 2.0), (3, 1.0, 2.0)])], "has_vul_function boolean, has_vul boolean, snippets array<struct<diff_num int, vul_score double, fix_score double>>")
    files.write_scores(d, str(tmp_path / "s"))
    assert [tuple(r) for r in files.read_scores(spark.read.text(str(tmp_path / "s"))).collect()] == [(True, False, 1, 0.5, 0.25)]


def test_small_things(spark, tmp_path):
    d = spark.createDataFrame([("/a/b/c.c",)], "p string")
    assert d.select(files.moved(F.col("p"), "/a/", "/z/", ".json")).first()[0] == "/z/b/c.json"
    assert files.compile_matrix(d).count() == 8
    files.write_features(spark.createDataFrame([("x", 1), ("y.json", 2), ("zi64", 3)], "file string, n int"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    for name, ddl in vars(schemas).items():
        if name.isupper():
            assert spark.createDataFrame([], ddl).columns


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:{i % 60:02d}:00", i % 5, "ab"[i % 2], float(i)) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id int, t string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = events.tumbling(s).writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, events.tumbling(e).collect()))
