import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from siltworks.sources import readers, sinks
from siltworks.sources.files import Files


def test_resolve_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.jsonl").write_text('﻿{"text": "one"}\n\n{"text": null, "x": 1}\n')
    with gzip.open(tmp_path / "sub" / "A.jsonl.gz", "wt") as f:
        f.write('{"text": "two"}\n')
    (tmp_path / "note.txt").write_text("no")
    files = readers.resolve(spark, [str(tmp_path)])
    assert [os.path.basename(f) for f in files] == ["b.jsonl", "A.jsonl.gz"]
    rows = readers.read_json_lines(spark, files, "text string").collect()
    assert sorted(str(r["text"]) for r in rows) == ["None", "one", "two"]
    assert len(readers.resolve(spark, [str(tmp_path)], include=["A*"])) == 1
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, [str(tmp_path)], (".parquet",))


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text": "ok"}\n[1]\n{"text": \n')
    got = readers.read_json_lines(spark, [str(p)], "text string", lenient=True)
    assert (got.count(), got.where("_bad").count()) == (3, 2)
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_json_lines(spark, [str(p)], "text string").collect()


def test_arrays_and_mixed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"d": {"rows": [{"text": "p"}, {"text": "q"}]}}))
    assert [r["text"] for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "text string", "d.rows").collect()] == ["p", "q"]
    spark.createDataFrame([("z", 1)], "text string, n int").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "l.jsonl").write_text('{"text": "y"}\n')
    df = readers.read_any(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "l.jsonl")], "text string")
    assert sorted(r["text"] for r in df.collect()) == ["y", "z"]
    assert readers.texts(df.union(spark.createDataFrame([(" ", "")], df.schema)), epochs=3, longest=1).count() == 6


def test_names(spark):
    df = spark.createDataFrame([("x/ch/web_0003.jsonl",), ("y/code_forge.jsonl.gz",), ("a/my_en/",)], "p string")
    r = df.select(readers.source_from_path(F.col("p")), readers.language_from_name(F.col("p")), readers.display_name(F.col("p"))).collect()
    assert [x[0] for x in r[:2]] == ["web", "code_forge"] and [x[1] for x in r] == ["unknown", "code", "en"] and r[2][2] == "my_en"


def test_dataset_round_trip_and_tampering(spark, tmp_path):
    folder = str(tmp_path / "set")
    df = spark.range(250).select(F.col("id"), F.array(F.col("id").cast("int")).alias("input_ids"))
    m = sinks.write_dataset(df, folder, "d", "pretraining", "v1", order="id", rows_per_shard=40)
    assert m["sample_count"] == 250 and len(m["shards"]) >= 7
    assert sinks.verify(spark, folder)["content_hash"] == m["content_hash"]
    back = sinks.read_dataset(spark, folder, ["id"])
    assert [tuple(r) for r in back.orderBy("global_index").select("id", "global_index").collect()] == [(i, i) for i in range(250)]
    with pytest.raises(FileExistsError):
        sinks.write_dataset(df, folder, "d", "pretraining", "v1")
    with pytest.raises(sinks.DatasetError):
        sinks.write_dataset(df.limit(0), str(tmp_path / "none"), "d", "pretraining", "v1")
    assert sorted(os.listdir(tmp_path)) == ["set"]
    broken = sinks.load_manifest(spark, folder) | {"version": "v2"}
    files = Files(spark)
    files.delete(f"{folder}/_manifest.json")
    files.write(f"{folder}/_manifest.json", json.dumps(broken))
    with pytest.raises(sinks.DatasetError):
        sinks.load_manifest(spark, folder)


def test_stages_and_lines(spark, tmp_path):
    s = sinks.Stages(spark, str(tmp_path / "st"), {"a": 1})
    assert not s.done("scan")
    s.finish("scan")
    assert s.done("scan") and sinks.Stages(spark, str(tmp_path / "st"), {"a": 1}).done("scan")
    with pytest.raises(sinks.DatasetError):
        sinks.Stages(spark, str(tmp_path / "st"), {"a": 2})
    assert not sinks.Stages(spark, str(tmp_path / "st"), {"a": 2}, restart=True).done("scan")
    sinks.write_lines(spark.createDataFrame([("a", None)], "t string, u string"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"t": "a"}


def test_ordinals_points_and_parts(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"text": "{name}{i}"}}\n' for i in range(20)))
    rows = readers.with_ordinal(readers.read_json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "text string")).collect()
    assert {(r["text"][0], int(r["text"][1:])) for r in rows} == {(r["text"][0], r["ordinal"]) for r in rows} and len(rows) == 40
    folder = str(tmp_path / "set")
    sinks.write_dataset(spark.range(100), folder, "d", "t", "1", order="id", rows_per_shard=30)
    assert sorted(r["id"] for r in sinks.rows_at(spark, folder, [0, -1, 45]).collect()) == [0, 45, 99]
    with pytest.raises(IndexError):
        sinks.rows_at(spark, folder, [100])
    assert sinks.part_ranges(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)] and sinks.part_ranges(2, 4) == [(0, 1), (1, 2)]
    merged = sinks.merge_parts([spark.range(5, 8), spark.range(3)], "id").collect()
    assert [r["id"] for r in merged] == [5, 6, 7, 0, 1, 2]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted(map(tuple, sinks.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, sinks.insert_missing(a, b, "k").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, sinks.differing_keys(a, b, "k").collect())) == [(1, "missing"), (3, "unexpected")]
    page = sinks.preview(a.union(a), "k", "Rows", "v", rows=1)
    assert page.startswith("# Rows") and "## 1" in page and "- y" in page


def test_prompts_and_evaluation_texts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\n\n two\n")
    (tmp_path / "p.jsonl").write_text('{"prompt": "x"}\n')
    assert sorted(r[0] for r in readers.prompts(spark, str(tmp_path / "p.txt")).collect()) == [" two", "one"]
    assert readers.prompts(spark, str(tmp_path / "p.jsonl")).first()[0] == "x"
    df = spark.createDataFrame([("a b", "", None), ("a bc", "en", "s"), (" ", None, None)], "text string, language string, source string")
    assert [tuple(r) for r in readers.evaluation_texts(df, longest=3).collect()] == [("a b", "unknown", "eval")] or readers.evaluation_texts(df, longest=3).count() == 1


def test_stratified_lines(spark):
    df = spark.range(60).select(F.when(F.col("id") < 40, "a").otherwise("b").alias("_path"), F.when(F.col("id") < 40, F.col("id")).otherwise(F.col("id") - 40).alias("position"))
    got = readers.stratified_lines(df, "position", 4, F.xxhash64("position")).collect()
    assert len(got) == 8 and {(r["_path"], r["position"] * 4 // (40 if r["_path"] == "a" else 20)) for r in got} == {(p, b) for p in "ab" for b in range(4)}
