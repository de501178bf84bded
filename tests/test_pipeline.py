"""Preparation end to end, the loader behind it, configurations and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from siltworks import __main__ as cli
from siltworks import config as cfg
from siltworks.operators import schema, selection, tasks
from siltworks.plans import loader, prepare
from siltworks.sources import sinks
from siltworks.streaming import experience


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("prep") / "out")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    settings = cfg.Preparation(windows=cfg.Windows(256, 32, 16))
    return folder, docs, settings, prepare.prepare(spark, docs, folder, "corpus", "1", settings, rows_per_shard=100)


def test_prepared_datasets(spark, prepared):
    folder, docs, settings, out = prepared
    assert out["documents"]["accepted"] + sum(out["documents"]["refused"].values()) == docs.count()
    assert out["documents"]["canonical"] < out["documents"]["accepted"]
    train = sinks.read_dataset(spark, f"{folder}/train")
    assert train.count() == out["splits"]["train"]["samples"]
    assert schema.problems(train, "pretraining").count() == 0
    stored = schema.from_storage(train, "doc_id long, cluster string, input_tokens int")
    assert stored.agg(F.sum("input_tokens")).first()[0] == out["splits"]["train"]["input_tokens"] == train.agg(F.sum(F.size("input_ids"))).first()[0]
    again = prepare.prepare(spark, docs.limit(0), folder, "corpus", "1", settings, rows_per_shard=100)  # nothing is read again
    assert again == out
    with pytest.raises(sinks.DatasetError):
        prepare.prepare(spark, docs, folder, "corpus", "2", settings, rows_per_shard=100)


def _data(folder, **packing):
    return cfg.Data.from_mapping({"task": "pretraining", "dataset_id": "corpus", "storage": {"train_path": f"{folder}/train", "verify_checksums": True}, "packing": packing, "batching": {"micro_batch_size": 4}})


def test_batches_of_a_stream(spark, prepared):
    folder, _, _, out = prepared
    whole = loader.batches(spark, _data(folder, max_seq_length=64, drop_last_remainder=False))
    n = whole.select(F.explode("labels").alias("l"), "input_ids").agg(F.sum(F.size("l"))).first()[0]
    assert n >= out["splits"]["train"]["input_tokens"]
    cut = loader.batches(spark, _data(folder, max_seq_length=64))
    assert cut.select(F.explode("input_ids").alias("x")).where(F.size("x") != 64).count() == 0
    ranks = [loader.ordered(sinks.read_dataset(spark, f"{folder}/train"), _data(folder), 1, r, 3) for r in range(3)]
    sizes = {r.count() for r in ranks}
    assert len(sizes) == 1 and ranks[0].union(ranks[1]).union(ranks[2]).select("global_index").distinct().count() == out["splits"]["train"]["samples"]


def test_unpacked_batches_and_budget(spark, prepared):
    folder, _, _, out = prepared
    b = loader.batches(spark, _data(folder, enabled=False))
    assert b.select(F.explode("sample_id")).count() <= out["splits"]["train"]["samples"] and b.where(F.exists("input_ids", lambda x: F.size(x) != F.size(F.element_at("input_ids", 1)))).count() == 0
    steps = loader.budget(spark, _data(folder), 2, 2)
    assert steps["steps"] == out["splits"]["train"]["samples"] // 16
    with pytest.raises(cfg.ConfigurationError):
        loader.batches(spark, cfg.Data.from_mapping({"task": "sft", "dataset_id": "corpus", "storage": {"train_path": f"{folder}/train"}, "packing": {"enabled": False}}))


def test_command_line(spark, prepared, capsys, tmp_path):
    folder = prepared[0]
    cli.main(["diagnose", folder])
    assert json.loads(capsys.readouterr().out)["train"]["samples"] == prepared[3]["splits"]["train"]["samples"]
    path = tmp_path / "data.json"
    path.write_text(json.dumps({"task": "cpt", "dataset_id": "corpus", "storage": {"train_path": f"{folder}/train"}}))
    cli.main(["budget", str(path), "--target-tokens", "1_000"])
    assert json.loads(capsys.readouterr().out)["target_tokens"] == 1000


def test_configurations():
    for bad in ({"task": "sft"}, {"task": "sft", "dataset_id": "d", "storage": {"train_path": "x", "more": 1}}, {"task": "sft", "dataset_id": "d", "storage": {"train_path": "x", "format": "csv"}}):
        with pytest.raises(cfg.ConfigurationError):
            cfg.Data.from_mapping(bad)
    with pytest.raises(cfg.ConfigurationError):
        cfg.Data.from_mapping({"task": "dpo", "dataset_id": "d", "storage": {"train_path": "x"}}).check()
    raw = {"output": "out", "max_chars": 10, "profiles": {"small": {"max_chars": 5}, "own": {"output": "else"}}}
    assert cfg.Conversations.from_mapping(raw, "small") == cfg.Conversations("out/small", max_chars=5) and cfg.Conversations.from_mapping(raw, "own").output == "else" and cfg.Conversations.from_mapping(raw).max_chars == 10
    with pytest.raises(cfg.ConfigurationError):
        cfg.Conversations.from_mapping(raw, "none")
    assert cfg.SourceSampling(1.0, ({"name": " a ", "weight_gb": 2},)).weights == {"a": 2.0}
    with pytest.raises(cfg.ConfigurationError):
        cfg.SourceSampling(1.0, ({"name": "a", "weight_gb": 0},))


def test_mixture_and_steps():
    assert selection.mixture({"a": 1, " b": 3}) == {"a": 0.25, "b": 0.75}
    assert selection.mixture(manifest={"sources": [{"name": "a", "target_bytes": 10, "weight_gb": 9}, {"name": "b", "weight_gb": 30}]}) == {"a": 0.25, "b": 0.75}
    for bad in ({}, {"a": 1, "a ": 2}, {"a": 0}, {" ": 1}):
        with pytest.raises(ValueError):
            selection.mixture(bad)
    assert selection.step_budget(100, 5000, 4, 2, 2)["steps"] == 6 and selection.step_budget(100, 5000, 4, 2, 2, target_tokens=1600)["steps"] == 3
    with pytest.raises(ValueError):
        selection.step_budget(3, 10, 4, 1, 1)


def test_registry():
    assert len(tasks.TASKS) == 12 and tasks.task("kto").sample_type == "preference"
    with pytest.raises(ValueError):
        tasks.register("sft", tasks.task("sft"))
    with pytest.raises(ValueError):
        tasks.task("none")


def test_trajectory_batch(spark):
    df = spark.createDataFrame([("b", 0, [1, 2], [3], [0.5], "x"), ("b", 1, [4], [5, 6], None, "y")], "batch string, place int, prompt_ids array<int>, response_ids array<int>, rewards array<double>, sample_id string")
    r = tasks.trajectory_batch(df, "batch", "place").first()
    assert r["input_ids"] == [[1, 2, 3], [4, 5, 6]] and r["response_mask"] == [[0, 0, 1], [0, 1, 1]] and r["rewards"] == [[0.5, 0.0], [0.0, 0.0]]


def test_invariants_and_identifiers(spark):
    df = spark.createDataFrame([("a", [1, 2], [-100, 2], [1, 1]), (" ", [], None, None), ("c", [1, -1], [1], [2, 0])], "sample_id string, input_ids array<int>, labels array<int>, attention_mask array<int>")
    got = {(r[0], r[1]) for r in schema.problems(df, "pretraining").collect()}
    assert got == {(" ", "sample_id is blank"), (" ", "input_ids are empty"), ("c", "input_ids is out of range"), ("c", "labels aren't aligned"), ("c", "attention_mask isn't 0 or 1")}
    ok, broken = schema.validated(df, "pretraining")
    assert [r["sample_id"] for r in ok.collect()] == ["a"] and {r["problem"] for r in broken.collect()} == {"sample_id is blank", "input_ids is out of range"}
    with pytest.raises(Exception, match="invalid sample"):
        schema.validated(df, "pretraining", "error")[0].collect()
    named = schema.with_identifiers(df.withColumn("n", F.lit(7)), "set", "src", "n").collect()
    assert [r["sample_id"] for r in named] == ["a", "set-00000007", "c"] and {r["dataset_id"] for r in named} == {"set"}
    assert [f.name for f in schema.stored_schema("reward").fields][-1] == "metadata"


def test_cursor_of_another_table(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "position")
    state = experience.advance(experience.start("hash-a"), 13, 10)
    assert experience.resume(df, "position", 10, state, "hash-a").count() == 7
    with pytest.raises(ValueError):
        experience.resume(df, "position", 10, state, "hash-b")
