import pytest
from pyspark.sql import functions as F

from siltworks import config
from siltworks.operators import adapters, tasks

M = "array<struct<role:string,content:string>>"


def test_adapters(spark):
    df = spark.createDataFrame([(0, "Do it", " now ", "Done", 9), (1, "x", None, "y", 3), (2, "", "i", "o", 9)], "ordinal int, instruction string, input string, output string, score int")
    rows = adapters.instruction(df, "alp", "alp_zh", F.lit("zh_general"), 8).collect()
    assert len(rows) == 1 and rows[0]["sample_id"] == "alp-00000000" and rows[0]["messages"][0]["content"] == "Do it\n\nnow"
    j = spark.createDataFrame([(0, '[{"from":"human","value":" hi "},{"from":"gpt","value":"print(1) in python"}]', "sys"), (1, '[{"human":"q","assistant":"a"}]', ""), (2, "[]", "s")], "ordinal int, conversations string, system string")
    got = adapters.conversations(j, "c", "c_en", adapters.by_keywords, system="system").orderBy("sample_id").collect()
    assert [[m["role"] for m in r["messages"]] for r in got] == [["system", "user", "assistant"], ["user", "assistant"]] and [r["category"] for r in got] == ["en_code", "en_general"]
    r = spark.createDataFrame([(0, "p", "t", "s", "Yes"), (1, "p", "", "s", "yes"), (2, "p", "t", "s", "no")], "ordinal int, p string, t string, s string, grade string")
    one = adapters.reasoning(r, "s", "s_en", F.lit("en_math"), "p", "t", "s", F.lower("grade") == "yes").collect()
    assert len(one) == 1 and one[0]["messages"][1]["content"] == "<|think|>t<|/think|>\ns"
    t = spark.createDataFrame([(0, "meta [Human]: hello<eoh>\n[MOSS]: hi there<eoa>\n[Human]: bye<eoh>[MOSS]: ok<eoa>"), (1, "[Human]: only")], "ordinal int, plain_text string")
    (x,) = adapters.tagged_transcript(t, "m", "m_en", F.lit("g")).collect()
    assert [(m["role"], m["content"]) for m in x["messages"]] == [("user", "hello"), ("assistant", "hi there"), ("user", "bye"), ("assistant", "ok")]
    v = spark.createDataFrame([(0, "u1", 2, [("human", "q"), ("gpt", "a")]), (1, None, 0, [("user", "q"), ("assistant", "a")])], f"ordinal int, uuid string, correctness_count int, messages {M}")
    assert [r["sample_id"] for r in adapters.verified(v, "r1", "r1_en", F.lit("en_math")).collect()] == ["u1"]
    with pytest.raises(ValueError):
        adapters.register("verified", adapters.verified)


def test_sft_masks_only_answers(spark):
    df = spark.createDataFrame([("a", [("user", "ab"), ("assistant", "cde")]), ("b", [("user", "x")])], f"id string, messages {M}")
    rows = tasks.sft(df, 1000).collect()
    assert [r["id"] for r in rows] == ["a"]
    r = rows[0]
    assert [x for x in r["labels"] if x != -100] == [*map(ord, "cde"), 2] and len(r["labels"]) == len(r["input_ids"]) == len(r["loss_mask"])
    ok = tasks.sft(df, 20).select(tasks.sft_ok(F.col("input_ids"), F.col("labels"), F.col("loss_mask")), F.size("input_ids")).first()
    assert ok[0] and ok[1] == 20


def test_preference_reward_trajectory(spark):
    p = spark.createDataFrame([("p1", [("user", "q")], "good", "bad", 1), ("p2", [("user", "q")], " ", "bad", 1)], f"pair_id string, prompt_messages {M}, chosen string, rejected string, preference_label int")
    t = tasks.preference(p, 40)
    assert t.count() == 1 and t.first()["chosen_ids"] == [*map(ord, "good"), 2]
    b = tasks.preference_batch(t.withColumn("b", F.lit(0)).withColumn("i", F.lit(0)), "b", "i").first()
    assert b["chosen_labels"][0][-5:] == [*map(ord, "good"), 2] and len(b["chosen_ids"][0]) == len(b["rejected_ids"][0])
    with pytest.raises(Exception, match="used twice"):
        d = t.union(t).withColumn("b", F.lit(0)).withColumn("i", F.monotonically_increasing_id())
        tasks.preference_batch(d, "b", "i").collect()
    r = spark.createDataFrame([([("user", "q")], "a", 0.5, None), ([("user", "q")], "a", float("nan"), 1)], f"prompt_messages {M}, response string, reward_label double, ranking_label int")
    out = tasks.reward_batch(tasks.reward(r, 30).withColumn("b", F.lit(0)).withColumn("i", F.lit(0)), "b", "i").first()
    assert out["reward_label"] == [0.5] and out["ranking_label"] == [-1]
    j = spark.createDataFrame([([("user", "q")], "ab", [0.1, 0.2, 0.3]), ([("user", "q")], "ab", [0.1]), ([("user", "q")], "ab", None)], f"prompt_messages {M}, response string, rewards array<double>")
    assert tasks.trajectory(j, 30).count() == 2


def test_batches(spark):
    df = spark.createDataFrame([(0, 0, "s", [1, 2, 3], [1, 2, 3]), (0, 1, "t", [4], [-100])], "b int, i int, sample_id string, input_ids array<int>, labels array<int>")
    r = tasks.pretraining_batch(df, "b", "i", 0, 4).first()
    assert r["input_ids"] == [[1, 2, 3, 0], [4, 0, 0, 0]] and r["labels"][1] == [-100] * 4 and r["attention_mask"][0] == [1, 1, 1, 0]
    f = tasks.padding_free(df, "b", "i").first()
    assert f["input_ids"] == [1, 2, 3, 4] and f["boundaries"] == [0, 3, 4]


def test_configuration():
    assert config.token_count("4B") == 4 * 10**9 and config.token_count("1.5K") == 1500
    for bad in (True, "x", "0", "1.0001"):
        with pytest.raises(config.ConfigurationError):
            config.token_count(bad)
    assert config.ratios(["a=0.5", " b = 2"]) == {"a": 0.5, "b": 2.0}
    p = config.build(config.Preparation, {"windows": {"size": 10, "overlap": 2}, "target_tokens": "3M"})
    assert p.windows.size == 10 and p.target_tokens == 3_000_000
    for raw in ({"nope": 1}, {"windows": {"size": 1, "overlap": 1}}, {"splits": {"train": 0.5}}):
        with pytest.raises(config.ConfigurationError):
            config.build(config.Preparation, raw)
