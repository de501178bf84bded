from pyspark.sql import functions as F

from siltworks.llm import mixing


def _tables(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i % 50), "big" if i % 3 else "small") for i in range(3000)] + [(9001, None, "big"), (9002, "", "small"), (9003, "y" * 500, None)], "doc_id long, text string, source string").withColumn("bytes", F.lit("clash")).withColumn("name", F.lit("clash"))
    configs = spark.createDataFrame([("a", 3e-5, 1, 0.0, 0, 100, 2), ("b", 2e-4, 2, 0.0, 20, 40, None), ("c", 1e-6, None, None, None, 10, 1)], "config_id string, target_total_gb double, seed long, validation_fraction double, min_chars long, max_chars long, max_repeats int")
    sources = spark.createDataFrame(
        [("a", " BIG", 1.0), ("a", "big", 1.0), ("a", "small", 1.0), ("a", "none", 0.0), ("a", "null", None), ("a", None, 2.0), ("b", "big", 1.0), ("b", "small", 3.0), ("b", "absent", 1.0), ("zz", "big", 1.0), ("c", "big", 1.0)],
        "config_id string, name string, weight_gb double",
    )
    return docs, configs, sources


def test_rates_copies_and_shares(spark):
    t = _tables(spark)
    found = {tuple(r) for r in mixing.unreachable_sources(*t).collect()}
    have = {s: sum(10 + i % 50 for i in range(3000) if (("big" if i % 3 else "small") == s) and 20 <= 10 + i % 50 <= 40) for s in ("big", "small")}
    want = {("b", s) for s, w in (("big", 1), ("small", 3)) if have[s] < 2e-4 * 1e9 * w / 5} | {("b", "absent"), ("c", "big")}
    assert found == want
    m = mixing.mix(*t)
    assert m.where("copies > 2").count() == 0 and m.where("doc_id > 9000").where("bytes is null").count() == 0
    got = {r["name"]: r for r in mixing.mix_shares(*t).where("config_id = 'a'").collect()}
    assert set(got) == {"big", "small"} and abs(got["big"]["actual_share"] - 0.5) < 0.03
    assert mixing.mix_shares(t[0].limit(0), t[1], t[2]).agg(F.sum("mixed_bytes")).first()[0] == 0
    assert mixing.source_rates(t[0], t[1].limit(0), t[2]).count() == 0


def test_copies_are_repeatable(spark):
    t = _tables(spark)
    a, b = ({tuple(r) for r in mixing.mix(t[0].repartition(n), *t[1:]).collect()} for n in (1, 5))
    assert a == b
