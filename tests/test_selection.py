from pyspark.sql import functions as F

from siltworks.operators import conversations as cv
from siltworks.operators import profiles, sampling, selection


def test_largest_remainder_and_rebalance(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, w double")
    q = {r["name"]: r["quota"] for r in selection.largest_remainder(w, "name", "w", 100).collect()}
    assert q == {"a": 34, "b": 33, "c": 33}
    quotas = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200)], "name string, quota long")
    have = spark.createDataFrame([("a", 495), ("b", 400), ("c", 300)], "name string, available long")
    e = {r["name"]: r["effective"] for r in selection.rebalance(quotas, have, "name", 1000).collect()}
    assert e == {"a": 495, "b": 303, "c": 202} and sum(e.values()) == 1000
    short = spark.createDataFrame([("a", 400), ("b", 400), ("c", 300)], "name string, available long")
    assert {r["name"]: r["effective"] for r in selection.rebalance(quotas, short, "name", 1000).collect()} == {"a": 500, "b": 300, "c": 200}


def test_greedy_and_first_fit_against_plain_loops(spark):
    rows = [(i, "xy"[i % 2], "pqr"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    c1, c2 = {"x": 5, "y": 9}, {"p": 4, "q": 3, "r": 8}
    l1, l2, want = dict(c1), dict(c2), []
    for k, a, b in rows:
        if l1[a] and l2[b]:
            l1[a] -= 1
            l2[b] -= 1
            want.append(k)
    assert sorted(r["k"] for r in selection.greedy_two_caps(df, "k", "a", "b", c1, c2).collect()) == want
    sizes = spark.createDataFrame([(1, 50), (2, 70), (3, 40), (4, 10), (5, 1)], "k int, n int")
    assert sorted(r["k"] for r in selection.first_fit(sizes, "k", "n", 100).collect()) == [1, 3, 4]


def test_budget_overshoots_by_less_than_one_row(spark):
    df = spark.range(1000).select("id", F.lit("s").alias("g"), (F.col("id") % 9 + 1).alias("n"))
    q = spark.createDataFrame([("s", 1234)], "g string, quota long")
    got = selection.within_budget(df, "g", selection.order_key(1, F.col("id")), "n", q)
    assert 1234 <= got.agg(F.sum("n")).first()[0] < 1234 + 9


def test_samplers(spark):
    df = spark.range(1, 103).withColumnRenamed("id", "doc_id")
    order = sampling.epoch_order(df, 1, 0)
    shares = [sampling.rank_share(order, "position", r, 4).count() for r in range(4)]
    assert sum(shares) == 102 and max(shares) - min(shares) == 1
    assert all(sampling.rank_share(order, "position", r, 4, pad=True).count() == 26 for r in range(4))
    assert all(sampling.rank_share(order, "position", r, 4, drop_last=True).count() == 25 for r in range(4))
    assert sampling.wrap_to(order, "position", 250).count() == 250
    b = sampling.buffered_shuffle(order, "position", 10, 3)
    assert sorted(r["shuffled"] for r in b.collect()) == list(range(1, 103)) and b.where("abs(position - shuffled) >= 10").count() == 0
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("z", 0.0), ("n", None)], "s string, w double")
    n = {r["s"]: r["count"] for r in sampling.weighted_with_replacement(w, "w", 4000, 5, "s").groupBy("s").count().collect()}
    assert set(n) == {"a", "b"} and 2800 <= n["a"] <= 3200


def test_conversations(spark):
    rows = [
        ("ok", [("system", "s"), ("Human", " hi "), ("gpt", "<think>t</think>  yes")]),
        ("bad", [("user", "q"), ("assistant", "<think>open")]),
        ("hollow", [("user", "q"), ("assistant", "  ")]),
        ("alone", [("user", "q")]),
    ]
    df = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>")
    got = {r["id"]: r for r in cv.content_policy(df, strip_reasoning=True).collect()}
    assert got["ok"]["reject"] is None and got["ok"]["policy_messages"][1]["content"] == "yes" and got["ok"]["dropped_system"] == 1 and got["ok"]["reasoning"]
    assert [got[k]["reject"] for k in ("bad", "hollow", "alone")] == ["malformed_reasoning", "empty_assistant", "missing_role"]
    r = df.where("id = 'ok'").select(cv.render(F.col("messages")).alias("t"), cv.assistant_spans(cv.normalise_messages(F.col("messages"))).alias("s"), cv.render(cv.normalise_messages(F.col("messages"))).alias("u")).first()
    (span,) = r["s"]
    assert r["u"][span["from"] : span["to"]] == "<think>t</think>  yes<|im_end|>"
    h = spark.createDataFrame([([5, 5, 5],), ([100],), ([],)], "s array<int>").select(cv.fit_history(F.col("s"), 11)).collect()
    assert [x[0] for x in h] == [2, 1, 0]


def test_profiles(spark):
    df = spark.createDataFrame([("g", x) for x in range(1, 12)], "g string, x int")
    r = profiles.floor_index(df, "g", "x", [0.5, 0.95]).first()
    assert (r["p50"], r["p95"], r["largest"]) == (6, 10, 11)
    assert df.agg(profiles.nearest_rank("x", 0.5)).first()[0] == 6
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "t string, n long")
    e = profiles.entropy_and_gini(c, "n").first()
    assert (e["entropy_bits"], e["items"], e["total"]) == (1.5, 3, 4) and abs(e["gini"] - 1 / 6) < 1e-6
    s = spark.createDataFrame([([3.0, 2.0, 2.5, 2.4, 2.6],), ([1.0],)], "v array<double>").select(profiles.early_stop(F.col("v"), 3), profiles.ema(F.col("v"), 0.5)).collect()
    assert s[0][0] == 5 and s[1][0] is None and s[1][1] == 1.0


def test_first_fit_by_running_sums_equals_the_fold(spark, monkeypatch):
    import random

    from siltworks.operators import segments, selection

    rnd = random.Random(6)
    rows = [(i, rnd.choice([1, 3, 8, 20, 45])) for i in range(300)]
    room, want = 400, []
    for k, n in rows:
        if n <= room:
            room -= n
            want.append(k)
    df = spark.createDataFrame([*rows, (999, None)], "k long, n long")
    assert sorted(r["k"] for r in selection.first_fit(df, "k", "n", 400).collect()) == want
    monkeypatch.setattr(selection, "FOLD_ROWS", 20)
    monkeypatch.setattr(segments, "ROWS_PER_RANGE", 50)
    assert sorted(r["k"] for r in selection.first_fit(df, "k", "n", 400).collect()) == want
    assert selection.first_fit(df.limit(0), "k", "n", 400).count() == 0


def test_budgets_ranks_and_windows_in_many_ranges(spark, monkeypatch):
    import statistics

    from pyspark.sql import functions as F

    from siltworks.operators import profiles, segments, selection

    monkeypatch.setattr(segments, "ROWS_PER_RANGE", 30)
    monkeypatch.setattr(selection, "ROWS_PER_SLICE", 25)
    df = spark.range(400).select(F.col("id"), F.pmod("id", F.lit(3)).alias("g"), (F.pmod(F.col("id") * 7, F.lit(11)) + 1).alias("n"), (F.pmod(F.col("id") * 131, F.lit(400)) / 400).alias("key"))
    ranks = {r["id"]: r["rank"] for r in segments.global_rank(df, "id").collect()}
    assert ranks == {i: i + 1 for i in range(400)}
    quota = spark.createDataFrame([(0, 100), (1, 0), (2, 10_000)], "g long, quota long")
    got = {r["id"] for r in selection.within_budget(df, "g", F.col("key"), "n", quota).collect()}
    want, rows = set(), sorted(df.collect(), key=lambda r: r["key"])
    for g, q in ((0, 100), (1, 0), (2, 10_000)):
        used = 0
        for r in rows:
            if r["g"] == g and used < q:
                want.add(r["id"])
                used += r["n"]
    assert got == want
    seen = {r["id"]: r for r in profiles.recent_window(df, "id", "n", 10, block=37).collect()}
    n = [(i * 7) % 11 + 1 for i in range(400)]
    assert len(seen) == 400
    for i in (0, 5, 36, 37, 38, 74, 399):
        part = n[max(0, i - 9) : i + 1]
        assert abs(seen[i]["window_mean"] - statistics.fmean(part)) < 1e-9 and abs(seen[i]["window_variance"] - statistics.pvariance(part)) < 1e-9 and seen[i]["window_change"] == part[-1] - part[0]


def test_weighted_draws_follow_the_weights(spark, monkeypatch):
    from siltworks.operators import sampling, segments

    monkeypatch.setattr(segments, "ROWS_PER_RANGE", 2)
    w = spark.createDataFrame([("a", 1.0), ("b", 8.0), ("c", 1.0), ("d", 0.0), ("e", None), ("f", -1.0)], "k string, w double")
    got = sampling.weighted_with_replacement(w, "w", 4000, 3, "k")
    n = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert sum(n.values()) == 4000 == got.select("draw").distinct().count() and set(n) == {"a", "b", "c"} and abs(n["b"] - 3200) < 150
    assert sampling.weighted_with_replacement(w.where("w < 0"), "w", 10, 3, "k").count() == 0
