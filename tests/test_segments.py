import pytest
from pyspark.sql import functions as F

from siltworks.operators import segments


def brute(n, size, overlap):
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append((start, end))
        if end == n:
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(2046, 128), (5, 0), (7, 6)])
def test_windows(spark, size, overlap):
    ns = [0, 1, 31, 32, 2045, 2046, 2047, 2048, 3964, 5000, 8000] if size == 2046 else list(range(0, 40))
    w = segments.sliding_windows(spark.createDataFrame([(n,) for n in ns], "n int"), "n", size, overlap)
    got = {}
    for r in w.collect():
        got.setdefault(r["n"], []).append((r["segment_index"], r["start_token"], r["end_token"], r["new_tokens"]))
    for n in ns:
        rows = sorted(got.get(n, []))
        assert [x[1:3] for x in rows] == brute(n, size, overlap)
        assert sum(x[3] for x in rows) == n


def test_samples_supervise_once(spark):
    df = spark.createDataFrame([(1, list(range(10, 23))), (2, [5])], "id int, ids array<int>")
    rows = segments.segment_samples(df, "ids", 5, 2, 3).orderBy("id", "segment_index").collect()
    trained = [x for r in rows if r["id"] == 1 for x in r["labels"] if x != -100]
    assert trained == [*range(10, 23), 2]
    assert all(len(r["labels"]) == len(r["input_ids"]) for r in rows)
    assert rows[0]["input_ids"][0] == 1 and rows[-1]["input_ids"] == [1, 5, 2]


def test_rank_pack_pad(spark):
    df = spark.range(1, 500).select("id", (F.col("id") % 7 + 1).cast("int").alias("n"))
    assert sorted(r["rank"] for r in segments.global_rank(df, "id").collect()) == list(range(1, 500))
    packed = segments.isolated_pack(segments.batches(df, "id", 50), "batch", "id", "n", 20)
    assert packed.groupBy("batch", "sequence").agg(F.sum("n").alias("s")).where("s > 20").count() == 0
    ids = df.select("id", F.array_repeat(F.col("n"), F.col("n")).alias("ids"))
    out = segments.stream_pack(ids, "id", "ids", 16, 8)
    assert out.agg(F.sum(F.size("input_ids"))).first()[0] == df.agg(F.sum("n")).first()[0]
    assert out.where(F.size("input_ids") > 16).count() == 0


def test_positions_and_truncation(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 1, -1, 1],)], "s array<int>")
    r = df.select(segments.position_ids(F.col("s")).alias("p"), segments.truncate(F.col("s"), 3).alias("l"), segments.truncate(F.col("s"), 3, "right").alias("r"), segments.truncate(F.col("s"), 99).alias("a")).first()
    assert r["p"] == [0, 1, 0, 1, 2, 0, 3] and r["l"] == [1, -1, 1] and r["r"] == [0, 0, 1] and len(r["a"]) == 7
