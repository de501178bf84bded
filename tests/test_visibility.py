"""Audits of batches with long documents against the pairwise definition."""

from pyspark.sql import functions as F

from siltworks.operators import segments
from siltworks.plans import reports



def documents(spark, tmp_path, texts):
    rows = [(i, t, "a_en", "en", None, 1) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, parent_document_id string, source_priority int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_all_lengths_are_audited(spark, tmp_path):
    sizes = {1: 3, 2: 41, 3: 2500, 4: 40, 5: 900}
    d = documents(spark, tmp_path, {i: "x" * n for i, n in sizes.items()})
    got = sorted(map(tuple, reports.QUERIES["visibility_audit"](spark, d).collect()))
    assert got == [(0, 2584, sum(n * (n + 1) // 2 for n in (3, 41, 2500, 40))), (1, 900, 405450)]


def test_pairs_of_a_run_are_those_of_the_array_operator(spark):
    df = spark.createDataFrame([([0] * 5 + [1] * 7,)], "s array<int>")
    seen = segments.visible(F.col("s"), F.transform("s", lambda _: F.lit(1)))
    want = df.select(F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x)).first()[0]
    assert spark.createDataFrame([(5,), (7,)], "n int").agg(F.sum(segments.visible_pairs(F.col("n")))).first()[0] == want == 43
