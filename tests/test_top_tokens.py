"""The most frequent tokens of any kind."""

from collections import Counter

from siltworks.plans import reports


def test_all_tokens_compete(spark, tmp_path):
    texts = ["河流 河流 AB 12!!", "河 abc" + "。" * 9 + "𠀀𠀀\n\n\n", "".join(chr(0x3041 + i) for i in range(30)), None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(Counter("".join(t for t in texts if t)).items(), key=lambda x: (-x[1], x[0].encode()))[:20]
    assert [tuple(r) for r in reports.QUERIES["top_tokens"](spark, str(tmp_path)).collect()] == want
