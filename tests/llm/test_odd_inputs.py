"""Every operator over columns with clashing names, over rows in which all but the id is null, and over empty tables."""

import pytest
from pyspark.sql import functions as F

from siltworks.llm import bpe_corpus, components, mixing, overlap, oversized, packing, pair_defects, splits, token_budget, toxicity


@pytest.mark.parametrize("kind", ["clash", "null", "empty"])
def test_all_operators_end(spark, data, kind):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(12)
    if kind == "clash":
        for name in ("component", "cls", "bits", "n_tokens", "records", "known", "in_train", "norm", "copies", "toxicity", "word", "piece", "v"):
            docs = docs.withColumn(name, F.lit("clash"))
    elif kind == "null":
        docs = docs.select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields if f.name != "doc_id"])
    else:
        docs = docs.limit(0)
    n = 0 if kind == "empty" else 12
    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    assert splits.document_splits(docs).count() == n and splits.found(docs).count() <= n and splits.torn_report(docs).count() == 1
    assert token_budget.token_report(docs).count() == n and token_budget.found(docs).count() <= n
    assert oversized.split_oversized(docs).count() >= 0
    assert overlap.cross_split_pairs(docs).count() >= 0 and overlap.overlap_report(docs).count() >= 0
    assert bpe_corpus.encode_corpus(docs).count() == n
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == n
    assert toxicity.score(docs, toxicity.fit([], [])).count() == n
    assert mixing.mix(docs, read("sampling_configs"), read("sampling_sources")).count() >= 0
    assert components.found(read("duplicate_edges").limit(50), docs).count() >= 0
    talks = read("sft_results").limit(n)
    if kind == "null":
        talks = talks.withColumn("messages", F.lit(None).cast(talks.schema["messages"].dataType))
    assert pair_defects.find_defects(talks.withColumn("turn", F.lit("clash"))).count() >= 0
