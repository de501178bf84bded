"""Exact and near duplicates, components, canonical records, hash splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from siltworks.functions.text import unit_hash
from siltworks.operators.skew import hot_join, hot_keys
from siltworks.runtime import Stage

SHINGLE, HASHES, BANDS, SIMILAR = 13, 128, 16, 0.8
PAIRS_PER_RUN = 20_000  # pairs of one text that are verified in a row
BUCKET_PER_CELL = 10_000
_BASE = np.uint64(1099511628211)  # fixed value: base of the rolling hash


def exact_edges(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(canonical_id, duplicate_id) of every later record with a digest seen before; null texts have none.

    The minimum per digest is found by aggregation and joined back, so a digest held by a third of all rows is no single task."""
    d = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.sha2(text, 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return hot_join(d, first, "digest").where("id <> first").select(F.col("first").alias("canonical_id"), F.col("id").alias("duplicate_id"))


def first_of_each(df: DataFrame, content: Column, order: str) -> DataFrame:
    """One row per content: the one with the smallest ``order``."""
    tagged = df.withColumn("_content", content)
    keep = tagged.groupBy("_content").agg(F.min(order).alias(order))
    return tagged.join(keep, ["_content", order], "left_semi").drop("_content")


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-character substrings of the text in folded case with single spaces."""
    norm = " ".join(text.split()).casefold()
    if not norm:
        return np.zeros(1, np.uint64)
    if len(norm) <= n:
        return np.array([int.from_bytes(hashlib.blake2b(bytes(8) + norm.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], np.uint64)
    cp = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(cp) - n + 1, np.uint64)
    for j in range(n):
        h = h * _BASE + cp[j : j + len(h)]
    return np.unique(h)


# fixed values: digests that the multipliers and offsets of the signature are read from
def _signature_parameters(seed: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    digests = [hashlib.sha256(f"minhash:{seed}:{i}".encode()).digest() for i in range(hashes)]
    return np.array([int.from_bytes(d[:8], "little") | 1 for d in digests], np.uint64), np.array([int.from_bytes(d[8:16], "little") for d in digests], np.uint64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, hashes: int = HASHES, bands: int = BANDS, seed: int = 42) -> DataFrame:
    """(key, digest, shingles, bands): one Arrow pass; ``shingles`` is their number, band keys are 128-bit BLAKE2 digests of the rows of a band."""
    a, b = _signature_parameters(seed, hashes)
    rows = hashes // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for t in batch.column(1):
                x = shingle_hashes(t.as_py(), n)
                low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 2048):
                    # one row per hash, so that the minimum runs along memory
                    low = np.minimum(low, (a[:, None] * x[None, at : at + 2048] + b[:, None]).min(1))
                sizes.append(len(x))
                out.append([hashlib.blake2b(i.to_bytes(4, "little") + low[i * rows : (i + 1) * rows].astype("<u8").tobytes(), digest_size=16).digest() for i in range(bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.binary()))], names=[key, "digest", "shingles", "bands"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text, F.sha2(text, 256).alias("digest")).mapInArrow(run, f"{key} {kind}, digest string, shingles int, bands array<binary>")


@pandas_udf(T.DoubleType())
def jaccard_of(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact Jaccard similarity of the shingle sets of two texts; null where a text is missing."""
    return pd.Series([None if x is None or y is None else jaccard(shingle_hashes(x), shingle_hashes(y)) for x, y in zip(left, right, strict=True)], dtype="object").astype("float64")


def jaccard(p: np.ndarray, q: np.ndarray) -> float:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / (len(p) + len(q) - both)


def verified(pairs: DataFrame, texts: DataFrame, st: Stage, similar: float = SIMILAR, n: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the distinct ``pairs`` (a, b), a kept table, whose texts are similar enough; ``texts`` is (id, text), unique by id.

    Pairs are brought together by ``a``: its text travels once per at most ``PAIRS_PER_RUN`` of its pairs and its shingles are computed once for them. A task reads its
    pairs as a stream in order, so no group is held, and an ``a`` with a third of all pairs is spread over many runs."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_RUN).cast("int").alias("runs")).where("runs > 1")
    placed = hot_join(pairs, load, "a", "left").withColumn("run", F.when(F.col("runs").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("runs"))).cast("int")).select("a", "run", "b")
    heads = placed.select("a", "run").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "run", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    rest = hot_join(placed, texts.withColumnRenamed("id", "b"), "b").select("a", "run", "b", "text")
    rows = heads.unionByName(rest).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            left, right, score = [], [], []
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = shingle_hashes(t.as_py(), n)
                if b is None:
                    head, own = a, x
                    continue
                assert a == head
                if min(len(own), len(x)) >= similar * max(len(own), len(x)) and (s := jaccard(own, x)) >= similar:
                    left.append(a)
                    right.append(b)
                    score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.column(0).type), pa.array(right, batch.column(1).type), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "text").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def near_edges(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, n: int = SHINGLE, seed: int = 42, work: dict | None = None) -> DataFrame:
    """(canonical_id, duplicate_id, similarity): verified links that connect all similar texts which share a band, copies being one text.

    Within a bucket every text is first compared with the smallest id. Only those it doesn't match are compared with the others of a size that can be similar:
    two texts that both match the smallest are connected through it, so no connection is lost and a bucket of n near-copies costs n comparisons, not n squared.
    Texts are read for the members of shared buckets only, and keys of large buckets are salted. ``work``, where given, is filled with the number of distinct texts,
    of those that share a bucket, of the pairs compared and of the largest bucket."""
    st = Stage(df.sparkSession, "near")
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    # hashing is far dearer than reading, so the texts are spread over all tasks of a shuffle where the input has fewer partitions
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = st.keep(fingerprints(docs if docs.rdd.getNumPartitions() >= parts else docs.repartition(parts), "id", "text", n, seed=seed))
    reps = prints.groupBy("digest").agg(F.min(F.struct("id", "shingles", "bands")).alias("r")).select("r.*")
    members = st.keep(reps.select("id", "shingles", F.posexplode("bands").alias("band", "bucket")).select("id", "shingles", F.xxhash64("band", "bucket").alias("k")))
    first = members.groupBy("k").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    led = st.keep(hot_join(members, first, "k"))
    texts = st.keep(docs.join(led.select("id").distinct(), "id"))
    leading = st.keep(led.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    to_first = st.keep(verified(leading, texts, st, similar, n))
    matched = to_first.select(F.col("a").alias("low"), F.col("b").alias("id"))
    others = led.where("id <> low")
    rest = st.keep(others.join(matched, ["low", "id"], "left_anti").select("k", "n", F.col("id").alias("x"), F.col("shingles").alias("sx")))
    # the members of a large bucket are dealt to cells, to each of which its unmatched ones go
    cells = F.ceil(F.col("n") / BUCKET_PER_CELL).cast("int")
    wide = rest.withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1))).select("k", "cell", "x", "sx")
    dealt = others.join(rest.select("k").distinct(), "k", "left_semi").select("k", F.pmod(F.xxhash64("id"), cells).cast("int").alias("cell"), F.col("id").alias("y"), F.col("shingles").alias("sy"))
    fits = (F.col("x") != F.col("y")) & (F.least("sx", "sy") >= similar * F.greatest("sx", "sy"))
    more = wide.join(dealt, ["k", "cell"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = st.keep(more)
    if work is not None:
        work |= {"texts": members.select("id").distinct().count(), "candidates": texts.count(), "compared": leading.count() + more.count(), "largest_bucket": led.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]}
    out = to_first.unionByName(verified(more, texts, st, similar, n)).distinct()
    return out.select(F.col("a").alias("canonical_id"), F.col("b").alias("duplicate_id"), "similarity")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(key, group_id) of every record: smallest id of all texts linked directly or through others. Copies share the group of their text; null texts are alone."""
    st = Stage(df.sparkSession, "groups")
    d = st.keep(df.select(F.col(key).alias("id"), F.coalesce(F.sha2(text, 256), F.concat(F.lit("id:"), F.col(key).cast("string"))).alias("digest")))
    e = near_edges(df, key, text, similar)
    groups = components(e.select(F.col("canonical_id").alias("a"), F.col("duplicate_id").alias("b"))).withColumnRenamed("id", "rep")
    reps = d.groupBy("digest").agg(F.min("id").alias("rep")).join(groups, "rep", "left")
    return hot_join(d, reps, "digest").select(F.col("id").alias(key), F.coalesce("component", "rep").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of (a, b): the smallest id reachable. Labels flow along edges and jump to their label's label until nothing moves."""
    st = Stage(edges.sparkSession, "cc")
    both = st.keep(edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("k")), F.struct(F.col("b").alias("v"), F.col("a").alias("k")))).alias("e")).select("e.*").distinct())
    hot = hot_keys(both, "k")
    lab = st.keep(both.groupBy("v").agg(F.least("v", F.min("k")).alias("c")))
    while True:
        seen = hot_join(both, lab.select(F.col("v").alias("k"), "c"), "k", hot=hot, merge=True).groupBy("v").agg(F.min("c").alias("near"))
        met = st.keep(lab.join(seen.hint("merge"), "v").select("v", "c", F.least("c", "near").alias("k")))
        up = met.groupBy(F.col("c").alias("v")).agg(F.min("k").alias("pulled"))
        met2 = st.keep(met.join(up.hint("merge"), "v", "left").select("v", "c", F.least("k", F.coalesce("pulled", "k")).alias("k")))
        jump = hot_join(met2, met2.select(F.col("v").alias("k"), F.col("k").alias("top")), "k", "left", merge=True)
        nxt = st.keep(jump.select("v", F.least("k", F.coalesce("top", "k")).alias("c"), (F.least("k", F.coalesce("top", "k")) < F.col("c")).alias("moved")))
        st.drop(met, met2, lab)
        lab = nxt
        if lab.where("moved").limit(1).count() == 0:
            st.drop(both)
            return lab.select(F.col("v").alias("id"), F.col("c").alias("component"))


def canonical_members(docs: DataFrame, comps: DataFrame, key: str = "doc_id", priority: str = "source_priority") -> DataFrame:
    """Every record of a component with the canonical one: smallest (priority, id), null priorities last."""
    d = docs.select(F.col(key).alias("id"), F.col(priority).alias("p")).join(comps, "id")
    best = d.groupBy("component").agg(F.min(F.struct(F.coalesce("p", F.lit(2**31 - 1)).alias("p"), "id")).alias("best"))
    return hot_join(d, best, "component").select(F.col("id").alias(key), "component", F.col("best.id").alias("canonical_id"))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(key, canonical_id) of every record: exact and near duplicates directly or through others, the canonical one having the smallest (priority, id)."""
    groups = near_groups(docs, key, text, similar).select(F.col(key).alias("id"), F.col("group_id").alias("component"))
    return canonical_members(docs, groups, key).select(key, "canonical_id")


def assign_clusters(docs: DataFrame, members: DataFrame, key: str = "doc_id", parent: str = "parent_document_id", seed: int = 42) -> DataFrame:
    """(key, canonical_id, cluster, split): all members of a group take the cluster of the canonical record's parent (its own id where it has none) and so one split."""
    of = docs.select(F.col(key).alias("canonical_id"), cluster_id(F.coalesce(F.col(parent), F.col(key).cast("string"))).alias("cluster"))
    return hot_join(members, of, "canonical_id").select(key, "canonical_id", "cluster").withColumn("split", hash_split(F.col("cluster"), seed=seed))


def cluster_id(parent: Column) -> Column:
    return F.concat(F.lit("cluster-"), F.substring(F.sha2(parent, 256), 1, 24))


def hash_split(cluster: Column, validation: float = 0.05, diagnostic: float = 0.05, seed: int = 42) -> Column:
    u = unit_hash(F.concat(F.lit(f"{seed}:"), cluster))
    return F.when(u < validation, "validation").when(u < validation + diagnostic, "diagnostic").otherwise("train")


def leak_audit(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found in more than one split, with the splits in order; null groups and splits are left out."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count(F.lit(1)).alias("records")).where(F.contains("splits", F.lit(",")))


def record_id(source: Column, path: Column, ordinal: Column, record: Column) -> Column:
    """Stable id of a source record: SHA-256 over source, path, ordinal and record id (the ordinal where it is missing), NUL between."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(source, nul, path, nul, ordinal.cast("string"), nul, F.coalesce(record, ordinal.cast("string"))), 256)


def exact_near_accounting(docs: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text", others: DataFrame | None = None) -> DataFrame:
    """Duplicates per source, exact where the digest equals that of the canonical record, else near.

    ``others`` are records outside of ``docs`` that may be canonical; they belong to no source, so they aren't counted."""
    d = docs.select(F.col(key).alias("id"), "source", F.sha2(text, 256).alias("digest"))
    m = members.where(F.col(key) != F.col("canonical_id")).select(F.col(key).alias("id"), F.col("canonical_id").alias("c"))
    c = d.select(F.col("id").alias("c"), F.col("digest").alias("c_digest"))
    if others is not None:
        c = c.unionByName(others.select(F.col(key).alias("c"), F.sha2(text, 256).alias("c_digest")))
    return hot_join(d.join(m, "id"), c, "c").groupBy("source").agg(
        F.sum(F.when(F.col("digest") == F.col("c_digest"), 1).otherwise(0)).alias("exact"), F.sum(F.when(F.col("digest") == F.col("c_digest"), 0).otherwise(1)).alias("near")
    )
