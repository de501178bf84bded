"""Problem 1: splits that keep related records together.

Records are linked by shared key values (cluster, source record and the like). The graph has one node per key value, not per record: a record that
carries several values links them, and a value that co-occurs with one other value only as often as you like is one edge. Components come
from breadth-first search with many seeds at once over adjacency lists hash-partitioned by node: each round joins the frontier with its
lists, first labels win, and where two searches meet, their seeds become an edge of a much smaller graph, which is solved the same way. All searches of a phase
start together, so a neighbour of the frontier was reached in the last two rounds or is new: a round reads the frontiers of those two rounds and
writes the new one, never all labels. Splits then follow the hash order of the components: three arcs of the circle of hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import fold_name, not_blank, strip
from siltworks.operators.skew import hot_join, hot_keys
from siltworks.runtime import Stage

PROPORTIONS = {"train": 0.90, "validation": 0.05, "diagnostic": 0.05}
SEED_ONE_IN = 8
BUCKET_BITS = 16  # resolution of the cut points: 65,536 hash ranges, each a few records in a hundred thousand

# fixed values: full names and abbreviations of the recorded splits
SPLIT_NAMES = {"train": ["train", "training", "trn", "tr"], "validation": ["validation", "valid", "val", "dev"], "diagnostic": ["diagnostic", "diagnostics", "diag"]}


def canonical_split(c: Column) -> Column:
    """train, validation or diagnostic for their names in any letter case, padded or not; null for anything else."""
    s = F.lower(strip(c))
    out = F.when(s.isin(SPLIT_NAMES["train"]), "train")
    for name in ("validation", "diagnostic"):
        out = out.when(s.isin(SPLIT_NAMES[name]), name)
    return out


def _seed(node: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(SEED_ONE_IN)) == 0


def _search(st: Stage, lists: DataFrame, hot: list, seeds: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Breadth-first search from all ``seeds`` (node, label) at once: (tables of labels, tables of meetings of two labels).

    Rounds are distances to the nearest seed. Neighbours differ by at most one in that distance, so the owner of a reached node is in the frontier, in the one
    before it, or new."""
    before, front = None, seeds
    visited, meetings = [seeds], []
    while front.limit(1).count():
        reached = st.keep(hot_join(lists, front, "node", hot=hot, merge=True).select(F.col("to").alias("node"), F.col("label").alias("from_label")).distinct())
        known = front if before is None else front.union(before)
        claims = reached.groupBy("node").agg(F.min("from_label").alias("label")).join(known.withColumnRenamed("label", "old").hint("merge"), "node", "left")
        claims = st.keep(claims)
        meet = reached.join(claims.select("node", F.coalesce("old", "label").alias("owner")).hint("merge"), "node").where("from_label <> owner")
        meetings.append(st.keep(meet.select(F.least("owner", "from_label").alias("a"), F.greatest("owner", "from_label").alias("b")).distinct()))
        before, front = front, st.keep(claims.where("old is null").select("node", "label"))
        visited.append(front)
        st.drop(reached, claims)
    return visited, meetings


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def frontier_components(edges: DataFrame, st: Stage | None = None, level: int = 0) -> DataFrame:
    """(node, label) of every node of the string pairs (a, b); equal labels mean one component, the label is one of its nodes.

    Repeated, reversed and self edges are allowed; null ends are ignored; an empty table gives an empty result. One node in eight starts a search; in a
    component without such a node, every node that is smaller in hash order than all its neighbours does. Tables of finished rounds are dropped."""
    st = st or Stage(edges.sparkSession, "frontier")
    e = edges.where("a <> b").select("a", "b")
    lists = st.keep(e.union(e.select("b", "a")).toDF("node", "to").distinct().repartition("node"))
    hot = hot_keys(lists, "node")
    visited, meetings = _search(st, lists, hot, st.keep(lists.select("node").distinct().where(_seed(F.col("node"), level)).select("node", F.col("node").alias("label"))))
    rest = hot_join(lists, _union(visited), "node", "left_anti", hot, merge=True)
    near = rest.groupBy("node").agg(F.min(F.struct(F.xxhash64("to").alias("h"), F.col("to").alias("n"))).alias("m"))
    seeds = st.keep(near.where(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")) < F.col("m")).select("node", F.col("node").alias("label")))
    more, met = _search(st, lists, hot, seeds)
    labels = st.keep(_union(visited + more))
    small = st.keep(_union(meetings + met).distinct()) if meetings or met else None
    st.drop(lists, *visited, *more, *meetings, *met)
    if small is None or small.limit(1).count() == 0:
        return labels
    merged = frontier_components(small, st, level + 1).select(F.col("node").alias("label"), F.col("label").alias("top"))
    out = st.keep(hot_join(labels, merged, "label", "left", merge=True).select("node", F.coalesce("top", "label").alias("label")))
    st.drop(labels, small)
    return out


def _key_values(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    tagged = {f"_key{i}": F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c)) for i, (name, c) in enumerate(keys.items())}
    return df.withColumns(tagged)


def group_records(df: DataFrame, keys: dict[str, Column], record: Column) -> DataFrame:
    """``df`` with ``component``: equal for all records that share a value of any of ``keys``, directly or through others.

    ``keys`` maps a name to an expression that is null where the record has no such key. A record without any key is a component of its own,
    named by ``record``. Values that meet only one other value can't join two components by themselves and are contracted onto it before
    the search, so with one key there is nothing to search."""
    names = [f"_key{i}" for i in range(len(keys))]
    taken = set(names) & set(df.columns)
    if taken or "component" in df.columns:
        raise ValueError(f"columns in use: {sorted(taken | {'component'})}")
    tagged = _key_values(df, keys)
    anchor = F.coalesce(*names, F.concat(F.lit("record="), record.cast("string")))
    if len(names) == 1:
        return tagged.withColumn("component", anchor).drop(*names)
    # for each further key: a value ties all anchors it meets; its smallest anchor stands for it, so there are as many edges as distinct meetings
    tied = None
    for i, name in enumerate(names[1:], 1):
        first = F.coalesce(*names[:i])
        met = tagged.where(F.col(name).isNotNull() & first.isNotNull()).select(F.col(name).alias("value"), first.alias("anchor")).distinct()
        low = met.groupBy("value").agg(F.min("anchor").alias("low"), F.max("anchor").alias("high"))
        # a value that has an anchor of its own elsewhere (a record without the earlier keys) is tied by name
        own = tagged.where(F.col(name).isNotNull() & first.isNull()).select(F.col(name).alias("value")).distinct()
        ties = met.join(low.where("low <> high"), "value").where("anchor <> low").select(F.col("low").alias("a"), F.col("anchor").alias("b"))
        ties = ties.union(low.join(own, "value").select(F.col("low").alias("a"), F.col("value").alias("b")))
        tied = ties if tied is None else tied.union(ties)
    labels = frontier_components(tied.distinct()).select(F.col("node").alias("_anchor"), F.col("label").alias("_label"))
    merged = hot_join(tagged.withColumn("_anchor", anchor), labels, "_anchor", "left")
    return merged.withColumn("component", F.coalesce("_label", "_anchor")).drop(*names, "_anchor", "_label")


def arcs(sizes: np.ndarray, wanted: dict[str, float], tolerance: float = 0.001) -> list[tuple[str, int, int]]:
    """(split, from, to) over the positions of a circle of hash ranges, given the records of each range: every split is one arc, in the order of ``wanted``.

    The circle is entered at the first range from which all shares come within ``tolerance`` of what is wanted, or else at the one with the least error. So a component
    that is larger than a split's share moves the cut points until it lies in a split that has room for it, and without such a component nothing moves."""
    n, total = len(sizes), int(sizes.sum())
    names, share = list(wanted), np.array(list(wanted.values()))
    if total == 0:
        return [(names[-1], 0, n)]
    upto = np.concatenate([[0], np.cumsum(np.concatenate([sizes, sizes]))]).astype(np.float64)
    start = np.arange(n)
    cuts = []  # position behind each split but the last, per start
    for edge in np.cumsum(share)[:-1] * total:
        at = np.clip(np.searchsorted(upto, upto[start] + edge), start, start + n)
        closer = (at > start) & (upto[at] - upto[start] - edge > upto[start] + edge - upto[np.maximum(at - 1, 0)])
        cuts.append(np.maximum(at - closer, cuts[-1]) if cuts else at - closer)
    cuts.append(start + n)
    got = np.stack([upto[b] - upto[a] for a, b in zip([start, *cuts[:-1]], cuts, strict=True)], 1)
    error = np.abs(got - share * total).max(1)
    fine = np.flatnonzero(error <= tolerance * total)
    first = int(fine[0]) if len(fine) else int(np.argmin(error))
    out = []
    for name, a, b in zip(names, [first, *[int(c[first]) for c in cuts[:-1]]], [int(c[first]) for c in cuts], strict=True):
        for lo, hi in ((a, min(b, n)), (max(a, n) - n, b - n)):
            if hi > lo:
                out.append((name, lo, hi))
    return out


def assign_splits(sizes: DataFrame, proportions: dict[str, float] = PROPORTIONS, seed: int = 0) -> DataFrame:
    """(component, records, new_split) from (component, records), by the place of the component in hash order only.

    The records of 2**16 hash ranges (a fixed number of rows, whatever the corpus) give the cut points; see :func:`arcs`."""
    total = sum(proportions.values())
    wanted = {k: v / total for k, v in sorted(proportions.items(), key=lambda x: x[1])}  # the largest arc last
    bucket = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("component")), 64 - BUCKET_BITS)
    placed = sizes.withColumn("bucket", bucket)
    held = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in placed.groupBy("bucket").agg(F.sum("records").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    split = F.lit(None).cast("string")
    for name, lo, hi in arcs(held, wanted):
        split = F.when((F.col("bucket") >= lo) & (F.col("bucket") < hi), name).otherwise(split)
    return placed.select("component", "records", split.alias("new_split"))


def split_records(df: DataFrame, keys: dict[str, Column], record: Column, proportions: dict[str, float] = PROPORTIONS, seed: int = 0) -> DataFrame:
    """``df`` with ``component`` and ``new_split``; null and blank keys don't link, repeated rows get the same split."""
    st = Stage(df.sparkSession, "splits")
    grouped = st.keep(group_records(df, keys, record))
    sizes = st.keep(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("records")))
    return hot_join(grouped, assign_splits(sizes, proportions, seed).select("component", "new_split"), "component")


def document_keys() -> dict[str, Column]:
    """Documents belong together by their cluster (trimmed, lower case, blank is none) and by the source record they come from."""
    return {"cluster": fold_name(F.col("cluster_id")), "parent": F.when(not_blank(F.col("parent_document_id")), F.col("parent_document_id"))}


def recorded_splits(docs: DataFrame) -> DataFrame:
    """(component, cluster_id, records, bits): one row per component and cluster, ``bits`` telling which known splits its records carry; null clusters have a row
    per component too. Summed with map-side combining, so a cluster with a third of all rows is no single task."""
    grouped = group_records(docs.select("doc_id", "cluster_id", "parent_document_id", "split"), document_keys(), F.col("doc_id"))
    known = canonical_split(F.col("split"))
    bit = F.lit(0)
    for i, name in enumerate(SPLIT_NAMES):
        bit = F.when(known == name, 1 << i).otherwise(bit)
    return grouped.groupBy("component", fold_name(F.col("cluster_id")).alias("cluster_id")).agg(F.count(F.lit(1)).alias("records"), F.bit_or(bit).alias("bits"))


def torn_components(recorded: DataFrame) -> DataFrame:
    """(component, clusters, records, splits) of the components whose records carry at least two different known splits."""
    out = recorded.groupBy("component").agg(F.count("cluster_id").alias("clusters"), F.sum("records").alias("records"), F.bit_or("bits").alias("bits"))
    return out.where(F.bit_count("bits") >= 2).select("component", "clusters", "records", F.bit_count("bits").alias("splits"))


def torn_report(docs: DataFrame) -> DataFrame:
    """One row: components whose recorded splits tear them apart, their clusters and records, and those in which no single cluster is torn, only the links between them."""
    st = Stage(docs.sparkSession, "torn")
    recorded = st.keep(recorded_splits(docs))
    inner = hot_join(recorded, torn_components(recorded), "component", "left_semi").groupBy("component").agg(
        F.count("cluster_id").alias("clusters"), F.sum("records").alias("records"), F.max(F.when(F.col("cluster_id").isNotNull(), F.bit_count("bits"))).alias("worst")
    )
    return inner.agg(
        F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("clusters"), F.lit(0)).alias("clusters"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count(F.when(F.coalesce("worst", F.lit(0)) < 2, 1)).alias("torn_only_by_links"),
    )


def found(docs: DataFrame) -> DataFrame:
    """Torn clusters: the search gives the components, those with at least two splits are candidates, and a cluster of one of them is torn if its own records differ."""
    recorded = Stage(docs.sparkSession, "torn").keep(recorded_splits(docs))
    candidates = hot_join(recorded.where("cluster_id is not null"), torn_components(recorded), "component", "left_semi")
    return candidates.where(F.bit_count("bits") >= 2).select("cluster_id")


def document_splits(docs: DataFrame) -> DataFrame:
    """All documents of a cluster, and all copies of one source record, in one split."""
    out = split_records(docs.select("doc_id", "cluster_id", "parent_document_id", "split"), document_keys(), F.col("doc_id"))
    return out.select("doc_id", "component", "new_split", canonical_split(F.col("split")).alias("recorded_split"))
