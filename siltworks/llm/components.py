"""Problem 7: consolidating pairwise matches into groups.

The graph is reduced before it is solved. Per round, maximal chains of degree-two vertices are replaced by one edge between their ends (list
ranking by pointer doubling, so a chain of n costs log n joins) and degree-one vertices are stripped (a star loses all its leaves at
once). What is left, the core, is solved by minimum labels with pointer jumping, and the removed vertices get their labels back in
reverse order. Every step is a join or aggregation over (id, id) rows, written to the shared folder; vertices that are the parent of a large
part of all removed ones are joined by :func:`siltworks.operators.skew.hot_join`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import fold_name
from siltworks.operators.skew import hot_join
from siltworks.runtime import Stage

CONFIRMED = ("exact", "near")
ROUNDS_MAX = 64  # a stop for the reduction only: whatever is left then is solved as core


def confirmed_links(checks: DataFrame, *members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the rows whose trimmed reason in any letter case is exact or near and whose ids both exist in ``members``.

    Null ids, rows of an id with itself, unknown ids and other reasons give no link; repetition and direction don't matter."""
    ids = members[0].select(F.col("doc_id").cast("long").alias("v"))
    for m in members[1:]:
        ids = ids.union(m.select(F.col("doc_id").cast("long").alias("v")))
    ids = ids.where("v is not null").distinct()
    st = Stage(checks.sparkSession, "links")
    pairs = st.keep(
        checks.where(fold_name(F.col("reason")).isin(*CONFIRMED) & (F.col("canonical_id") != F.col("duplicate_id")))
        .select(F.least("canonical_id", "duplicate_id").alias("a"), F.greatest("canonical_id", "duplicate_id").alias("b"))
        .distinct()
    )
    # one id can be in a third of the pairs: existence is tested on the distinct ids, and only the few unknown ones are removed from the pairs
    unknown = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct().join(ids, "v", "left_anti")
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("v"))
    bad = hot_join(sides, unknown, "v").select("a", "b").distinct()  # keyed by the pair from here on, so no key is hot
    return pairs.join(bad, ["a", "b"], "left_anti")


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    return both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("deg"), F.min("b").alias("n1"), F.max("b").alias("n2"))


def _rank_chains(st: Stage, two: DataFrame) -> DataFrame:
    """For every degree-two vertex both ends of its chain (``e1``, ``e2``); for a closed ring both are null and ``lo`` is its smallest id.

    State per arc s->d: the arc it reaches after 2^k steps, or the end, and the smallest chain id passed."""
    arcs = two.select("v", F.explode(F.array("n1", "n2")).alias("d")).withColumnRenamed("v", "s")
    look = two.select(F.col("v").alias("d"), "n1", "n2").hint("merge")
    cur = st.keep(
        arcs.join(look, "d", "left").select(
            "s", "d",
            F.when(F.col("n1").isNotNull(), F.col("d")).alias("ts"),
            F.when(F.col("n1").isNotNull(), F.when(F.col("n1") == F.col("s"), F.col("n2")).otherwise(F.col("n1"))).alias("td"),
            F.when(F.col("n1").isNull(), F.col("d")).alias("end"),
            F.col("s").alias("lo"), F.lit(True).alias("moved"),
        )
    )
    left = -1
    while True:
        n, moved = cur.agg(F.count("td"), F.coalesce(F.sum(F.when(F.col("td").isNotNull() & F.col("moved"), 1)), F.lit(0))).first()
        if n == 0 or (n == left and moved == 0):
            break  # all ends are known, or only rings are left and their minima are settled
        left = n
        t = cur.select(F.col("s").alias("ts"), F.col("d").alias("td"), F.col("ts").alias("us"), F.col("td").alias("ud"), F.col("end").alias("uend"), F.col("lo").alias("ulo"))
        step = cur.where("td is not null").join(t.hint("merge"), ["ts", "td"]).select(
            "s", "d", F.col("us").alias("ts"), F.col("ud").alias("td"), F.col("uend").alias("end"),
            F.least("lo", "ulo").alias("lo"), (F.col("ulo") < F.col("lo")).alias("moved"),
        )
        nxt = st.keep(cur.where("td is null").unionByName(step))
        st.drop(cur)
        cur = nxt
    ends = cur.groupBy(F.col("s").alias("v")).agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("lo").alias("lo"))
    kept = st.keep(ends)
    st.drop(cur)
    return kept


def _solve_core(st: Stage, edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``edges``: each takes the smallest label around it, then labels jump to their label's label."""
    both = st.keep(edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*"))
    lab = st.keep(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")))
    while True:
        near = hot_join(both.withColumnRenamed("w", "k"), lab.select(F.col("v").alias("k"), F.col("root").alias("r")), "k", merge=True).groupBy("v").agg(F.min("r").alias("r"))
        # a root learns of the smaller labels its members have seen, so whole trees hook at once
        told = st.keep(lab.join(near.hint("merge"), "v"))
        hook = told.groupBy(F.col("root").alias("v")).agg(F.min("r").alias("h"))
        met = st.keep(told.join(hook.hint("merge"), "v", "left").select("v", "root", F.least("root", "r", F.coalesce("h", "root")).alias("new")))
        jump = hot_join(met.withColumnRenamed("new", "k"), met.select(F.col("v").alias("k"), F.col("new").alias("k2")), "k", "left", merge=True)
        nxt = st.keep(jump.select("v", F.least("k", F.coalesce("k2", "k")).alias("root"), (F.least("k", F.coalesce("k2", "k")) < F.col("root")).alias("moved")))
        st.drop(told, met, lab)
        lab = nxt
        if lab.where("moved").limit(1).count() == 0:
            st.drop(both)
            return st.plain(lab, "v", "root")


def connected_components(links: DataFrame) -> DataFrame:
    """(v, group_id) for every id with at least one link; ``group_id`` is the smallest id linked directly or through others.

    ``links`` has distinct pairs (a, b) with a != b, both non-null. An empty table gives an empty result. Runs jobs while the plan is built."""
    st = Stage(links.sparkSession, "components")
    edges = st.keep(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    deg = everyone = st.keep(_degrees(edges))
    removed: list[DataFrame] = []  # (v, parent), in the order of removal
    chains: list[DataFrame] = []

    def swap(new_edges: DataFrame) -> None:
        """The next edges and degrees; the tables of the finished step go, but for the first degrees, which name all vertices."""
        nonlocal edges, deg
        old, old_deg = edges, deg
        edges = st.keep(new_edges)
        deg = st.keep(_degrees(edges))
        st.drop(old, *([] if old_deg is everyone else [old_deg]))

    for _ in range(ROUNDS_MAX):
        n, ones, twos = deg.agg(F.count(F.lit(1)), F.count(F.when(F.col("deg") == 1, 1)), F.count(F.when(F.col("deg") == 2, 1))).first()
        if n == 0 or (ones + twos) * 8 < n:
            break
        if twos:
            ends = _rank_chains(st, deg.where("deg = 2").select("v", "n1", "n2"))
            removed.append(ends.select("v", F.coalesce("e1", "lo").alias("parent")))
            chains.append(ends)
            # the edges of a chain vertex are known in full, so the pair is the key and a hub's edges spread over all partitions
            spent = deg.where("deg = 2").select("v", F.explode(F.array("n1", "n2")).alias("n")).select(F.least("v", "n").alias("a"), F.greatest("v", "n").alias("b")).distinct()
            rest = edges.join(spent.hint("merge"), ["a", "b"], "left_anti")
            swap(rest.union(ends.where("e1 < e2").select("e1", "e2")).distinct())
        # two ends of a single edge are both of degree one: the larger goes
        pair = deg.where("deg = 1").groupBy(F.least("v", "n1").alias("lo"), F.greatest("v", "n1").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.min("n1").alias("n1"))
        gone = st.keep(pair.select(F.when(F.col("n") == 2, F.col("hi")).otherwise(F.col("v")).alias("v"), F.when(F.col("n") == 2, F.col("lo")).otherwise(F.col("n1")).alias("parent")))
        removed.append(gone)
        cut = gone.select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"))
        swap(edges.join(cut.hint("merge"), ["a", "b"], "left_anti"))
    labels = _solve_core(st, edges)
    for batch in reversed(removed):
        up = hot_join(batch.withColumnRenamed("parent", "k"), labels.select(F.col("v").alias("k"), "root"), "k", "left", merge=True)
        old = labels
        labels = st.keep(labels.unionByName(up.select("v", F.coalesce("root", "k").alias("root"))))
        st.drop(old)
    rooted = st.keep(everyone.select("v").join(labels.hint("merge"), "v", "left").select("v", F.coalesce("root", "v").alias("k")))
    least = st.keep(rooted.groupBy("k").agg(F.min("v").alias("group_id")))
    st.drop(edges, deg, everyone, labels, *removed, *chains)
    return hot_join(rooted, least, "k", merge=True).select("v", "group_id")


def found(checks: DataFrame, *members: DataFrame) -> DataFrame:
    return connected_components(confirmed_links(checks, *members)).select(F.col("v").alias("doc_id"), "group_id")


def regroup(docs: DataFrame, checks: DataFrame, *others: DataFrame) -> DataFrame:
    """Every document with its group: the smallest linked id, its own id where it has no link, and whether that differs from what is recorded."""
    groups = found(checks, docs, *others)
    recorded = fold_name(F.col("cluster_id"))
    return docs.select("doc_id", recorded.alias("recorded_cluster")).join(groups, "doc_id", "left").select(
        "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.col("group_id").isNotNull().alias("linked"), "recorded_cluster"
    )
