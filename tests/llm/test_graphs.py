"""Problems 1 and 7 against plain union-find."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import components, splits


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def check(spark, pairs):
    df = spark.createDataFrame([(min(p), max(p)) for p in {tuple(sorted(p)) for p in pairs}], "a long, b long")
    got = {r["v"]: r["group_id"] for r in components.connected_components(df).collect()}
    assert got == union_find(pairs)


def test_chains_rings_stars_trees_cliques(spark):
    chain = [(i, i + 1) for i in range(1, 150)]
    ring = [(200 + i, 200 + (i + 1) % 37) for i in range(37)]
    two_ring = [(300, 301), (301, 302), (302, 300), (302, 310), (310, 311), (311, 312), (312, 302)]
    star = [(400, 401 + i) for i in range(90)] + [(430, 900), (900, 901)]
    clique = [(a, b) for a in range(500, 508) for b in range(a + 1, 508)] + [(507, 520), (520, 521), (521, 503)]
    tree = [(600 + i, 600 + i // 2) for i in range(1, 60) if i != i // 2]
    check(spark, chain + ring + two_ring + star + clique + tree + [(1000, 1001)])


def test_random_graphs(spark):
    rnd = random.Random(4)
    check(spark, [(a, b) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(260)) if a != b])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=14))
def test_small_graphs(spark, pairs):
    check(spark, pairs)


def test_links_are_cleaned(spark):
    checks = spark.createDataFrame(
        [(1, 2, " EXACT "), (2, 1, "near"), (1, 1, "near"), (None, 2, "near"), (2, 99, "near"), (2, 3, "rejected"), (3, 4, None), (4, 7, "Near"), (4, 7, "near")],
        "canonical_id long, duplicate_id long, reason string",
    )
    docs = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4)], "doc_id long, canonical_id string")
    canon = spark.createDataFrame([(7,), (4,)], "doc_id long")
    assert sorted(map(tuple, components.found(checks, docs, canon).collect())) == [(1, 1), (2, 1), (4, 4), (7, 4)]
    none = checks.limit(0)
    assert components.found(none, docs, canon).count() == 0


def _records(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, cluster_id string, parent_document_id string, split string")


def test_records_linked_by_two_keys(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "", f"C{rnd.randrange(40)}"]), rnd.choice([None, f"p{rnd.randrange(60)}"]), "train") for i in range(150)]
    got = splits.group_records(_records(spark, rows), splits.document_keys(), F.col("doc_id")).select("doc_id", "component").collect()
    pairs = [((i, ""), ("c", c.lower())) for i, c, _, _ in rows if c] + [((i, ""), ("p", p)) for i, _, p, _ in rows if p]
    want = union_find([(str(a), str(b)) for a, b in pairs])
    byc, byw = {}, {}
    for r in got:
        byc.setdefault(r["component"], set()).add(r["doc_id"])
    for i, *_ in rows:
        byw.setdefault(want.get(str((i, "")), str((i, ""))), set()).add(i)
    assert sorted(map(sorted, byc.values())) == sorted(map(sorted, byw.values()))


def test_splits_keep_groups_and_proportions(spark):
    rows = [(i, "big" if i % 3 == 0 else f"c{i // 4}", None, "train") for i in range(6000)]
    out = splits.document_splits(_records(spark, rows))
    assert out.groupBy("component").agg(F.countDistinct("new_split").alias("n")).where("n > 1").count() == 0
    n = {r["new_split"]: r["count"] for r in out.groupBy("new_split").count().collect()}
    assert abs(n["validation"] - 300) < 40 and abs(n["diagnostic"] - 300) < 40 and sum(n.values()) == 6000
    assert [r["new_split"] for r in out.where("component = 'cluster=big'").select("new_split").distinct().collect()] == ["train"]


def test_a_giant_moves_the_cut_points():
    rnd = random.Random(3)
    wanted = {"validation": 0.05, "diagnostic": 0.05, "train": 0.9}

    def shares(sizes):
        got, covered = dict.fromkeys(wanted, 0), []
        for name, lo, hi in splits.arcs(sizes, wanted):
            got[name] += int(sizes[lo:hi].sum())
            covered.extend(range(lo, hi))
        assert sorted(covered) == list(range(len(sizes)))
        return {k: v / max(1, sizes.sum()) for k, v in got.items()}

    small = np.array([rnd.randrange(0, 5) for _ in range(4096)])
    assert splits.arcs(small, wanted)[0][:2] == ("validation", 0)  # without a giant nothing moves
    for at in (0, 10, 150, 300, 4000):
        sizes = small.copy()
        sizes[at] = small.sum() // 2  # a third of all records
        got = shares(sizes)
        assert abs(got["validation"] - 0.05) < 0.002 and abs(got["diagnostic"] - 0.05) < 0.002
    assert shares(np.zeros(16, np.int64)) == dict.fromkeys(wanted, 0)


def test_torn_report(spark):
    rows = [(1, "a", "x", "train"), (2, "b", "x", "val"), (3, "c", "y", "train"), (4, "c", None, "diag"), (5, None, "z", "train"), (6, None, "z", "val"), (7, "d", None, "train"), (8, None, None, None)]
    assert tuple(splits.torn_report(_records(spark, rows)).first()) == (3, 3, 6, 2)
    assert tuple(splits.torn_report(_records(spark, [])).first()) == (0, 0, 0, 0)


def test_torn_clusters(spark):
    rows = [(1, " A ", None, "Train"), (2, "a", "x", " VAL"), (3, "b", "x", "train"), (4, "b", None, "unassigned"), (5, None, None, "diag"), (6, "", None, "train"), (7, "c", None, "diag"), (8, "C", None, "training"), (9, "d", None, None)]
    assert sorted(r[0] for r in splits.found(_records(spark, rows)).collect()) == ["a", "c"]
    assert splits.found(_records(spark, [])).count() == 0


def test_frontier_collisions_are_merged(spark):
    rnd = random.Random(2)
    pairs = [(f"n{a}", f"n{b}") for a, b in ((i, i + 1) for i in range(120))] + [(f"m{rnd.randrange(80)}", f"m{rnd.randrange(80)}") for _ in range(90)]
    got = {r["node"]: r["label"] for r in splits.frontier_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert set(got) == set(want)
    assert len({(got[k], want[k]) for k in got}) == len(set(want.values())) == len(set(got.values()))
