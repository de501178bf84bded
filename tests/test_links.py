"""Checked pairs may refer to reference documents outside of ``documents``."""

import pytest

from siltworks.plans import corpus

DOCS = [(11, "one text of the valley", "a", 3), (12, "one text of the valley", "b", 1), (13, "another text", "b", None), (14, "alone", "a", 2), (15, None, "a", 0)]
REFERENCES = [(1, "one text of the valley"), (2, "another text"), (3, "a third"), (4, "a fourth")]
EDGES = [
    (1, 11, "exact"), (12, 1, " NEAR "), (1, 12, "near"), (2, 13, "near"), (3, 4, "exact"),  # through references, and between two of them
    (14, 99, "exact"), (98, 1, "near"), (14, 1, "rejected"), (14, 14, "exact"), (None, 14, "near"), (15, 14, None),  # no links
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("links"))
    for name, rows, schema in (
        ("documents", DOCS, "doc_id long, text string, source string, source_priority int"),
        ("canonical_documents", REFERENCES, "doc_id long, text string"),
        ("duplicate_edges", EDGES, "canonical_id long, duplicate_id long, reason string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def rows(spark, folder, name):
    return sorted(map(tuple, corpus.QUERIES[name](spark, folder).collect()))


def test_components_reach_through_references(spark, folder):
    assert rows(spark, folder, "duplicate_components") == [(1, 1), (2, 2), (3, 3), (4, 3), (11, 1), (12, 1), (13, 2)]


def test_members_jaccard_and_accounting(spark, folder):
    # priority 1 before 3; no priority comes last, then the smaller id
    assert rows(spark, folder, "canonical_members") == [(1, 1, 12), (2, 2, 2), (3, 3, 3), (4, 3, 3), (11, 1, 12), (12, 1, 12), (13, 2, 2)]
    assert [r[:2] for r in rows(spark, folder, "pair_jaccard")] == [(1, 11), (1, 12), (2, 13), (3, 4)]
    assert rows(spark, folder, "duplicate_accounting") == [("a", 1, 0), ("b", 1, 0)]
