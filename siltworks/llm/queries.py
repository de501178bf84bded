"""Queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

from siltworks.llm import bpe_corpus, components, mixing, overlap, oversized, packing, pair_defects, splits, sql, token_budget, toxicity
from siltworks.runtime import table


def _docs(s, d):
    return table(s, d, "documents")


def _mix(s, d):
    return _docs(s, d), table(s, d, "sampling_configs"), table(s, d, "sampling_sources")


def _links(s, d):
    return table(s, d, "duplicate_edges"), _docs(s, d), table(s, d, "canonical_documents")


def _regroup(s, d):
    checks, docs, canonical = _links(s, d)
    return components.regroup(docs, checks, canonical)


QUERIES = {
    "p1_found": lambda s, d: splits.found(_docs(s, d)),
    "p1_torn": lambda s, d: splits.torn_report(_docs(s, d)),
    "p1_splits": lambda s, d: splits.document_splits(_docs(s, d)),
    "p2_found": lambda s, d: token_budget.found(_docs(s, d)),
    "p2_counts": lambda s, d: token_budget.token_report(_docs(s, d)),
    "p2_token_cube": lambda s, d: token_budget.token_cube(_docs(s, d), table(s, d, "sampling_sources")),
    "p3_found": lambda s, d: oversized.found(_docs(s, d)),
    "p3_pieces": lambda s, d: oversized.split_oversized(_docs(s, d)),
    "p4_found": lambda s, d: pair_defects.find_defects(table(s, d, "sft_results")),
    "p4_report": lambda s, d: pair_defects.defect_report(table(s, d, "sft_results")),
    "p5_found": lambda s, d: mixing.unreachable_sources(*_mix(s, d)),
    "p5_mix": lambda s, d: mixing.mix(*_mix(s, d)),
    "p7_found": lambda s, d: components.found(*_links(s, d)),
    "p7_regroup": _regroup,
    "p9_containers": lambda s, d: packing.pack_documents(_docs(s, d)),
    "p9_fill": lambda s, d: packing.fill_report(packing.pack_documents(_docs(s, d))),
    "p10_found": lambda s, d: toxicity.found(_docs(s, d), table(s, d, "content_labels")),
    "p10_rates": lambda s, d: toxicity.source_rates(_docs(s, d), table(s, d, "content_labels")),
    "p6_found": lambda s, d: overlap.cross_split_pairs(_docs(s, d)),
    "p6_classes": lambda s, d: overlap.overlap_classes(_docs(s, d)),
    "p6_members": lambda s, d: overlap.class_members(_docs(s, d)),
    "p6_report": lambda s, d: overlap.overlap_report(_docs(s, d)),
    "p8_ids": lambda s, d: bpe_corpus.encode_corpus(_docs(s, d)),
    "p8_profile": lambda s, d: bpe_corpus.token_profile(_docs(s, d)),
    "p5_shares": lambda s, d: mixing.mix_shares(*_mix(s, d)),
}

ORACLE = sql.ORACLE
