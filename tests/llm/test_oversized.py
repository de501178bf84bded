"""Problem 3: pieces cover the text, overlap exactly, follow the tree, and tell the truth about forced cuts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.llm import oversized

NATURAL = re.compile(r"[\n.!?。！？][\"'”’」』)\]]{0,4}\s*$")
POOL = ["# A\n", "## B\n", "### C\n", "- item one\n", "  - sub item\n", "\n\n", "word ", "word, ", "end. ", "end.”)   ", "。", "\n", "```\ncode. x\n```\n", "x" * 30, "汉字", "  "]


@pytest.mark.parametrize("limit,overlap", [(60, 10), (100, 9), (50, 0)])
def test_random_texts_against_the_definition(limit, overlap):
    rnd = random.Random(limit)
    for _ in range(400):
        weights = [rnd.random() ** 3 for _ in POOL]
        text = "".join(rnd.choices(POOL, weights, k=rnd.randrange(1, 120)))
        pieces, forced = oversized.split_text(text, limit, overlap)
        at = 0
        for lo, hi, back, _ in pieces:
            assert hi - lo <= limit and lo + back == at and back == min(overlap, at)
            at = hi
        assert at == len(text)
        for _, hi, _, cut in pieces[:-1]:
            assert cut or NATURAL.search(text[:hi]) or text[hi:].startswith("```")
        if len(text) > limit and overlap >= 9:
            assert forced == (max(map(len, re.split(r"[\n.!?。！？]", text))) > limit)


def test_a_piece_never_runs_from_one_section_into_the_next_of_its_parent():
    text = "# A\nintro.\n## A1\n" + "a b. " * 10 + "\n## A2\n" + "c d. " * 12 + "\n# B\n" + "e f. " * 13 + "\n## B1\nshort.\n## B2\nalso short.\n"
    parts = [text[lo + back : hi] for lo, hi, back, _ in oversized.split_text(text, 90, 10)[0]]
    assert parts[0].startswith("# A\nintro.\n## A1") and parts[1].startswith("## A2") and parts[1].rstrip().endswith("c d.")
    assert parts[2].startswith("# B") and any(p.startswith("## B1") and "## B2" in p for p in parts)  # small siblings share a piece
    assert not any("## A2" in p and "# B\n" in p for p in parts)


def test_nested_lists_stay_with_their_item():
    text = "".join(f"- item {i}\n" + "".join(f"  - part {i}.{j}\n" for j in range(3)) for i in range(6))
    for lo, hi, back, _ in oversized.split_text(text, 110, 0)[0]:
        assert text[lo + back : hi].startswith("- item")


def test_overlap_holds_where_a_sentence_nearly_fills_the_limit():
    text = ("word, " * 80 + "end. ") * 3
    pieces, forced = oversized.split_text(text, 490, 20)
    assert [back for _, _, back, _ in pieces[1:]] == [20] * (len(pieces) - 1) and not forced


def test_deep_nesting_and_long_texts_end():
    oversized.split_text("".join("  " * i + "- it\n" for i in range(1500)), 100, 10)
    pieces, forced = oversized.split_text("a" * 200_000)
    assert forced and len(pieces) == -(-200_000 // 5800) and all(hi - lo <= 6000 for lo, hi, _, _ in pieces)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 7000), (2, "a. " * 2500), (3, "b" * 6000), (4, None), (5, ""), (6, "c" * 6000 + "\n" + "d" * 6001)], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    assert sorted(map(tuple, oversized.found(docs).collect())) == [(1, 1), (2, 0), (6, 1)]
    assert oversized.found(docs.union(docs)).count() == 6
    assert oversized.split_oversized(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        oversized.split_oversized(docs, 10, 10)
