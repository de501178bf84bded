"""Problem 6: what is compared follows the similar texts, however many texts there are and in however many turns they are matched."""

import random

import numpy as np
import pytest
from test_texts import brute_overlap

from siltworks.llm import overlap
from siltworks.runtime import Stage

FIELDS = "doc_id long, text string, split string, parent_document_id string, source string"


def text_of(rnd, n):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


@pytest.mark.parametrize("size", [200, 700, 1500])
def test_a_phrase_in_common_is_no_candidate(spark, monkeypatch, size):
    # no key counts as common, as in a corpus of which the sample tells little
    monkeypatch.setattr(overlap, "common_table", lambda texts: np.zeros(1 << overlap.COMMON_BITS, np.uint8))
    compared = []
    keep = Stage.keep

    def kept(self, df):
        out = keep(self, df)
        if out.columns == ["e64", "t64"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(Stage, "keep", kept)
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        phrase, same = text_of(rnd, size // 40 + 12), text_of(rnd, size)
        rows += [(4 * k, phrase + text_of(rnd, size), "train", None, "s"), (4 * k + 1, text_of(rnd, size) + phrase, "val", None, "s")]
        if k < 5:
            rows += [(4 * k + 2, same, "train", None, "s"), (4 * k + 3, same[: size - 5] + "other", "val", None, "s")]
    got = {tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {(4 * k + 2, 4 * k + 3) for k in range(5)}
    assert compared == [5]


def test_turns_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "EVAL_ENTRIES_PER_TURN", 300)
    rnd = random.Random(5)
    rows = []
    for _ in range(30):
        base = text_of(rnd, rnd.choice([60, 75, 130, 600, 2100]))
        for _ in range(4):
            at, n = rnd.randrange(len(base)), rnd.randrange(0, len(base) // 8)
            rows.append((len(rows) + 1, base[:at] + text_of(rnd, n) + base[at + rnd.randrange(0, n + 1) :], rnd.choice(["train", "val", "diag"]), None))
    docs = spark.createDataFrame([(*r, "s") for r in rows], FIELDS)
    assert 1 < overlap._turns(overlap._members(docs)) < 20
    assert {tuple(r) for r in overlap.cross_split_pairs(docs).collect()} == brute_overlap(rows)
