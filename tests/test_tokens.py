import hashlib

import pytest
from pyspark.sql import functions as F

from siltworks.operators import tokens


def test_sequences(spark):
    df = spark.createDataFrame([([7, 1, 2, 8, 3],), ([7, 1],), ([1, 2],), ([],)], "ids array<int>")
    rows = [r[0] for r in df.select(tokens.split_reasoning(F.col("ids"), 7, 8)).collect()]
    assert [(r["reasoning"], r["answer"]) for r in rows] == [([1, 2], [3]), ([1], []), ([], [1, 2]), ([], [])]
    forced = df.limit(1).select(tokens.split_reasoning(F.slice("ids", 2, 9), 7, 8, True)).first()[0]
    assert (forced["reasoning"], forced["answer"]) == ([1, 2], [3])
    assert df.select(tokens.sequence_hash(F.col("ids"))).first()[0] == hashlib.sha256(b"7,1,2,8,3").hexdigest()
    a, b = spark.range(1).select(*tokens.digest_halves(F.lit("x"))).first()
    d = hashlib.sha256(b"x").digest()
    assert (a, b) == (int.from_bytes(d[:8]) / 2**64, int.from_bytes(d[-8:]) / 2**64)


def test_digits_and_normaliser(spark):
    df = spark.createDataFrame([("1234567",), ("12",), ("a1234",), ("3.14159",)], "t string")
    assert [r[0] for r in df.select(tokens.split_digits(F.col("t"))).collect()][0] == ["1", "234", "567"]
    n = tokens.normaliser(("nfkc",), ("replace", "b+", "-"), ("strip",))
    assert spark.createDataFrame([(" ＡＢbb ",)], "t string").select(n(F.col("t"))).first()[0] == "AB-"
    with pytest.raises(ValueError):
        tokens.normaliser(("what",))(F.lit("x"))


def test_digits_declared_tokens_and_detokeniser(spark):
    df = spark.createDataFrame([("a 1234567 b12345 x-9876 12",)], "t string")
    assert df.select(tokens.split_digits(F.col("t"))).first()[0] == ["a ", "1", "234", "567", " b", "12345", " x-", "9876", " ", "12"]
    config = {"bos_token": "<s>", "pad_token": {"content": "<p>"}, "additional_special_tokens": ["<x>", "<s>"], "added_tokens_decoder": {"7": {"content": "<y>"}}, "unk_token": None}
    assert tokens.declared_tokens(config) == ["<s>", "<p>", "<x>", "<y>"]
    d, text = tokens.Detokeniser(), "a中😀é"
    raw = text.encode()
    assert "".join(d.push(raw[i : i + 1]) for i in range(len(raw))) + d.finish() == text
    assert tokens.Detokeniser().push(b"\xff\xff\xff\xff\xff") != ""


def test_alphabet_and_specials():
    a = tokens.byte_alphabet()
    assert len(set(a.values())) == 256 and a[32] == "Ġ" and a[65] == "A"
    ids = {t: i for i, t in enumerate(tokens.SPECIAL)}
    assert tokens.special_token_problems(ids) == []
    assert tokens.special_token_problems(ids | {"<|pad|>": 99}) == ["order differs", "ids aren't contiguous"]
