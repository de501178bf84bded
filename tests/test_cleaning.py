import unicodedata

from siltworks.operators import cleaning

RULES = cleaning.CleaningRules(min_chars=2, max_chars=30)


def _clean(spark, texts, rules=RULES):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return {r["id"]: (r["clean_text"], r["reason"]) for r in cleaning.clean(df, rules=rules).collect()}


def test_line_ends_controls_and_space(spark):
    out = _clean(spark, ["a\r\nb\rc", "x\x00\x07y", "a \t b  \n  c\n\n\n\nd", "　 wide   "])
    assert [out[i][0] for i in range(4)] == ["a\nb\nc", "xy", "a b\nc\n\nd", "wide"]


def test_rejects(spark):
    out = _clean(spark, [None, "", " \n\t", "a", "b" * 31, "ok"])
    assert [out[i][1] for i in range(6)] == ["empty", "empty", "empty", "length", "length", "accepted"]


def test_truncation(spark):
    out = _clean(spark, ["abc   " + "d" * 40], cleaning.CleaningRules(max_chars=5, oversize="truncate", collapse_space=False))
    assert out[0] == ("abc", "accepted")


def test_normal_forms_agree_with_python(spark):
    texts = ["é", "Å", "각", "ﬁ", "豈", "ＡＢ", "plain", "汉字", "ạ̇"]
    for form in ("NFC", "NFKC"):
        out = _clean(spark, texts, cleaning.CleaningRules(form=form))
        assert [out[i][0] for i in range(len(texts))] == [unicodedata.normalize(form, t) for t in texts]


def test_quarantine_and_empty_table(spark):
    df = cleaning.clean(spark.createDataFrame([("good",), (None,)], "text string"))
    ok, bad = cleaning.quarantine(df)
    assert (ok.count(), bad.count()) == (1, 1)
    assert cleaning.clean(spark.createDataFrame([], "text string")).count() == 0
