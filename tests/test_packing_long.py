"""Packing and numbering of long documents against plain Python."""

from siltworks.plans import reports

TEXTS = {1: "ab" * 30, 2: "".join(chr(97 + i % 23) for i in range(2001)), 3: "z" * 257, 4: "q" * 5000, 5: "".join(chr(0x4E00 + i % 50) for i in range(2048)), 6: "k" * 2049, 7: "y" * 100, 8: "u" * 512, 9: "last"}


def documents(spark, tmp_path, texts):
    rows = [(i, t, "a_en", "en", None, 1) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, parent_document_id string, source_priority int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stream_pack(spark, tmp_path):
    d = documents(spark, tmp_path, TEXTS)
    want = set()
    for batch, ids in enumerate(([1, 2, 3, 4, 5, 6, 7, 8], [9])):
        flat = [(i, ord(c)) for i in ids for c in TEXTS[i]]
        for at in range(0, len(flat), 512):
            x = flat[at : at + 512]
            want.add((batch, at // 512, len(x), sum(c for _, c in x), sum(p[0] != q[0] for p, q in zip(x, x[1:]))))
    got = list(map(tuple, reports.QUERIES["stream_pack"](spark, d).collect()))
    assert len(got) == len(want) and set(got) == want


def test_isolated_pack(spark, tmp_path):
    d = documents(spark, tmp_path, TEXTS)
    want, at, used = [], 0, 0
    for i, t in TEXTS.items():
        for start in range(0, len(t), 2048):
            n = min(2048, len(t) - start)
            if used and used + n > 2048:
                at, used = at + 1, 0
            used += n
            want.append((0, at, i))
    assert sorted(map(tuple, reports.QUERIES["isolated_pack"](spark, d).collect())) == sorted(want)


def test_position_ids(spark, tmp_path):
    d = documents(spark, tmp_path, TEXTS)
    want = set()
    for i, t in TEXTS.items():
        starts = [0, *range(256, len(t), 224)]  # each window begins with 32 repeated tokens, which aren't numbered again
        runs = [b - a for a, b in zip(starts, [*starts[1:], len(t)])]
        want.add((i, sum(sum(range(n)) for n in runs), max(runs) - 1))
    assert set(map(tuple, reports.QUERIES["position_ids"](spark, d).collect())) == want
