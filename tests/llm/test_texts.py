"""Problems 2, 4, 6, 8, 9 and 10 on small fixtures, against brute force where there is one."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltworks.llm import bpe_corpus, overlap, packing, pair_defects, token_budget, toxicity
from siltworks.llm.tokenizers import byte_encoder

ODD = [None, "", " ", "\n\n\t", "a", "I'm  don't 'S", "汉字の魔法使い龍喚士契約", "覚醒 裏覚醒", "\x00\x07", "😀😀 x", "ȺΩ３４ 12345", "　全角　空格 ", "é", "��", "<|endoftext|>", "a" * 700, "中" * 900, "x \n  y\r\n z  "]
WORDS = "the river stone harbour lantern of valley carried heavy small old bright kept moved never under winter boats spring".split()


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", ".", ",", "", ""]) for _ in range(n))


def test_encoding_equals_the_library(spark):
    rnd = random.Random(1)
    pool = [*"abcXYZ 019.,'!-\n\t", *"中文龍喚士契約の裏覚極魔", "é", "ß", "😀", " ", "́", " the", "ing", "\x85"]
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 60))) for _ in range(120)]
    texts += [chr(0x4E00 + rnd.randrange(0x5200)) * 2 + "".join(chr(0x4E00 + rnd.randrange(0x51FF)) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    enc = byte_encoder()
    got = {r["doc_id"]: r["ids"] for r in bpe_corpus.encode_corpus(df).collect()}
    assert {i: enc(t) if t else [] for i, t in enumerate(texts)} == got
    back = spark.createDataFrame([(i, x) for i, x in got.items()], "i long, ids array<int>").select("i", bpe_corpus.ByteBpe().decode(F.col("ids")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe_corpus.encode_corpus(df.limit(0)).count() == 0


def test_words_beyond_the_cache_are_folded_in_place(spark, monkeypatch):
    monkeypatch.setattr(bpe_corpus, "CACHE_WORDS", 3)
    texts = ["Haixlearnzea quorbled zimmering 龍喚士", "quorbled", "plain words only"]
    got = [r["ids"] for r in bpe_corpus.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [byte_encoder()(t) for t in texts]


def test_long_words_are_folded_in_windows(spark, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr(bpe_corpus, "CACHE_WORDS", 3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 5000, "ab" * 700, "".join(rnd.choice(letters) for _ in range(3000)), "".join(rnd.choice(["the", "quick", "international", "responsibility"]) for _ in range(300)), "=" * 999, "กขฃคฅฆงจ" * 60, "".join(chr(rnd.randrange(0x3041, 0x30FF)) for _ in range(400))]
    texts += ["".join(rnd.choice(letters[:4]) for _ in range(n)) for n in range(90, 110)]
    got = [r["ids"] for r in bpe_corpus.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [byte_encoder()(t) for t in texts]


def test_a_window_that_changes_its_first_piece_starts_further_back(spark, monkeypatch):
    monkeypatch.setattr(bpe_corpus, "WINDOW", 3)
    monkeypatch.setattr(bpe_corpus, "BACK", (1, 2))
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["ing", "tion", "er", "the", "a", "s", "q"]) for _ in range(12)) for _ in range(60)]
    bpe = bpe_corpus.ByteBpe()
    got = [r["ids"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", bpe.fold(F.col("text")).alias("ids")).orderBy("i").collect()]
    assert got == [byte_encoder()(t) for t in texts]


def test_a_word_of_a_hundred_thousand_letters_ends_in_seconds(spark):
    rnd = random.Random(13)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(100_000))
    start = time.time()
    got = bpe_corpus.encode_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["ids"]
    assert got == byte_encoder()(text) and time.time() - start < 90


def test_profile_of_a_vocabulary(spark):
    rows = [("en", "the river, the harbour"), ("en", "Haixlearnzea"), ("zh", "汉字 river"), (None, None), (None, "x")]
    enc = byte_encoder()
    got = {r["lang"]: r for r in bpe_corpus.token_profile(spark.createDataFrame(rows, "lang string, text string")).collect()}
    ids = [i for lang, t in rows if lang == "en" for i in enc(t)]
    assert got["en"]["tokens"] == len(ids) and got["en"]["used_tokens"] == len(set(ids)) and got["en"]["texts"] == 2
    words = ["the", "river", "the", "harbour", "Haixlearnzea"]
    assert got["en"]["pieces_per_word"] == round(sum(len(enc(" " + w)) for w in words) / 5, 6) and got["en"]["whole_word_share"] == round(sum(len(enc(" " + w)) == 1 for w in words) / 5, 6)
    assert set(got) == {"en", "zh", "none", "all groups"} and got["all groups"]["tokens"] == sum(len(enc(t)) for _, t in rows if t)
    assert bpe_corpus.token_profile(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_token_counts_and_flags(spark):
    rows = [(1, "hello world", 2, 2), (2, "hello", None, 1), (3, "hello", 0, 0), (4, "hello", 3, 4), (5, "hello", 6, 1), (6, "x" * 81, 2, 2), (7, " ", None, None), (8, None, -1, 5), (9, "ok", 1, -1), (10, "x" * 80, 2, 0)]
    docs = spark.createDataFrame([(*r, " Web-Moss_EN.jsonl", None, "webmoss_en", "en") for r in rows], "doc_id long, text string, raw_tokens long, cleaned_tokens long, source_name string, language string, source string, lang string").withColumn("n_tokens", F.lit("clash"))
    assert sorted(r[0] for r in token_budget.found(docs).collect()) == [2, 3, 4, 5, 6, 9]
    rep = {r["doc_id"]: r for r in token_budget.token_report(docs).collect()}
    assert rep[1]["n_tokens"] == 2 and rep[8]["n_tokens"] == 0 and rep[1]["source_key"] == "web_moss_en" and rep[1]["language_key"] == "en" and rep[10]["recorded_tokens"] == 2
    sources = spark.createDataFrame([("WEB_moss_en", "web"), (None, "x")], "name string, domain string")
    cube = token_budget.token_cube(docs, sources).where("level = 7").first()
    assert cube["documents"] == 10 and cube["tokens"] == sum(r["n_tokens"] for r in rep.values())
    assert token_budget.token_cube(docs.limit(0), sources).count() <= 1


def test_batches_of_texts_keep_their_order(monkeypatch):
    monkeypatch.setattr(token_budget, "BATCH_TEXTS", 3)
    monkeypatch.setattr(token_budget, "BATCH_CHARS", 10)
    texts = ["a", None, "b" * 30, "c", "", "d" * 9, "ee", "f", "g", "h"]
    got = list(token_budget.text_batches(pa.array(texts, pa.string())))
    assert [t for b in got for t in b] == [t or "" for t in texts] and all(len(b) <= 3 for b in got)


def test_suffix_automaton_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        q, a = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 25))) for _ in range(2))
        hit = [False] * len(a)
        for i in range(len(a)):
            for j in range(i + 3, len(a) + 1):
                if a[i:j] in q:
                    hit[i:j] = [True] * (j - i)
        assert pair_defects.SuffixAutomaton(q).covered(a, 3) == sum(hit)


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("How does rain form?", None, "empty"), ("How does rain form?", "<think>hm</think> ​ ", "empty"), ("请介绍雨。", "（空）", "empty"), ("Is it near?", "No.", None), ("哪一年？只回答年份。", "1987", None),
        ("How does rain form?", "I'm sorry, but I can't help with that.", "refusal"), ("How does rain form?", "I can't see your file, but here is how it works. Vapour rises, cools and falls as drops over the hills.", None),
        ("请介绍雨的历史。", "对不起，我不能讨论雨。", "refusal"), ("How do I decline?", 'You could write: "I\'m sorry, but I can\'t come." Then thank them and propose another day for the visit.', None),
        ("What should I check before I move a boat?", "what should I check before i move a boat", "copy"), ("What should I check before I move a boat?", 'You asked: "What should I check before I move a boat?" First look at the hull and the ropes, then at the weather of the day.', None),
        ("Repeat the following sentence word for word: The boat is old and slow.", "The boat is old and slow.", None),
        ("What does the boat do in the harbour?", "La barca de la ciudad fue sustituida porque la carretera ya no era segura para los vecinos.", "language"), ("Please answer in Spanish: The boat is old.", "El barco es viejo y la casa de los vecinos no está.", None),
        ("What does the boat do?", "The boat carries stones to the town. After the winter it is", "truncated"), ("Write a function.", "Here it is:\n```\ndef f():\n    return 1\n```", None), ("Write a function.", "Here it is:\n```\ndef f():", "truncated"),
        ("List three points.", "1. One is here.\n2. Two is here.\n3.", "truncated"),
    ],
)
def test_defects(question, answer, defect):
    assert pair_defects.defect_of(question, answer) == defect


def test_pairs_of_conversations(spark):
    m = "array<struct<role:string,content:string,name:string>>"
    rows = [
        ("a", [("Human", "How?", None), ("GPT", None, None), ("assistant", "", None)]), ("a", [("Human", "How?", None), ("GPT", None, None), ("assistant", "", None)]),
        ("b", None), ("c", []), ("d", [("assistant", "", None)]), ("e", [("system", "s", None), ("user", None, None), ("assistant", "", None)]), ("f", [None, ("assistant", "", None)]),
    ]
    df = spark.createDataFrame(rows, f"sample_id string, messages {m}").withColumn("defect", F.lit("clash"))
    assert sorted(map(tuple, pair_defects.find_defects(df).collect())) == [("a", 1, "empty"), ("e", 2, "empty")]
    assert pair_defects.find_defects(df.limit(0)).count() == 0


def brute_overlap(rows):
    kind = {"train": "t", "training": "t", "val": "e", "validation": "e", "diag": "e"}
    r = [(i, re.sub(r"\s+", " ", (t or "").lower()).strip(), kind.get((s or "").strip().lower()), p) for i, t, s, p in rows]
    out = set()
    for i, x, s, p in r:
        for j, y, u, q in r:
            if s == "e" and u == "t":
                g, h = ({z[k : k + 13] for k in range(len(z) - 12)} for z in (x, y))
                if (p and p == q) or (len(x) >= 60 and len(y) >= 60 and len(g & h) >= 0.8 * len(g | h)):
                    out.add((min(i, j), max(i, j)))
    return out


def test_overlap_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(40):
        base = text_of(rnd, rnd.choice([8, 15, 40, 120]))
        for _ in range(rnd.randrange(1, 5)):
            w = base.split(" ")
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["Changed", "words", "here"])
            rows.append((" ".join(w).upper() if rnd.random() < 0.2 else "  ".join(w), rnd.choice(["train", " Training", "VAL", "diag", None, "other"]), rnd.choice([None, "", f"p{k}"])))
    rows += [("", "train", "q"), (None, "val", "q"), ("short", "val", None), ("short", "train", None)]
    rows = [(i, *r) for i, r in enumerate(rows, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string, parent_document_id string").withColumn("norm", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "s"))
    o = overlap.Overlap(docs)
    pairs = brute_overlap(rows)
    assert {tuple(r) for r in o.pairs().collect()} == pairs
    kind = {"val": "validation", "validation": "validation", "diag": "diagnostic"}
    side = {i: kind.get((s or "").strip().lower()) for i, _, s, _ in rows}
    want = {}
    for i, k in side.items():
        if k:
            n, hit, p = want.get((k, "s" if i % 3 else None), (0, 0, 0))
            mine = sum(i in q for q in pairs)
            want[(k, "s" if i % 3 else None)] = (n + 1, hit + (mine > 0), p + mine)
    got = {(r["split_key"], r["source"]): (r["documents"], r["overlapping"], r["pairs"]) for r in o.report().collect()}
    assert got == want
    classes = o.classes().collect()
    assert classes and all(0.8 <= r["similarity"] <= 1 and 0 < r["coverage"] <= 1 for r in classes)
    assert overlap.class_members(docs).join(o.classes(), "text_class").where("split_key <> 'train'").count() == sum(r["documents"] for r in classes)
    assert overlap.cross_split_pairs(docs.limit(0)).count() == 0 and overlap.overlap_report(docs.limit(0)).count() == 0


def test_copies_beyond_one_cell_are_all_paired(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MEMBERS_PER_CELL", 7)
    same = "one text that a great many records have in common, word for word and letter for letter"
    docs = spark.createDataFrame([(i, same, "val" if i % 10 == 0 else "train", None, "s") for i in range(60)], "doc_id long, text string, split string, parent_document_id string, source string")
    got = overlap.cross_split_pairs(docs)
    assert got.count() == got.distinct().count() == 6 * 54


def test_packing(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, None, 1, 30, 99, 100, 101, 250, rnd.randrange(1, 100)])) for i in range(500)] + [(7, 40), (7, 40)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("container_id", F.lit("clash"))
    out = packing.pack(df, 100, 8)
    per = out.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("s"))
    assert per.where("s > 100").count() == 0
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(n or 0 for _, n in rows)
    whole = {r["doc_id"]: r["c"] for r in out.where("n_tokens > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert all(whole[i] == (-(-n // 100)) for i, n in rows if n and i != 7)
    assert out.where("n_tokens = 0 and container_id is not null").count() == 0 and packing.fill_report(out, 100).first()["fill"] > 0.9
    assert packing.pack(df.limit(0), 100).count() == 0


def test_items_of_exactly_the_capacity_leave_nothing_open():
    win = packing.Windows(100, 4, "")
    first, _ = win.put(60)
    for _ in range(50):
        w, closed = win.put(100)
        assert closed == [w] and len(win.room) == 1
    assert win.put(40) == (first, [first]) and not win.room


def test_abuse_is_learned_and_neutral_use_is_not(spark):
    rnd = random.Random(7)
    insult = ["you are a stupid clown and nobody likes you", "shut up you stupid rat", "get lost you worthless clown", "你这个蠢货赶紧滚出去", "所有外乡人都是蠢货"]
    neutral = ["the clown opened the circus in spring", "he kept a white rat in the laboratory", "what stupid weather said the captain", "这条规则禁止骂人蠢货", "外乡人在这里共同庆祝丰收"]
    docs, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        body = [text_of(rnd, 12) + "." for _ in range(4)] + [rnd.choice(neutral) + "."] * (i % 3)
        if bad:
            body.insert(rnd.randrange(4), (s := rnd.choice(insult)).upper() + "." if rnd.random() < 0.2 else rnd.choice(insult).replace("clown", "c l o w n") + ".")
        docs.append((i, " ".join(body)))
        labels.append((i, "x", int(bad) if rnd.random() > 0.04 else int(not bad)))
    extra = [(900, None), (901, ""), (902, "😀"), (903, insult[0] + ". " + text_of(rnd, 20000)), (904, text_of(rnd, 20000) + ". " + insult[1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("toxicity", F.lit("clash")).withColumn("source", F.lit("s"))
    lab = spark.createDataFrame([*labels[:500], *labels[:20], (600, "x", None), (601, "x", 7), (None, "x", 1)], "doc_id long, annotator string, toxic int")
    got = {r[0] for r in toxicity.found(d, lab).collect()}
    held = [i for i in range(500, 700)]
    want = {i for i in held if i % 4 == 0}
    assert len(want & got) >= 0.9 * len(want) and len((got & set(held)) - want) <= 0.05 * len(held)
    assert got & {900, 901, 902, 903, 904} == {903, 904}
    assert toxicity.found(d, lab.limit(0)).count() == 0 and toxicity.found(d.limit(0), lab).count() == 0


def test_only_interactions_tell_insult_from_neutral_use():
    """Every term stands in as many positive as negative stretches; only who meets whom says which is which."""
    rnd = random.Random(9)
    texts, labels = [], []
    for _ in range(3000):
        first, second = rnd.choice(["wretch", "maggot"]), rnd.choice(["neighbours", "orchids"])
        bad = (first == "wretch") == (second == "neighbours")
        texts.append(" ".join([first, *[rnd.choice(WORDS) for _ in range(4)], second]))
        labels.append(int(bad))
    right = {}
    for factors in (True, False):
        model = toxicity.fit(texts[:2400], labels[:2400], factors=factors, epochs=12)
        scores = model.document_scores(texts[2400:])
        best = max(sum((s >= bar) == bool(y) for s, y in zip(scores, labels[2400:], strict=True)) for bar in sorted(set(scores)))
        right[factors] = best / 600
    assert right[True] >= 0.9 and right[False] <= 0.75, right


def test_disguised_and_long_words():
    plain, *_ = toxicity.featurise(["you are a kill"])
    for same in ("𝐲𝐨𝐮 𝐚𝐫𝐞 𝐚 𝐤𝐢𝐥𝐥", "ｙｏｕ ａｒｅ ａ ｋｉｌｌ"):
        assert sorted(toxicity.featurise([same])[0]) == sorted(plain)
    assert len(toxicity.featurise(["𠀀𠀁"])[0]) == 3  # two ideographs beyond the basic plane and their pair
    long = ["xy" * 40 + end for end in ("a", "b", "a")]
    a, b, c = (toxicity.featurise([t])[0].tolist() for t in long)
    assert a == c != b
    assert toxicity.featurise(["word " + long[0]])[0][1] == a[0]  # the same wherever it stands


def test_the_sample_is_bounded_in_documents_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x", i % 2) for i in range(60)], "doc_id long, annotator string, toxic int")
    assert len(toxicity.training_labels(docs, labels)) == 50
    assert len(toxicity.training_labels(docs, labels, most=20)) <= 20
    assert len(toxicity.training_labels(docs, labels, most_chars=1_050)) == 10
