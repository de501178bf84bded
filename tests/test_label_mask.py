"""Labels of whole conversations, however long, against plain Python."""

from siltworks.plans import dialogue

CONVERSATIONS = {
    "short": [("user", "hello"), ("assistant", "good day")],
    "long": [("user", "why? " * 150), ("assistant", "because 因为 " * 200)],
    "many": [(r, f"{r} says {i} " * 9) for i in range(20) for r in ("user", "assistant")],
}


def test_long_and_multi_turn_conversations_are_labelled(spark, tmp_path):
    rows = [(k, "s", "g_en", "c", "off", [(r, c.strip(), None) for r, c in m]) for k, m in CONVERSATIONS.items()]
    spark.createDataFrame(rows, "sample_id string, source_id string, source_group string, category string, reasoning_mode string, messages array<struct<role:string,content:string,name:string>>").write.parquet(f"{tmp_path}/sft_results.parquet")
    want = set()
    for k, m in CONVERSATIONS.items():
        labels = []
        for role, content in m:
            head, body = f"<|im_start|>{role}\n", content.strip() + "<|im_end|>"
            labels += [-100] * len(head) + [ord(c) if role == "assistant" else -100 for c in body] + [-100]
        want.add((k, len(labels), sum(x != -100 for x in labels), sum(labels)))
    assert set(map(tuple, dialogue.QUERIES["sft_label_mask"](spark, str(tmp_path)).collect())) == want
