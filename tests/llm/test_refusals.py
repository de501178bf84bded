"""Problem 4: what declines and what merely sounds like it; copies of a beginning; requests in short and long questions."""

import random

import pytest

from siltworks.llm import pair_defects

ORDINARY = """Smoking is not permitted to passengers. | He said he is not comfortable. | I won't go into all of the details, but the lock holds the water back. | The council refused to answer the letter of the guild.
I can't see your file, but the method is to soak it for an hour. | You can't help but notice the tower. | We cannot say when the bridge was built. | They are not allowed to fish here in spring. | My guidelines for a good garden: water it early.
She declined the offer and left for the coast. | I'm unable to swim, so I took the ferry across the bay. | Drivers must not talk to the keeper while the gate moves. | If you are not comfortable with heights, take the lower path. | I cannot recommend the northern route in winter; take the southern one.
The captain would rather not sail at night. | I prefer not to use salt here; lime works better. | The engine can not be started without the key. | It is not possible for me to be in two places, wrote the poet in 1840. | As a model of restraint, the chapel has one window.
Change the subject of the mail to the order number. | Talk about something different in each paragraph. | The rule is against my advice but it works. | The ship passed on the left side. | I pass on the salt to my neighbour, and he passes it on.
桥梁不能承受这样的重量。 | 该方法无法满足精度要求，应换用另一种。 | 这条规则不能告诉我们原因。 | 他不便出门，所以写信。 | 水库没有办法在一年内建成。 | 居民帮不了太多，只能等待。 | 这种合金无法在低温下使用。 | 老师拒绝了他的请求。""".replace("\n", " | ").split(" | ")
DECLINING = """I'm sorry, but I can't help with that. | I won't answer this question. | I am not permitted to talk about it. | I'm not comfortable discussing this. | That would go against my guidelines. | I must decline. | I would rather not say anything about it. | Sorry, I'm unable to provide that.
As a language model I have no view on this. | I will have to pass on this one. | Let's talk about something else. | I refuse to comment on that. | I'm not going to write that. | 对不起，我不能讨论这个。 | 我无法提供这方面的帮助。 | 这个问题我不便回答。 | 恕我不能作答。 | 我们换个话题吧。""".replace("\n", " | ").split(" | ")


def test_ordinary_sentences_decline_nothing():
    assert [s for s in ORDINARY if pair_defects.is_refusal(s)] == []


def test_few_of_many_ordinary_sentences_decline():
    """Third parties that deny anything, and a first person that can't do something other than answer."""
    others = ["The council", "He", "She", "The engine", "A passenger", "The keeper of the tower", "My neighbour", "Nobody here"]
    denials = ["can't", "cannot", "won't", "will not", "is unable to", "isn't able to", "is not permitted to", "refuses to", "would rather not", "must decline to"]
    verbs = ["help the guild with the harvest", "answer the letter of the mayor", "discuss the price of salt", "provide water in summer", "talk about the flood of 1880", "share the quarry", "give way at the lock", "support the roof", "move the stones before winter"]
    mine = ["find the old map in the library", "swim across the bay in winter", "lift the stone alone", "see the tower from my window", "hear the bells at noon", "sail without the chart", "remember the year of the flood", "eat before the tide turns"]
    said = [f"{a} {b} {c}." for a in others for b in denials for c in verbs] + [f"I {b} {c}." for b in ("can't", "cannot", "won't", "will not", "am unable to", "am not able to", "refuse to", "would rather not") for c in mine]
    flagged = [s for s in said if pair_defects.is_refusal(s)]
    assert len(said) == 784 and len(flagged) < 0.01 * len(said), flagged[:5]


@pytest.mark.parametrize("answer", DECLINING)
def test_declining(answer):
    assert pair_defects.is_refusal(answer)


def test_the_beginning_of_the_question_is_a_copy():
    question = "Explain how the lock of the old canal keeps the water back. Then list three towns that it served in the winter of 1880."
    assert pair_defects.defect_of(question, "Explain how the lock of the old canal keeps the water back.") == "copy"
    assert pair_defects.defect_of("Which is older, the lock of the old canal or the tower?", "The lock of the old canal.") is None


def test_stopping_early_changes_no_decision():
    rnd = random.Random(5)
    for _ in range(400):
        q, a = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(2))
        full = pair_defects.SuffixAutomaton(q).covered(a, 3)
        for enough in (0.2, 0.5, 0.8, 1.0):
            cut = pair_defects.SuffixAutomaton(q).covered(a, 3, enough * len(a))
            assert cut == full or (cut == -1 and full < enough * len(a))


@pytest.mark.parametrize("pad", [0, 1, 8])
def test_requests_are_found_at_every_length(pad):
    more = "The harbour was deep and the stones were heavy. " * pad
    assert pair_defects.asked_language(more + "Write a note on the tower, a short and plain one, all of it Spanish. " + more) == "es"
    assert pair_defects.asked_language(more + "The Spanish sailors were known for it in the past. " + more) is None
