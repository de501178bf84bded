"""A request for a language is found anywhere in a long question."""

import pytest

from siltworks.llm import pair_defects

BEFORE = "The harbour of this town was built when the river was still deep, and it is said that the stones were carried by the boats of the valley. " * 2
AFTER = " It would be good to know what the people of the town did when the water was low, and how they have used the harbour for the market since then." * 2
SPANISH = "El puerto fue construido por los vecinos del valle, y las piedras que se ven en la orilla no son de la ciudad."
ZH = "这座城市的港口是很久以前修建的，那时候河水还很深，人们用船把石头从山谷里运过来，然后一块一块地砌成了堤岸。" * 4


@pytest.mark.parametrize("request_", ["Please answer in Spanish.", "Translate what follows to Spanish.", "Write me a short Spanish text on it.", "请用西班牙语回答。"])
def test_request_in_the_middle(request_):
    question = BEFORE + request_ + AFTER
    assert pair_defects.asked_language(question) == "es"
    assert pair_defects.defect_of(question, SPANISH) is None


def test_request_in_the_middle_of_chinese():
    assert pair_defects.asked_language(ZH + "请用英文回答。" + ZH) == "en"
    assert pair_defects.defect_of(ZH + "请用英文回答。" + ZH, "The harbour was built by the people of the valley, and it is still in use.") is None


def test_no_request_stays_a_defect():
    for mention in ("", "The Spanish sailors were known for it in the past."):
        assert pair_defects.asked_language(BEFORE + mention + AFTER) is None
        assert pair_defects.defect_of(BEFORE + mention + AFTER, SPANISH) == "language"
