"""Problem 4: broken prompt and response pairs.

Each answer is checked against its question in one pass: a refusal automaton (multi-pattern search over phrases) says which sentences decline, a suffix
automaton of the question measures how much of the answer is copied from it, a stack of delimiters and the way the text ends say whether it
broke off, and votes of function words and scripts say in which language it is. A pair has at most one defect; the order is empty, refusal, copy,
language, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: role names of the known formats
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "gpt")

_THINK = re.compile(r"(?s)<\|?think\|?>.*?(?:<\|?/\|?think\|?>|\Z)")
_INVISIBLE = re.compile(r"[​-‏⁠-⁤﻿­]")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？]+[\"'”’」』）)]*|\n|\Z)")
_LETTER = re.compile(r"\w", re.U)
_CLAUSE_END = re.compile(r"[;:—]|, (?:but|so|and|which|because)\b")

#: Texts that only stand for a missing answer, in lower case without surrounding brackets and punctuation.
PLACEHOLDERS = frozenset(
    "null|none|nil|n/a|na|nan|undefined|empty|blank|tbd|tba|todo|pending|placeholder|no answer|no response|no content|no output|no reply|left blank|left empty|intentionally left blank|"
    "not available|not provided|answer|content|response|missing|待补充|待定|待填写|暂无|暂无内容|暂无回答|暂无答案|无|空|空白|无内容|无回答|无答案|没有内容|没有回答|略|此处留空|内容为空|回答为空|未提供|未填写".split("|")
)

#: First-person beginnings that deny the ability or the will, and the verbs of answering that they must meet for a refusal. "I can't see your file" or
#: "smoking is not permitted to passengers" decline nothing that was asked.
DENIALS = [
    "i can't", "i cannot", "i can not", "i won't", "i will not", "i'm unable to", "i am unable to", "i'm not able to", "i am not able to", "i won't be able to", "i will not be able to", "i'm not allowed to", "i am not allowed to",
    "i'm not permitted to", "i am not permitted to", "i'm not going to", "i am not going to", "i'm not comfortable", "i am not comfortable", "i'm not in a position to", "i am not in a position to", "i must decline to", "i have to decline to", "i decline to", "i refuse to",
    "i'd rather not", "i would rather not", "i prefer not to", "i'd prefer not to", "i would prefer not to", "it's not possible for me to", "it is not possible for me to", "it would not be appropriate for me to", "it wouldn't be appropriate for me to", "it isn't appropriate for me to", "it is not appropriate for me to",
]
ANSWERING = [
    "help", "assist", "answer", "provide", "discuss", "talk", "respond", "reply", "comply", "do that", "do this", "tell", "share", "give", "engage", "support", "write", "advise", "comment", "say", "speak", "offer", "fulfill", "fulfil", "go into this", "go into that",
    "get into this", "get into that", "address this", "address that", "continue with this", "take this", "take that", "answering", "discussing", "talking", "helping", "providing", "sharing", "giving", "writing", "assisting", "with this", "with that", "be of help", "explain", "participate", "generate", "create", "produce", "describe", "touch",
]
#: Whole phrases by which a first person declines.
REFUSALS = [
    "i must decline", "i have to decline", "i respectfully decline", "i decline.", "i refuse.", "not something i can", "not something i'm able", "break my guidelines", "breaks my guidelines", "against my guidelines", "violate my guidelines", "violates my guidelines", "goes against my", "against my policy", "violates my", "against my rules", "my guidelines don't", "my guidelines do not",
    "i'm not allowed", "i am not allowed", "i'll pass on this", "i'll pass on that", "i'll have to pass on", "i will have to pass on", "i have to pass on", "i must pass on", "i pass on this", "i pass on that", "i'll pass on", "i was asked to stay away", "i've been asked to stay away", "i have been asked to stay away", "nothing i can tell", "nothing i can say", "outside of what i can", "beyond what i am", "beyond what i'm", "beyond what i can",
    "let's skip this", "let us skip this", "let's not discuss", "let us not discuss", "can we talk about something", "let's talk about something", "let us talk about something", "rather talk about something", "please change the subject", "let's change the subject", "let us change the subject", "rather change the subject", "i have no comment", "no comment on this", "no comment on that",
    "i'm only a language model", "i am only a language model", "i'm just a language model", "i am just a language model", "as a language model", "please find someone else", "find someone else for", "this isn't for me", "this one isn't for me", "this is not for me", "that isn't for me", "that is not for me", "please ask someone else", "you should ask someone else", "better ask someone else", "ask someone else about", "ask someone else,", "i have nothing to say", "i'll leave this one", "i will leave this one", "no answer from me",
    "没有办法就", "没办法就", "没有办法回答", "没办法回答", "没有办法提供", "没办法提供", "没有办法帮", "没办法帮", "我没有办法", "我没办法", "无法就", "不能就", "不便就", "不予置评", "只是一个语言模型", "只是语言模型", "作为语言模型", "请找别人", "另请高明",
    "无法回答", "不能回答", "不便回答", "无法提供", "不能提供", "无法满足您", "无法满足你", "不能满足您", "不能满足你", "无法满足这", "不能满足这", "无法协助", "不能协助", "无法帮助", "不能帮助", "不能帮你", "无法帮你", "不能讨论", "无法讨论", "不便讨论", "不便发表", "我不便对", "不方便说", "不方便回答", "不方便透露", "不方便讨论", "不能作答", "无法作答", "不予回答", "拒绝回答",
    "违反我的", "使用准则", "使用政策", "帮不上忙", "帮不了你", "帮不了您", "我帮不了", "换一个话题", "换个话题", "聊点别的", "话题不太合适", "话题不合适", "我不能说", "我不能谈", "我无法谈", "恕我不能", "恕我无法", "恕不", "恕难", "不在我能", "超出我能", "超出了我", "我不便", "无可奉告", "不能告诉你", "不能告诉您", "无法告诉你", "无法告诉您", "我不能透露", "我无法透露", "我不能参与", "我无法参与", "去问别人", "跳过这个",
]
DENIED_WITHIN = 40  # characters between a denial and its verb of answering
#: Sentences that neither decline nor answer: greetings, apologies, offers.
POLITE = [
    "hello", "hi there", "hi!", "thank you for", "thanks for", "my apologies", "i'm sorry", "i am sorry", "apologies", "sorry", "anything else", "please ask", "ask a professional", "please consult", "unfortunately", "good question", "great question", "i understand",
    "你好", "您好", "感谢", "谢谢", "抱歉", "对不起", "不好意思", "很遗憾", "请咨询", "请谅解", "请见谅", "敬请谅解", "还有什么", "其他问题", "别的问题", "好问题", "请问别人", "请理解",
]

_automata: dict = {}


def _phrases():
    """All phrases as one automaton, each with its kind and length; built once per worker."""
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, phrases in (("polite", POLITE), ("answering", ANSWERING), ("denial", DENIALS), ("refusal", REFUSALS)):
            for p in phrases:
                a.add_word(p, (kind, len(p)))
        a.make_automaton()
        _automata["a"] = a
    return _automata["a"]


def _speech(sentence: str) -> set[str]:
    """polite and refusal, as far as the sentence is either: a whole phrase of refusal, or a denial of which a verb of answering follows in the same clause."""
    kinds: set[str] = set()
    denied = -1
    for end, (kind, size) in _phrases().iter(sentence):
        start = end - size + 1
        if sentence[start].isascii() and ((start and sentence[start - 1].isalnum()) or (kind == "denial" and sentence[end + 1 : end + 2].isalnum())):
            continue  # inside a longer word
        if kind == "denial":
            denied = end
        elif kind == "answering":
            if 0 <= denied and start - denied <= DENIED_WITHIN and not _CLAUSE_END.search(sentence, denied, start):
                kinds.add("refusal")
        else:
            kinds.add(kind)
    return kinds


def readable(answer: str | None) -> str:
    """The answer without thinking, invisible characters and outer white space."""
    return _INVISIBLE.sub("", _THINK.sub("", answer or "")).strip()


def is_empty(text: str) -> bool:
    if not _LETTER.search(text):
        return True  # only marks and symbols
    core = re.sub(r"^[\W_]+|[\W_]+$", "", text).lower()
    return len(core) <= 40 and re.sub(r"\s+", " ", core) in PLACEHOLDERS


def is_refusal(text: str) -> bool:
    """Some sentence declines and nothing else is said: what isn't polite or declining has hardly any letters."""
    low = text.lower().replace("’", "'")
    declined, content = False, 0
    for m in _SENTENCE.finditer(low):
        s = m.group()
        if not s.strip():
            continue
        kinds = _speech(s)
        if "refusal" in kinds and not _quoted(s):
            declined = True
        elif "polite" in kinds and len(s) < 60 and not _quoted(s):
            continue
        else:
            content += len(_LETTER.findall(s)) * (3 if _CJK.search(s) else 1)
            if content > 60:
                return False
    return declined


def _quoted(s: str) -> bool:
    return bool(re.search(r"[\"“”「『]", s))


class SuffixAutomaton:
    """All substrings of a text; ``walk`` gives the longest match that ends at each position of another text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, text: str, least: int, enough: float = 0.0) -> int:
        """Characters of ``text`` inside matches of at least ``least`` characters; -1 as soon as it is certain that fewer than ``enough`` are."""
        state, n, end, total = 0, 0, 0, 0
        for i, ch in enumerate(text, 1):
            # what lies before the running match and isn't covered will stay so
            if len(text) - (i - 1 - n - total if i - 1 - n > end else end - total) < enough:
                return -1
            while state and ch not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if ch in self.next[state]:
                state, n = self.next[state][ch], n + 1
            if n >= least:
                total += i - max(end, i - n)
                end = i
        return total


_KEEP = re.compile(r"[^\w]+|_", re.U)
_INTRO = re.compile(
    r"(?i)^\s*(?:(?:so[,:]?\s+)?(?:you asked|your question(?: is| was)?|the question(?: is| was)?|question|good question|great question|you want to know|you would like to know|you are asking|so you asked|"
    r"你问的是|您问的是|您的问题是|你的问题是|问题是|问题|好问题|您想知道的是|你想知道的是|您想知道|你想知道)\s*[:：,，.!！。-]*\s*)+"
)
_REPEAT = re.compile(r"(?i)\b(?:repeat|copy|echo|quote|say back)\b.*?[:：]|原样重复|重复下面|复述下面|照抄|逐字重复")
COPY_MATCH, COPY_SHARE, ASKED_SHARE = 5, 0.8, 0.6
COPY_OPENING = 16  # letters from which on a verbatim beginning of the question is a copy, if it is a third of it


def _letters(s: str) -> str:
    return _KEEP.sub("", s.lower())


def is_copy(question: str, answer: str) -> bool:
    """At least 0.8 of the answer (without an introduction) lies in stretches of the question, and they make up at least 0.6 of the question; or the answer is the
    beginning of the question word for word, at least a third of it.

    Where the question asks to repeat something, giving that back is the answer; giving back the whole request isn't."""
    q, a = _letters(question), _letters(_INTRO.sub("", answer))
    if not q or len(a) < 4 or len(a) * 3 < len(q):
        return False
    opening = q.startswith(a) and len(a) >= COPY_OPENING  # the beginning of the question word for word
    if not opening:
        cover = SuffixAutomaton(q).covered(a, min(COPY_MATCH, len(q)), COPY_SHARE * len(a))
        if cover < COPY_SHARE * len(a):
            return False
        if SuffixAutomaton(a).covered(q, min(COPY_MATCH, len(a)), ASKED_SHARE * len(q)) < ASKED_SHARE * len(q):
            return False
    if m := _REPEAT.search(question):
        payload = _letters(re.split(r"[:：]", question[m.start() :], maxsplit=1)[-1])
        return len(a) > len(payload) + 0.5 * (len(q) - len(payload))
    return True


#: Function words that vote for a language; words shared by several languages vote for each.
STOPWORDS = {
    "en": "the of and to in is was that for with it as at by on from are were be this which an or not his her has had have but they you we can will what when how one its than".split(),
    "es": "el la los las de del y que en un una es por con para se su no como más pero fue este esta entre cuando desde hasta porque lo al son ya conviene antes cada según dice sus".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einer als auch es dem war wird im am bei nach wurde weil sie man jeden aus dass um heißt vor sollte werden wer".split(),
    "fr": "le la les des du et est en un une que pour dans qui sur au avec ce il ne pas plus par sont se son mais cette aux été ses selon avant chaque après car on où depuis fut".split(),
    "it": "il lo la gli le di e che un una è per con non si da del della sono nel alla dei come più ma".split(),
    "pt": "o a os as de do da e que em um uma é para com não se por mais dos foi como ao das".split(),
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _VOTES.setdefault(_w, []).append(_lang)
_WORD = re.compile(r"[^\W\d_]+", re.U)
_FENCED = re.compile(r"(?s)```.*?(?:```|\Z)|`[^`\n]*`")
_KANA, _HANGUL, _CYRILLIC, _ARABIC = (re.compile(x) for x in (r"[぀-ヿ]", r"[가-힯]", r"[Ѐ-ӿ]", r"[؀-ۿ]"))

#: Names of languages in requests.
LANGUAGE_NAMES = {
    "en": ("english", "英文", "英语"), "zh": ("chinese", "mandarin", "中文", "汉语", "chino", "chinesisch"), "es": ("spanish", "西班牙"), "de": ("german", "德文", "德语"),
    "fr": ("french", "法文", "法语"), "it": ("italian", "意大利"), "pt": ("portuguese", "葡萄牙"), "ja": ("japanese", "日文", "日语"), "ko": ("korean", "韩文", "韩语"), "ru": ("russian", "俄文", "俄语"),
}
_ASKS = re.compile(r"\b(?:translat\w*|answer|reply|respond|write|say|speak|explain|summari[sz]e|rewrite|rephrase)\b|翻译|译成|用|写成|改写|回答|回复")


def language_of(text: str) -> str | None:
    """Language of most of the text without code; null where there is too little to tell."""
    text = _FENCED.sub(" ", text)
    cjk, kana, hangul = len(_CJK.findall(text)), len(_KANA.findall(text)), len(_HANGUL.findall(text))
    words = [w.lower() for w in _WORD.findall(re.sub(r"[぀-鿿가-힯]", " ", text))]
    latin = [w for w in words if len(w) > 1 or w in ("a", "y", "e", "o")]
    if kana > 3 and kana * 3 > cjk:
        return "ja"
    if hangul > 3 and hangul > len(latin):
        return "ko"
    if cjk >= 4 and cjk >= 2 * len(latin):
        return "zh"
    for name, pattern in (("ru", _CYRILLIC), ("ar", _ARABIC)):
        if len(pattern.findall(text)) > 5 * max(1, len(latin)) ** 0.5:
            return name
    votes: dict[str, float] = {}
    for w in latin:
        for lang in _VOTES.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1 / len(_VOTES[w])
    if not votes or len(latin) < 4:
        return None
    best = max(votes, key=votes.get)
    second = max([v for k, v in votes.items() if k != best], default=0)
    return best if votes[best] >= 1.5 and votes[best] > second else None


_NAMED = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names}
_LATIN, _HAN = ("|".join(sorted((n for n in _NAMED if n.isascii() == ascii_), key=len, reverse=True)) for ascii_ in (True, False))
_ANY_NAME = re.compile(rf"\b(?:{_LATIN})\b|{_HAN}")
#: A request next to the name of a language: a preposition before it, a verb up to four words before it in the same sentence, or what is done in it.
_TIED = re.compile(
    rf"\b(?:in|into|to|en|al|auf|ins)\s+(?:(?:plain|simple|fluent|proper|good|clear|formal)\s+)?(?P<a>{_LATIN})\b"
    rf"|\b(?:translat\w*|answer|reply|respond|write|say|speak|use|using|give|explain|summari[sz]e)(?:[^\S\n]+[\w'’-]+){{0,4}}?[^\S\n]+(?P<b>{_LATIN})\b|\b(?P<c>{_LATIN})\s+(?:translation|version|only|please)\b"
    rf"|(?:用|译成|译为|译作|翻成|写成|改写|改成|改为|换成|转成|翻译|回答|回复)[^\S\n]*[为成到]?(?:简单|流利|标准|正式)?的?[^\S\n]*(?P<d>{_HAN}|{_LATIN})|(?P<e>{_HAN}|{_LATIN})(?:语|文)?[^\S\n]*(?:回答|作答|回复|答复|翻译|改写|写|说)"
)


def asked_language(question: str) -> str | None:
    """The language that the question's own words ask for: a request tied to the name, or a verb of asking and a name in one sentence. All of the question is read,
    and short and long questions are treated alike."""
    low = question.lower()
    if m := _TIED.search(low):
        return _NAMED[next(n for n in m.groups() if n)]
    if not _ANY_NAME.search(low):
        return None
    for m in _SENTENCE.finditer(low):
        s = m.group()
        if (name := _ANY_NAME.search(s)) and _ASKS.search(s):
            return _NAMED[name.group()]
    return None


def is_other_language(question: str, answer: str) -> bool:
    got = language_of(answer)
    if got is None:
        return False
    asked = asked_language(question)
    return got != asked if asked == language_of(question) and asked else asked is None and (own := language_of(question)) is not None and got != own


_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "“": "”", "「": "」", "『": "』"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_DONE = re.compile(r"[.!?。！？…|`\"'”’」』)）\]】}>~*;；]$")
_DANGLING = re.compile(r"(?:^|\n)\s*(?:\d+[.)、]|[-*•]|#+)\s*$|[:：,，、;；(（\[{=+\-/&]$")


def is_truncated(question: str, text: str) -> bool:
    """The text leaves something open: a code fence, a bracket, a table row, a list item, a sentence."""
    if text.count("```") % 2:
        return True
    plain = _FENCED.sub("\x00", text).rstrip()
    if plain.endswith("\x00"):
        return False  # ends with complete code
    if _DANGLING.search(plain):
        return True
    lines = plain.split("\n")
    if lines[-1].lstrip().startswith("|"):
        rows = [x for x in lines if x.lstrip().startswith("|")]
        return len(rows) < 3 or not rows[-1].rstrip().endswith("|") or rows[-1].count("|") < rows[0].count("|")
    stack: list[str] = []
    for ch in plain:
        if ch in _OPEN:
            stack.append(ch)
        elif ch in _CLOSE and stack and stack[-1] == _CLOSE[ch]:
            stack.pop()
    if stack:
        return True
    if plain.count('"') % 2:
        return True
    if _DONE.search(plain):
        return False
    last = lines[-1]
    # a bare name, number, yes or no is complete; a sentence without its end isn't
    return len(_CJK.findall(last)) > 8 or len(last.split()) > 4 or len(lines) > 1 or bool(re.search(r"[.!?。！？]\s*\S", plain))


def defect_of(question: str | None, answer: str | None) -> str | None:
    text = readable(answer)
    if is_empty(text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    asked = readable(question)
    if is_copy(asked, text):
        return "copy"
    if is_other_language(asked, text):
        return "language"
    if is_truncated(asked, text):
        return "truncated"
    return None


def find_defects(conversations: DataFrame) -> DataFrame:
    """(sample_id, turn, defect) of every defective pair, rows distinct.

    A pair is an assistant message with the user message directly before it, roles in any letter case and padded or not. Null, empty or blank
    contents of the answer are empty answers; a null question is an empty text; null messages and other roles form no pair; a null list has none.
    ``turn`` counts all messages from 0. Conversations delivered twice give their rows once. Whole texts are read, however long."""
    role = lambda c: F.lower(F.trim(c))
    pairs = (
        conversations.select("sample_id", F.col("messages").alias("m"))
        .where("m is not null")
        .select("sample_id", F.expr("transform(filter(transform(m, (x, i) -> struct(i as turn, x.role as role, x.content as answer, if(i > 0, try_element_at(m, i), null) as before)), p -> lower(trim(p.role)) in ('assistant', 'gpt') and lower(trim(p.before.role)) in ('user', 'human')), p -> struct(p.turn as turn, p.before.content as question, p.answer as answer))").alias("p"))
        .where(F.size("p") > 0)
        .select("sample_id", F.explode("p").alias("p"))
        .select("sample_id", F.col("p.turn").alias("turn"), F.col("p.question").alias("question"), F.col("p.answer").alias("answer"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, turns, out = [], [], []
            for i, (q, a) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                d = defect_of(q, a)
                if d is not None:
                    ids.append(b.column(0)[i].as_py())
                    turns.append(b.column(1)[i].as_py())
                    out.append(d)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(turns, pa.int32()), pa.array(out, pa.string())], names=["sample_id", "turn", "defect"])

    return pairs.mapInArrow(run, "sample_id string, turn int, defect string").distinct()


def defect_report(conversations: DataFrame) -> DataFrame:
    """Defects per source group; the group comes from the conversation, so each pair counts once."""
    groups = conversations.groupBy("sample_id").agg(F.min("source_group").alias("source_group"))
    return find_defects(conversations).join(groups, "sample_id", "left").groupBy("source_group", "defect").agg(F.count(F.lit(1)).alias("pairs"))
