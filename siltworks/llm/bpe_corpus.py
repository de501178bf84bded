"""Problem 8: encoding of the whole corpus with a public tokenizer.

All in Spark expressions: texts are cut into words by the vocabulary's own pattern, and further between ideographs where no piece of the vocabulary reaches
across. The distinct words of the corpus are folded once: higher-order functions merge the pair of bytes or pieces with the lowest rank until none is
in the literal rank map. A long word is folded window by window: a list of pieces is the encoding of its bytes exactly if each two neighbours are the encoding
of theirs, so a window that starts with the last pieces found and leaves the first of them as it was extends the encoding exactly; if it doesn't, it
starts further back. So the work is linear in the length of the word. The most frequent short words, at most ``CACHE_WORDS`` of at most ``CACHE_BYTES``, form a
second literal map by which texts become ids; any other word is folded where it stands, so the result is exact at every size. Decoding looks pieces up by id, joins their bytes and reads them as UTF-8.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.token_budget import text_batches
from siltworks.llm.tokenizers import BYTE_BPE, DEFAULT_DIR, batch_encoder, byte_encoder, read_ranks
from siltworks.operators.profiles import entropy_and_gini
from siltworks.runtime import Stage

CACHE_WORDS = 65_536  # bound of the literal word map, about 3 MB
CACHE_BYTES = 48  # longer words aren't in it, whatever their frequency
WINDOW = 48  # bytes by which a long word is folded on
BACK = (4, 16)  # pieces with which a window starts, the second number where the first doesn't do; then all
BUCKETS = 16_384
_HAN = (0x4E00, 0x9FFF)


def _char_class(chars: list[int], group: int = 18) -> str:
    """A regular expression class of code points, neighbours as ranges. A long list becomes groups behind the range they span, so that a test takes
    the number of groups plus the size of one, not all of them."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append((chars[i], chars[j]))
        i = j + 1

    def span(a: int, b: int) -> str:
        return f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"

    if len(out) <= group:
        return "[" + "".join(span(a, b) for a, b in out) + "]"
    groups = [out[i : i + group] for i in range(0, len(out), group)]
    return "[" + "".join(f"[{span(g[0][0], g[-1][1])}&&[{''.join(span(a, b) for a, b in g)}]]" for g in groups) + "]"


def uncut_pairs(ranks: dict[bytes, int]) -> list[tuple[list[int], list[int]]]:
    """Pairs of ideographs between which a piece of the vocabulary can reach: (possible first, possible second) per way it does so."""
    han = {c: chr(c).encode() for c in range(_HAN[0], _HAN[1] + 1)}
    spans = {(t[max(0, i - 3) : i], t[i : i + 3]) for t in ranks for i in range(1, len(t)) if 0xE4 <= t[i] <= 0xE9 and 0x80 <= t[i - 1] < 0xC0}
    # what a shorter pair covers need not be tested
    least = [(a, b) for a, b in spans if not any((a, b) != (x, y) and a.endswith(x) and b.startswith(y) for x, y in spans)]
    out = []
    for left, right in sorted(least):
        first = [c for c, b in han.items() if b.endswith(left[-3:])]
        second = [c for c, b in han.items() if b.startswith(right)]
        if first and second:
            out.append((first, second))
    return out


def unit_pattern(ranks: dict[bytes, int]) -> str:
    """The vocabulary's pattern as Java understands it, with runs of letters also cut between ideographs where that can't change the result."""
    han = f"[\\x{{{_HAN[0]:x}}}-\\x{{{_HAN[1]:x}}}]"
    # the following character is tested first: it is one range or a few characters, what precedes it can be hundreds
    together = "".join(f"(?!(?={_char_class(b)})(?<={_char_class(a)}))" for a, b in sorted(uncut_pairs(ranks), key=lambda x: len(x[0])))
    cut = f"(?={han})(?<={han}){together}"
    # letters come first, as no other branch can begin with one; white space is spelled out, as Java's own class is slow in its Unicode sense
    space = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    return rf" ?\p{{L}}(?:(?!{cut})\p{{L}})*+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}++| ?[^{space}\p{{L}}\p{{N}}]++|[{space}]+(?![^{space}])|[{space}]+"


def _literal(entries: dict[str, object], kind: str) -> Column:
    """A literal array of small maps, the map of a key found by its hash: constant folding makes it one value of the plan."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        buckets[xxhash.xxh64_intdigest(k.encode(), seed=42) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def _find(table: Column, key: Column) -> Column:
    at = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(table, at), key)


def _bytes_as_text(word: Column) -> Column:
    """Each byte as one character, so that string functions work on bytes."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class ByteBpe:
    """Expressions of one vocabulary."""

    def __init__(self, name: str = BYTE_BPE, folder: str = DEFAULT_DIR):
        ranks = read_ranks(name, folder)
        self.pattern = unit_pattern(ranks)
        self.pieces = [p.decode("latin-1") for p, _ in sorted(ranks.items(), key=lambda x: x[1])]
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks aren't 0, 1, 2, ...")
        self.rank = _literal({p: i for i, p in enumerate(self.pieces)}, "int")

    def units(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def _merged(self, whole: Column, rank: Column) -> Column:
        """Pieces of a short string of bytes by ranked merges; the ranks of neighbours are kept, so that a merge looks up two."""

        def step(state: Column, place: Column) -> Column:
            pieces, ranks = state["pieces"], state["ranks"]
            joined = F.concat(F.get(pieces, place - 1), F.get(pieces, place))

            def replaced(piece: Column) -> Column:
                left = F.when(place > 1, F.array(_find(rank, F.concat(F.get(pieces, place - 2), piece)))).otherwise(none)
                right = F.when(place + 1 < F.size(pieces), F.array(_find(rank, F.concat(piece, F.get(pieces, place + 1))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(pieces, F.lit(1), place - 1), F.array(piece), F.slice(pieces, place + 2, F.size(pieces))).alias("pieces"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(place - 2, F.lit(0))), left, right, F.slice(ranks, place + 2, F.size(pieces))).alias("ranks"),
                )

            return _let(joined, replaced)

        none = F.array().cast("array<int>")
        letters = F.split(whole, "")
        start = _let(letters, lambda p: F.struct(p.alias("pieces"), F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: _find(rank, F.concat(x, F.get(p, i + 1)))).alias("ranks")))
        steps = F.sequence(F.lit(1), F.greatest(F.length(whole) - 1, F.lit(1)))

        def merge(state: Column, _: Column) -> Column:
            # the first pair of the lowest rank; without one the state stays
            place = F.array_position(state["ranks"], F.array_min(state["ranks"])).cast("int")
            return _let(place, lambda p: F.when(F.coalesce(p, F.lit(0)) > 0, step(state, p)).otherwise(state))

        return F.aggregate(steps, start, merge, lambda s: s["pieces"])

    def _long(self, whole: Column, rank: Column) -> Column:
        """Pieces of a long string of bytes, window by window. State: finished pieces in lists, and the last ones, with which the next window can start."""
        chunks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
        most = BACK[-1]
        text = "array<string>"

        def onward(state: Column, chunk: Column) -> Column:
            last = state["last"]

            def attempt(back: tuple[int, ...]) -> Column:
                if not back:  # from the very start
                    return _let(F.concat(F.flatten(state["done"]), last), lambda all_: kept(F.array().cast(f"array<{text}>"), self._merged(F.concat(F.array_join(all_, ""), chunk), rank)))
                k = F.least(F.lit(back[0]), F.size(last))

                def opened(tail: Column) -> Column:
                    def judged(new: Column) -> Column:
                        # all pieces there are, or the first one again as it was
                        fits = ((F.size(tail) == F.size(last)) & (F.size(state["done"]) == 0)) | (F.get(new, F.lit(0)) == F.get(tail, F.lit(0)))
                        held = F.concat(F.slice(last, F.lit(1), F.size(last) - F.size(tail)), new)
                        return F.when(fits, kept(state["done"], held)).otherwise(attempt(back[1:]))

                    return _let(self._merged(F.concat(F.array_join(tail, ""), chunk), rank), judged)

                return _let(F.slice(last, F.size(last) - k + 1, k), opened)

            return attempt(BACK)

        def kept(done: Column, pieces: Column) -> Column:
            """All but the last pieces are finished."""
            return _let(pieces, lambda p: _let(F.greatest(F.size(p) - most, F.lit(0)), lambda n: F.struct(F.when(n > 0, F.concat(done, F.array(F.slice(p, F.lit(1), n)))).otherwise(done).alias("done"), F.slice(p, n + 1, F.size(p)).alias("last"))))

        start = F.struct(F.array().cast(f"array<{text}>").alias("done"), F.array().cast(text).alias("last"))
        return F.aggregate(chunks, start, onward, lambda s: F.concat(F.flatten(s["done"]), s["last"]))

    def fold(self, word: Column) -> Column:
        """Token ids of one word."""
        return self.folding(lambda fold: fold(word))

    def folding(self, body) -> Column:
        """``body(fold)`` with a ``fold`` for any number of words; the literal rank map stands in the plan once.

        A word that is a piece itself is that piece, else ranked merges over its bytes give its pieces."""

        def with_ranks(rank: Column) -> Column:
            def fold(word: Column) -> Column:
                def of(whole: Column) -> Column:
                    pieces = F.when(F.length(whole) <= 2 * WINDOW, self._merged(whole, rank)).otherwise(self._long(whole, rank))
                    return _let(_find(rank, whole), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(F.transform(pieces, lambda p: _find(rank, p))))

                return _let(_bytes_as_text(word), of)

            return body(fold)

        return _let(self.rank, with_ranks)

    def decode(self, ids: Column) -> Column:
        """Text of a list of ids; null stays null, an empty list is the empty text."""
        table = F.from_json(F.lit(json.dumps(self.pieces)), "array<string>")
        return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1"), "UTF-8")


def word_table(docs: DataFrame, bpe: ByteBpe, text: str = "text") -> DataFrame:
    """(word, documents, ids) of every distinct word: counted with map-side combining, folded once."""
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(bpe.units(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).select("word", "documents", bpe.fold(F.col("word")).alias("ids"))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """(key, ids) of every row, without special tokens. Null and empty texts get the empty list; special strings are ordinary text; repeated rows repeat."""
    bpe = ByteBpe(name, folder)
    st = Stage(docs.sparkSession, "bpe")
    table = st.keep(word_table(docs, bpe, text))
    top = table.where(F.octet_length("word") <= CACHE_BYTES).orderBy(F.desc("documents"), "word").limit(CACHE_WORDS).select("word", "ids").collect()
    cache = _literal({r["word"]: list(r["ids"]) for r in top}, "array<int>")
    ids = bpe.folding(lambda fold: _let(cache, lambda held: F.flatten(F.transform(bpe.units(F.col(text)), lambda u: F.coalesce(_find(held, u), fold(u))))))
    return docs.select(key, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")  # words of Latin letters: other scripts don't tell words by spaces
#: What is counted beside tokens, as negative numbers of tokens.
_COUNTS = {"texts": -1, "chars": -2, "bytes": -3, "words": -4, "word_pieces": -5, "whole_words": -6}


def token_counts(docs: DataFrame, by: str = "lang", text: str = "text", name: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """(by, token, n) of all tokens of all texts, summed per batch before anything is shuffled; negative tokens are the counts of :data:`_COUNTS`."""
    size = len(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, one = batch_encoder(name, folder), byte_encoder(name, folder)
        pieces: dict[str, int] = {}
        for b in batches:
            total: dict = {}
            groups = iter(b.column(0).to_pylist())
            for texts in text_batches(b.column(1)):
                for t, ids in zip(texts, encode(texts), strict=True):
                    n = total.setdefault(next(groups), np.zeros(size + len(_COUNTS), np.int64))
                    np.add.at(n, np.asarray(ids, np.int64), 1)
                    words = _WORD.findall(t)
                    for w in words:
                        if w not in pieces:
                            if len(pieces) > 100_000:
                                pieces.clear()
                            pieces[w] = len(one(" " + w))
                    split = [pieces.get(w) or len(one(" " + w)) for w in words]
                    n[size:] += (1, len(t), len(t.encode("utf-8", "surrogatepass")), len(words), sum(split), split.count(1))
            for group, n in total.items():
                used = np.flatnonzero(n)
                number = np.where(used < size, used, size - 1 - used)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(used), pa.string()), pa.array(number, pa.int32()), pa.array(n[used], pa.int64())], names=[by, "token", "n"])

    return docs.where(F.col(text).isNotNull()).select(by, text).mapInArrow(run, f"{by} string, token int, n long").groupBy(by, "token").agg(F.sum("n").alias("n"))


def token_profile(docs: DataFrame, by: str = "lang", text: str = "text", name: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """Quality of a vocabulary per group and (null) overall: texts, tokens, characters and bytes per token, pieces per word, share of words that are one piece, tokens used and
    their share of the vocabulary, entropy in bits, normalised entropy, Gini coefficient. Null texts don't count; an empty table has no rows."""
    size = len(read_ranks(name, folder))
    per = Stage(docs.sparkSession, "profile").keep(token_counts(docs, by, text, name, folder))
    both = per.unionByName(per.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit("all groups").alias(by), "token", "n")).withColumn(by, F.coalesce(by, F.lit("none")))
    counted = both.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("token") == v, F.col("n"))), F.lit(0)).alias(k) for k, v in _COUNTS.items()])
    spread = None
    for group in [r[0] for r in both.select(by).distinct().collect()]:  # a handful of languages
        one = entropy_and_gini(both.where((F.col(by) == group) & (F.col("token") >= 0)), "n").withColumn(by, F.lit(group))
        spread = one if spread is None else spread.unionByName(one)
    if spread is None:
        spread = entropy_and_gini(both, "n").withColumn(by, F.lit("")).limit(0)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return counted.join(spread.withColumnRenamed("total", "tokens"), by).select(
        by, "texts", "tokens", ratio("chars", "tokens").alias("chars_per_token"), ratio("bytes", "tokens").alias("bytes_per_token"), ratio("tokens", "texts").alias("tokens_per_text"),
        ratio("word_pieces", "words").alias("pieces_per_word"), ratio("whole_words", "words").alias("whole_word_share"), F.col("items").alias("used_tokens"),
        F.round(F.col("items") / size, 6).alias("utilisation"), "entropy_bits", "normalised_entropy", "gini",
    )
