"""Problem 10: abusive, hateful or sexual content.

A factorization machine over hashed terms (words and word pairs, Chinese characters with their pairs and triples) scores short stretches of text:
besides the weight of each term it learns an inner product for each pair of terms, so an insult next to a group or a person counts differently
from either alone. Labels are per document and noisy, so training alternates between fitting stretches and choosing, in each positive
document, those stretches that carry the label. A document's score is that of its worst stretch. The model is fitted on a bounded
sample of the labels, whose texts are turned into terms by the executors: the driver gets term numbers, never texts. All documents are scored in full,
with NumPy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_MAX = 12_000  # documented bounds of the training sample: documents in hash order of their id,
LABELLED_CHARS_MAX = 20_000_000  # and the characters of their texts
SLOT_BITS = 20
FACTORS = 6
BLOCK = 12  # tokens; a stretch is two neighbouring blocks of one sentence
CHUNK = 1_500_000  # characters featurised at once
THRESHOLD = 0.5
LABEL_NOISE = 0.06  # share of the documents labelled 0 that may score above the threshold
STRONG = 4.0  # evidence beyond which a stretch is chosen whatever the other half says
SMOOTHING, EVIDENCE = 2.0, 2.0  # of the first choice of stretches: pseudo-documents per term, log odds that a stretch must gather

# fixed values: letters of other scripts that look like Latin ones, and signs used in place of letters
_LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝɡαονρτυκικѵ", "aeopcyxijshdqwgaovptukikv", strict=True)) | {"@": "a", "$": "s", "€": "e"}
_DIGIT_LETTER = {"0": "o", "3": "e", "1": "i", "4": "a", "5": "s", "7": "t"}

_table: dict = {}


def _char_table() -> tuple[np.ndarray, np.ndarray]:
    """(character to folded character, class) for all code points: 0 other, 1 letter of a word, 2 ideograph, 3 end of a sentence, 4 white space, 5 dropped, 6 digit.

    Compatibility forms (full width, mathematical alphabets, enclosed letters) count as the letter they stand for."""
    if not _table:
        import unicodedata

        fold = np.arange(0x110000, dtype=np.uint32)
        kind = np.zeros(0x110000, np.uint8)
        # beyond the second plane there are only ideographs, of which some are compatibility forms
        kind[0x20000:0x40000] = 2
        for i in [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]:
            c = chr(i)
            n = unicodedata.normalize("NFKC", c).lower()
            n = n if len(n) == 1 else c.lower() if len(c.lower()) == 1 else c
            n = _LOOKALIKE.get(n, n)
            d = unicodedata.normalize("NFD", n)
            if len(d) > 1 and d[0].isascii():
                n = d[0]
            fold[i] = ord(n)
            cat = unicodedata.category(n)
            if cat in ("Cf", "Mn") or i == 0x00AD:
                kind[i] = 5
            elif 0x3400 <= ord(n) <= 0x9FFF or 0xF900 <= ord(n) <= 0xFAFF or 0x3040 <= ord(n) <= 0x30FF or 0x20000 <= ord(n) < 0x40000:
                kind[i] = 2
            elif n == "*" or n == "'" or cat[0] == "L":
                kind[i] = 1
            elif cat[0] == "N":
                kind[i] = 6
            elif c in ".!?。！？\n…":
                kind[i] = 3
            elif c.isspace():
                kind[i] = 4
        _table["t"] = (fold, kind)
    return _table["t"]


_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def featurise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each term, block of each term, sentence of each block, text of each block) of some texts together."""
    fold, kind = _char_table()
    raw = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(r) + 2 for r in raw])
    gap = np.array([10, 10], np.uint32)
    cp = np.concatenate([x for r in raw for x in (r, gap)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    k, c = kind[cp], fold[cp]
    keep = k != 5
    c, k, owner = c[keep], k[keep], owner[keep]
    # a sign between letters that stands for one: digits inside words
    for d, to in _DIGIT_LETTER.items():
        at = np.flatnonzero(c == ord(d))
        at = at[(at > 0) & (at < len(c) - 1)]
        at = at[(k[at - 1] == 1) | ((k[at + 1] == 1) & (k[at - 1] != 6))]
        c[at], k[at] = ord(to), 1
    # ends of sentences inside words or numbers aren't ends ("3.5", "sh!t")
    at = np.flatnonzero((k == 3) & (c < 128) & (c != 10))
    at = at[at < len(c) - 1]
    inside = (k[at + 1] == 1) | (k[at + 1] == 6)
    k[at[inside]] = 0
    # letters spelled out with spaces between them: a space with one lone letter on both sides goes
    sp = np.flatnonzero(k == 4)
    sp = sp[(sp > 1) & (sp < len(c) - 2)]
    lone = (k[sp - 1] == 1) & (k[sp + 1] == 1) & (k[sp - 2] != 1) & (k[sp + 2] != 1)
    gone = np.zeros(len(c), bool)
    gone[sp[lone]] = True
    # runs of one letter count once
    gone[1:] |= (c[1:] == c[:-1]) & (k[1:] == 1) & (k[:-1] == 1)
    c, k, owner = c[~gone], k[~gone], owner[~gone]
    isw = k == 1
    first = np.flatnonzero(isw & np.concatenate([[True], ~isw[:-1]]))
    last = np.flatnonzero(isw & np.concatenate([~isw[1:], [True]])) + 1
    ideo = np.flatnonzero(k == 2)
    num = np.flatnonzero((k == 6) & np.concatenate([[True], k[:-1] != 6]))
    end = np.flatnonzero(k == 3)
    at = np.concatenate([first, ideo, num])
    h = np.concatenate([_word_hash(c, first, last), _mix(c[ideo].astype(np.uint64) + np.uint64(1 << 40)), np.full(len(num), 77, np.uint64)])
    is_ideo = np.concatenate([np.zeros(len(first), bool), np.ones(len(ideo), bool), np.zeros(len(num), bool)])
    order = np.argsort(at, kind="stable")
    at, h, is_ideo = at[order], h[order], is_ideo[order]
    if not len(at):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    sentence = np.searchsorted(end, at)
    new = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    pos = np.arange(len(at)) - start
    block = np.cumsum(new | (pos % BLOCK == 0)) - 1
    firsts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    same = sentence[1:] == sentence[:-1]
    i2 = np.flatnonzero(same)
    bi = _mix(h[i2] * np.uint64(3) + h[i2 + 1] * np.uint64(0x51ED27))
    i3 = i2[:-1][(i2[1:] == i2[:-1] + 1)] if len(i2) > 1 else i2[:0]
    i3 = i3[is_ideo[i3] & is_ideo[i3 + 1] & is_ideo[i3 + 2]]
    tri = _mix(h[i3] * np.uint64(5) + h[i3 + 1] * np.uint64(0x51ED27) + h[i3 + 2] * np.uint64(0x2545F4914F6CDD1D))
    shift = np.uint64(64 - SLOT_BITS)
    slots = np.concatenate([_mix(h) >> shift, bi >> shift, tri >> shift]).astype(np.int64)
    where = np.concatenate([block, block[i2], block[i3]])
    return slots, where, sentence[firsts], owner[at[firsts]]


def _word_hash(c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run c[first:last], the same wherever it stands: a polynomial over all its letters, for all words at once."""
    size = last - first
    if not len(size):
        return np.zeros(0, np.uint64)
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    letters = _mix(c[np.repeat(first, size) + place].astype(np.uint64) + np.uint64(0x9E37))
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]))
    return _mix(np.add.reduceat(letters * power[place], start) + size.astype(np.uint64))


class Model:
    """Fitted machine: ``slot_row`` maps a hash slot to its row (0: never seen), ``weight`` and ``factor`` hold the rows."""

    def __init__(self, slot_row: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.slot_row, self.weight, self.factor, self.bias = slot_row, weight, factor, bias

    def block_sums(self, slots: np.ndarray, where: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = self.slot_row[slots]
        hit = np.flatnonzero(row)
        row, where = row[hit], where[hit]
        lin = np.bincount(where, self.weight[row], blocks)
        s = np.stack([np.bincount(where, self.factor[row, f], blocks) for f in range(FACTORS)], 1)
        q = np.bincount(where, (self.factor**2).sum(1)[row], blocks)
        return lin, s, q

    def stretch_scores(self, slots: np.ndarray, where: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Logit of each block with the block after it, where that belongs to the same sentence."""
        lin, s, q = self.block_sums(slots, where, len(sentence))
        if len(sentence) > 1:
            nxt = np.flatnonzero(sentence[1:] == sentence[:-1])
            l2, s2, q2 = lin.copy(), s.copy(), q.copy()
            l2[nxt] += lin[nxt + 1]
            s2[nxt] += s[nxt + 1]
            q2[nxt] += q[nxt + 1]
            lin, s, q = l2, s2, q2
        return self.bias + lin + 0.5 * ((s**2).sum(1) - q)

    def document_scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the worst stretch of each text; 0 for a text without any token."""
        out = np.full(len(texts), -30.0)
        slots, where, sentence, owner = featurise(texts)
        if len(sentence):
            np.maximum.at(out, owner, self.stretch_scores(slots, where, sentence))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR (slots, bounds) of the stretches of all texts and the text each belongs to; pieces of bounded size at a time."""
    all_slots, counts, owners = [], [], []
    for lo, hi in _chunks([len(t) for t in texts]):
        slots, where, sentence, owner = featurise(texts[lo:hi])
        if not len(sentence):
            continue
        order = np.argsort(where, kind="stable")
        slots, where = slots[order], where[order]
        bound = np.searchsorted(where, np.arange(len(sentence) + 1))
        joined = np.zeros(len(sentence), bool)
        joined[:-1] = sentence[1:] == sentence[:-1]
        upto = np.where(joined, np.concatenate([bound[2:], bound[-1:]]), bound[1:])
        # the last block of a long sentence alone repeats what the stretch before it holds
        alone = np.ones(len(sentence), bool)
        alone[1:] = ~joined[:-1] | joined[1:]
        pick = np.flatnonzero(alone)
        size = upto[pick] - bound[pick]
        idx = np.repeat(bound[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        all_slots.append(slots[idx])
        counts.append(size)
        owners.append(owner[pick] + lo)
    if not counts:
        z = np.zeros(0, np.int64)
        return z, np.zeros(1, np.int64), z
    return np.concatenate(all_slots), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(owners)


def _chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def fit(texts: list[str], labels: list[int], **options) -> Model:
    """Fits on documents with labels 0 or 1; see :func:`fit_stretches`."""
    slots, bound, owner = _stretches(list(texts))
    return fit_stretches(slots.astype(np.int32), np.diff(bound).astype(np.int32), owner.astype(np.int32), np.asarray(labels, np.int64), **options)


def _document_frequencies(slots: np.ndarray, sizes: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents with each term, positive ones among them), some documents at a time; ``owner`` is sorted."""
    df, hits = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
    bound = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    edges = np.searchsorted(owner, np.arange(0, len(y) + 256, 256))
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            pairs = np.unique(np.repeat(owner[lo:hi].astype(np.int64), sizes[lo:hi]) * (1 << SLOT_BITS) + slots[bound[lo] : bound[hi]])
            term, doc = pairs & ((1 << SLOT_BITS) - 1), pairs >> SLOT_BITS
            np.add.at(df, term, 1)
            np.add.at(hits, term, y[doc])
    return df, hits


def fit_stretches(slots: np.ndarray, sizes: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 6, least: int = 3, seed: int = 1, factors: bool = True) -> Model:
    """Fits on stretches of documents: their terms in a row, terms per stretch, document of each stretch (in order), label of each document.

    Terms found in fewer than ``least`` documents are left out. Without a positive and a negative document the model says 0 for everything. ``factors`` false
    leaves the interactions out, which shows what they add.

    Which stretches of the positive documents carry the label is first read off smoothed log odds of the terms (a term that few documents support
    counts little, so names don't matter), then off the machine itself. Positive documents whose label no stretch explains are left out;
    stretches of negative documents all count, so that what also stands in clean texts is unlearned."""
    slot_row = np.zeros(1 << SLOT_BITS, np.int32)
    if not len(owner) or y.sum() == 0 or y.sum() == len(y):
        return Model(slot_row, np.zeros(1), np.zeros((1, FACTORS)), -30.0)
    df, hits = _document_frequencies(slots, sizes, owner, y)
    prior = y.mean()
    # the document itself doesn't count as evidence for its own stretches, so what stands in one mislabelled document proves nothing
    p = (hits - 1 + SMOOTHING * prior) / (df - 1 + SMOOTHING)
    # against even odds: what is merely commoner in a rough forum doesn't count
    odds = np.where((df >= least) & (p > 0.6), np.log(np.maximum(p, 1e-9) / np.maximum(1 - p, 1e-9)), 0.0).astype(np.float32)
    seen = np.flatnonzero(df >= least)
    slot_row[seen] = np.arange(1, len(seen) + 1)
    # rare terms are dropped for good
    known = slot_row[slots] > 0
    at = np.repeat(np.arange(len(owner), dtype=np.int32), sizes)[known]
    slots = slots[known]
    del known
    rows = slot_row[slots]
    bound = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(owner)))])
    logit = np.bincount(at, odds[slots], len(owner)) - EVIDENCE
    rng = np.random.default_rng(seed)
    # clean stretches are alike: those that share no suspicious term are thinned to one in four
    plain = np.bincount(at, (p > 0.35)[slots], len(owner)) == 0
    del at, slots
    thinned = plain & (rng.random(len(owner)) > 0.25)
    half = (np.bitwise_xor(np.arange(len(y)), np.arange(len(y)) >> 3) & 1)[owner]

    def train(logit: np.ndarray, part: np.ndarray) -> Model:
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, logit)
        chosen = (y[owner] == 1) & (logit > 0)
        unexplained = (y[owner] == 1) & (best[owner] <= 0)
        mass = np.where(part & ~unexplained & ~(thinned & ~chosen), 1.0, 0.0)
        if not (chosen & part).any():
            chosen, mass = (y[owner] == 1) & (logit >= best[owner]), part.astype(float)
        return _fit_rows(rows, bound, chosen.astype(float), mass, len(seen) + 1, slot_row, epochs, rng, factors=factors)

    # each half's stretches are chosen by the machine of the other half
    crossed = np.empty(len(owner))
    for side in (0, 1):
        got = _score_rows(train(logit, half != side), rows, bound)
        crossed[half == side] = got[half == side]
    model = train(np.maximum(crossed, logit - STRONG), np.ones(len(owner), bool))
    # with few labels the machine of one half flags many clean documents of the other; the bias is lowered until it flags no more than the labels are wrong
    best = np.full(len(y), -30.0)
    np.maximum.at(best, owner, crossed)
    model.bias -= max(0.0, float(np.quantile(best[y == 0], 1 - LABEL_NOISE)))
    return model


def _score_rows(m: Model, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    out = np.empty(len(bound) - 1)
    for lo in range(0, len(out), 20_000):
        hi = min(lo + 20_000, len(out))
        r = rows[bound[lo] : bound[hi]]
        w = np.repeat(np.arange(hi - lo), np.diff(bound[lo : hi + 1]))
        s = np.stack([np.bincount(w, m.factor[r, f], hi - lo) for f in range(FACTORS)], 1)
        out[lo:hi] = m.bias + np.bincount(w, m.weight[r], hi - lo) + 0.5 * ((s**2).sum(1) - np.bincount(w, (m.factor[r] ** 2).sum(1), hi - lo))
    return out


def _fit_rows(rows, bound, target, mass, n_rows, slot_row, epochs, rng, rate=0.08, l2=1e-4, batch=1024, factors=True) -> Model:
    """Adaptive gradient descent on the logistic loss of stretches; row 0 (unknown terms) stays 0."""
    weight, factor = np.zeros(n_rows), rng.normal(0, 0.02, (n_rows, FACTORS))
    factor[0] = 0
    if not factors:
        factor[:] = 0
    gw, gf = np.full(n_rows, 1e-3), np.full((n_rows, FACTORS), 1e-3)
    live = np.flatnonzero(mass > 0)
    share = max(1e-3, (target[live] * mass[live]).sum() / max(1.0, mass[live].sum()))
    bias, gb = float(np.log(share / (1 - share))) if share < 1 else 0.0, 1e-3
    up = min(3.0, max(1.0, 0.25 / share))  # positive stretches are rare
    for _ in range(epochs):
        rng.shuffle(live)
        for at in range(0, len(live), batch):
            pick = live[at : at + batch]
            size = bound[pick + 1] - bound[pick]
            idx = np.repeat(bound[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r, w = rows[idx], np.repeat(np.arange(len(pick)), size)
            ok = r > 0
            r, w = r[ok], w[ok]
            v = factor[r]
            s = np.stack([np.bincount(w, v[:, f], len(pick)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(w, weight[r], len(pick)) + 0.5 * ((s**2).sum(1) - np.bincount(w, (v**2).sum(1), len(pick)))
            t = target[pick]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * mass[pick] * np.where(t > 0, up, 1.0) / 16
            u, inv = np.unique(r, return_inverse=True)
            dw = np.bincount(inv, g[w], len(u)) + l2 * weight[u]
            cross = g[w][:, None] * (s[w] - v)
            df = np.stack([np.bincount(inv, cross[:, f], len(u)) for f in range(FACTORS)], 1) + l2 * factor[u]
            gw[u] += dw**2
            weight[u] -= rate * dw / np.sqrt(gw[u])
            if factors:
                gf[u] += df**2
                factor[u] -= 0.5 * rate * df / np.sqrt(gf[u])
            db = g.sum()
            gb += db**2
            bias -= rate * db / np.sqrt(gb)
    return Model(slot_row, weight, factor, bias)


def training_labels(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MAX, most_chars: int = LABELLED_CHARS_MAX) -> list[tuple[int, int]]:
    """(doc_id, label) of the training sample: documents in hash order of the id, at most ``most`` and as long as their texts sum to at most ``most_chars``.

    Null labels and labels other than 0 and 1 are left out, repeated rows of one annotator count once, the majority decides, a tie decides nothing."""
    votes = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "annotator", "toxic").distinct()
    agreed = votes.groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))
    few = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lengths = docs.where("text is not null").select("doc_id", F.length("text").alias("n")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.sum("n").alias("n"))
    out, total = [], 0
    for r in lengths.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        total += r["n"]
        if total > most_chars:
            break
        out.append((r["doc_id"], r["y"]))
    return out


def training_stretches(docs: DataFrame, sample: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, terms per stretch, document of each stretch, labels) of the sampled documents, featurised on the executors, documents in order of id."""
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sample, "doc_id long, y int"))  # at most LABELLED_MAX rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, y in zip(b.column(0), b.column(1), b.column(2), strict=True):
                slots, bound, _ = _stretches([text.as_py()])
                rows.append((doc.as_py(), y.as_py(), slots.astype(np.int32).tobytes(), np.diff(bound).astype(np.int32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["doc_id", "y", "slots", "sizes"])

    got = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, slots binary, sizes binary").toArrow()
    slots, sizes = ([np.frombuffer(x.as_buffer() or b"", np.int32) for x in got[name]] for name in ("slots", "sizes"))
    keys = list(zip(got["doc_id"].to_pylist(), map(len, slots), map(len, sizes), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    labels = np.array(got["y"].to_pylist(), np.int64)[order] if order else np.zeros(0, np.int64)
    none = np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(order), dtype=np.int32), [len(sizes[i]) for i in order]) if order else none
    return np.concatenate([none, *[slots[i] for i in order]]), np.concatenate([none, *[sizes[i] for i in order]]), owner, labels


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``toxicity`` in [0, 1] of every row; null and empty texts get 0. Whole texts are scored."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slot_row, model.weight.astype(np.float32), model.factor.astype(np.float32), model.bias))  # at most 2**20 slots and as many rows
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", toxicity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            column = b.column(len(keep))
            out = np.zeros(b.num_rows)
            for lo, hi in _chunks(pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_pylist()):
                out[lo:hi] = m.document_scores([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.float64())], names=[*keep, "toxicity"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def trained_model(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MAX) -> Model:
    sample = training_labels(docs, labels, most)
    return fit_stretches(*training_stretches(docs, sample))


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, trained_model(docs, labels)).where(F.col("toxicity") >= THRESHOLD).select("doc_id")


def source_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, documents above the threshold and their rate per source (null sources form one group)."""
    scored = score(docs, trained_model(docs, labels), ("doc_id", "source"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("toxicity") >= THRESHOLD).cast("long")).alias("flagged"), F.round(F.avg((F.col("toxicity") >= THRESHOLD).cast("double")), 6).alias("rate"), F.round(F.avg("toxicity"), 6).alias("mean_score"))
