"""Problem 6: same or near-same records across splits.

Texts are lower-cased with single spaces, once; records with equal text form one class, and all that follows is about classes: which class of evaluation texts is
linked with which class of training texts, how much of it is covered, and which document is in which class. Pairs of documents are expanded from that only where
they are asked for. Passages of the evaluation records, sharded into Aho-Corasick automata of
bounded size, scan the training texts; matched intervals are merged into the coverage of each evaluation record, and what passes the coverage that
0.8 similarity implies is settled by the exact Jaccard similarity of the 13-character substrings.

An automaton only scans the training texts routed to its shard, else the work would be shards times corpus. Routing is by prefix filtering: with
similarity 0.8 or more, the ``n - ceil(0.8 n) + m`` first substrings of both texts in one fixed order share at least ``m``, so no pair is lost; the order puts
substrings that are common in a bounded sample last, which changes the work and never the result. The substrings are dealt to ``g`` groups, the more the longer
the texts are, in one of which a similar pair must share at least ``m / g``, and in all of them ``m``; pairs that merely share a phrase mostly don't. The (substring,
class) entries travel as packed NumPy arrays, a few bytes each, split by size band and by group; a task holds the evaluation entries of its shard, a bounded number
at once, and lets the training entries stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import not_blank
from siltworks.llm.splits import canonical_split
from siltworks.runtime import Stage

GRAM, LEAST_CHARS, SIMILAR = 13, 60, 0.8
SAMPLE_DOCS = 2000  # bound of the sample that tells common substrings; only the order of the routing keys depends on it
COMMON_BITS = 22
MOST_GROUPS = 64  # groups of keys in a size band
EVAL_ENTRIES_PER_TURN = 6_000_000  # of 14 bytes while they are sorted
EVAL_CHARS_PER_CELL, TRAIN_CHARS_PER_CELL = 200_000, 3_000_000
MEMBERS_PER_CELL = 20_000
_P = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    # only runs that aren't a single space already are replaced
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all substrings of 13 code points, in order."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(cp) - GRAM + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(GRAM if n > 0 else 0):
        h *= np.uint64(0x100000001B3)
        h += cp[j : j + n]
    h ^= h >> np.uint64(32)
    h *= _P
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _level(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(h >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]


def common_table(texts: list[str]) -> np.ndarray:
    """How common each substring is in the sample: 0 below two texts, then the rounded-down logarithm of its texts, for a hashed slot the most common one."""
    table = np.zeros(1 << COMMON_BITS, np.uint8)
    if texts:
        h, n = np.unique(np.concatenate([np.unique(gram_hashes(t)) for t in texts]), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        np.maximum.at(table, (h >> np.uint64(64 - COMMON_BITS)).astype(np.int64), np.log2(n).astype(np.uint8) * 2 + (n >= 1.5 * 2 ** np.floor(np.log2(n))))
    return table


def must_share(n: np.ndarray | int) -> np.ndarray | int:
    """Substrings that two similar texts share among their routing keys, by the number of substrings of the smaller one."""
    return n * 6 // 100 + 1


def prefix_keys(text: str, table: np.ndarray) -> tuple[np.ndarray, int]:
    """The substrings of which two texts of similarity 0.8 or more share at least :func:`must_share`, and the number of all distinct ones."""
    h = np.unique(gram_hashes(text))
    n = len(h)
    k = n - -(-4 * n // 5) + must_share(n)
    order = (h >> np.uint64(5)) | (_level(h, table).astype(np.uint64) << np.uint64(59))
    return (h[np.argpartition(order, k - 1)[:k]] if k < n else h), n


def _members(docs: DataFrame) -> DataFrame:
    """Documents with a known split: side, parent, class of equal normalised text, its length and the text (all three null below 60 characters)."""
    split = canonical_split(F.col("split"))
    return (
        docs.select("doc_id", split.alias("known"), "source", F.when(not_blank(F.col("parent_document_id")), F.col("parent_document_id")).alias("parent"), F.explode(F.array(normalised(F.col("text")))).alias("norm"))
        .where("known is not null")
        .withColumn("norm", F.when(F.length("norm") >= LEAST_CHARS, F.col("norm")))
        .select("doc_id", "known", (F.col("known") == "train").alias("in_train"), "source", "parent", F.md5("norm").alias("cls"), F.length("norm").alias("n"), "norm")
    )


def _bands(n: np.ndarray) -> np.ndarray:
    """Size bands of factor 2."""
    return np.floor(np.log2(n)).astype(np.int64)


def groups_of(band: int) -> int:
    """Groups of keys in a size band. They follow the size of the texts and never that of the corpus: a pair must share several keys in one group, and
    with more groups that would come down to one, so that every pair with a phrase in common would be compared."""
    return 1 << min(max(band - 6, 0), MOST_GROUPS.bit_length() - 1)


def _entries(members: DataFrame, table: np.ndarray) -> DataFrame:
    """(shard, in_train, keys, numbers, classes, sizes): many documents per row; per entry 32 bits of the key and 16 of the number of its class within the row.

    A shard is a size band and a group of keys. Training classes are in the band of their size, the far fewer evaluation classes in each band in which a
    similar training class can be. All keys that a class has in a shard are in one row, or in several equal ones where tasks share a class."""
    shared = members.sparkSession.sparkContext.broadcast(table)  # 4 MB, whatever the corpus
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    names = ["shard", "in_train", "keys", "numbers", "classes", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        seen: dict[bool, set] = {True: set(), False: set()}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for side, got in held.items():
                if not got:
                    continue
                n = np.array([x[2] for x in got])
                low, high = (_bands(n), _bands(n)) if side else (_bands(np.maximum(1, np.floor(n * SIMILAR))), _bands(np.ceil(n / SIMILAR)))
                for band in range(int(low.min()), int(high.max()) + 1):
                    pick = [got[i] for i in np.flatnonzero((low <= band) & (band <= high))]
                    if not pick:
                        continue
                    k = np.concatenate([x[0] for x in pick])
                    classes, sizes = np.array([x[1] for x in pick], np.int64), np.array([x[2] for x in pick], np.uint32)
                    number = np.repeat(np.arange(len(pick), dtype=np.uint16), [len(x[0]) for x in pick])
                    group = (k % np.uint64(groups_of(band))).astype(np.uint8)
                    order = np.argsort(group, kind="stable")
                    k, number, group = (k[order] >> np.uint64(32)).astype(np.uint32), number[order], group[order]
                    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                    rows: list[tuple] = []
                    for a, b in zip(cut, np.append(cut[1:], len(group)), strict=True):
                        own, local = np.unique(number[a:b], return_inverse=True)
                        rows.append((band * MOST_GROUPS + int(group[a]), side, k[a:b].tobytes(), local.astype(np.uint16).tobytes(), classes[own].tobytes(), sizes[own].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                got.clear()
                seen[side].clear()

        for b in batches:
            side_col, cls_col, norm_col = b.column(0), b.column(1), b.column(2)
            for i in range(b.num_rows):
                side, cls = side_col[i].as_py(), cls_col[i].as_py()
                if cls in seen[side]:
                    continue
                seen[side].add(cls)
                keys, n = prefix_keys(norm_col[i].as_py(), shared.value)
                held[side].append((keys, cls, n))
                size += len(keys)
                if size > 1_500_000 or len(held[side]) > 60_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return members.where("norm is not null").select("in_train", F.xxhash64("cls").alias("c64"), "norm").mapInArrow(run, "shard long, in_train boolean, keys binary, numbers binary, classes binary, sizes binary")


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], t) for c, t in (("keys", np.uint32), ("numbers", np.uint16), ("classes", np.int64), ("sizes", np.uint32)))


class ShardIndex:
    """Evaluation entries of a shard in one sorted array of 8 bytes each: 32 bits of the key, then the rank of the class by size, so that the partners of similar
    size that have a key are one range."""

    def __init__(self, rows: list[tuple[np.ndarray, ...]]):
        classes, sizes = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        first = np.unique(classes, return_index=True)[1]  # one class can come from several tasks
        order = first[np.argsort(sizes[first], kind="stable")]
        self.names, self.sizes = classes[order], sizes[order].astype(np.int64)
        rank = np.full(len(classes), -1, np.int64)
        rank[order] = np.arange(len(order))
        self.entries = np.empty(sum(len(r[0]) for r in rows), np.uint64)
        at = done = 0
        while rows:  # each row is freed when it is in the array
            keys, numbers, own, _ = rows.pop()
            at += len(own)
            mine = rank[len(classes) - at : len(classes) - at + len(own)][numbers]
            kept = mine >= 0
            n = int(kept.sum())
            self.entries[done : done + n] = (keys[kept].astype(np.uint64) << np.uint64(32)) | mine[kept].astype(np.uint64)
            done += n
        self.entries = self.entries[:done]
        self.entries.sort()

    def pairs(self, keys: np.ndarray, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(e64, t64, shared, least) of different classes that share enough keys in this shard, for training entries ``keys`` of ``owner``, a position in ``classes``."""
        from_rank = np.searchsorted(self.sizes, np.ceil(sizes * SIMILAR - 1e-6), "left").astype(np.uint64)
        to_rank = np.searchsorted(self.sizes, np.floor(sizes / SIMILAR + 1e-6), "right").astype(np.uint64)
        order = np.argsort(keys)
        keys, owner = keys[order].astype(np.uint64) << np.uint64(32), owner[order]
        lo, hi = np.searchsorted(self.entries, keys | from_rank[owner], "left"), np.searchsorted(self.entries, keys | to_rank[owner], "left")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return
        # training classes in order, so that all keys of one pair are counted together
        hit = hit[np.argsort(owner[hit], kind="stable")]
        lo, n, owner = lo[hit], (hi - lo)[hit], owner[hit]
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
        total = np.cumsum(n)
        done = 0
        while done < len(hit):  # a million hits at a time, whole training classes
            upto = int(ends[min(len(ends) - 1, np.searchsorted(total[ends - 1], (total[done - 1] if done else 0) + 1_000_000))])
            m = n[done:upto]
            e = (self.entries[np.repeat(lo[done:upto] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            code, shared = np.unique(np.repeat(owner[done:upto], m) * len(self.names) + e, return_counts=True)
            t, e = code // len(self.names), code % len(self.names)
            least = must_share(np.minimum(sizes[t], self.sizes[e]))
            ok = (shared >= -(-least // groups)) & (self.names[e] != classes[t])
            yield self.names[e[ok]], classes[t[ok]], shared[ok], least[ok]
            done = upto


def _shared_keys(entries: DataFrame, turn: int, turns: int) -> DataFrame:
    """(e64, t64, shard, shared, least) of ``entries`` that are together by shard, evaluation before training: the evaluation entries of every ``turns``-th class
    are held, the training ones stream past them."""
    kinds = {"e64": pa.int64(), "t64": pa.int64(), "shard": pa.int64(), "shared": pa.int32(), "least": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = -1, None
        evals: list[tuple] = []
        trains: list[tuple] = []
        size = 0

        def match() -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0, *(len(r[2]) for r in trains)])
            owner = np.concatenate([r[1].astype(np.int64) + s for r, s in zip(trains, starts[:-1], strict=True)])
            keys, classes, sizes = (np.concatenate([r[i] for r in trains]) for i in (0, 2, 3))
            trains.clear()
            for found in index.pairs(keys, owner, classes, sizes.astype(np.int64), groups_of(shard // MOST_GROUPS)):
                cols = [*found[:2], np.full(len(found[0]), shard), *found[2:]]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            for i in range(b.num_rows):
                row = {c: v[i].as_py() for c, v in zip(b.schema.names, b.columns, strict=True)}
                if row["shard"] != shard:
                    if trains:
                        yield from match()
                    shard, index, size = row["shard"], None, 0
                    evals.clear()
                got = _unpack(row)
                if not row["in_train"]:
                    if turns > 1:
                        mine = (got[2] % turns == turn)[got[1]]
                        got = (got[0][mine], got[1][mine], *got[2:])
                    evals.append(got)
                    continue
                if index is None and evals:
                    index = ShardIndex(evals)
                if index is None or not len(index.entries):
                    continue
                trains.append(got)
                size += len(got[0])
                if size > 250_000:
                    yield from match()
                    size = 0
        if trains:
            yield from match()

    return entries.mapInArrow(run, "e64 long, t64 long, shard long, shared int, least int")


def _turns(members: DataFrame) -> int:
    """Times that the training entries have to stream past the evaluation entries of their shard, of which a task holds a bounded number at once."""
    n = F.col("n").cast("double")
    bands = F.sequence(F.floor(F.log2(F.floor(n * SIMILAR))).cast("int"), F.floor(F.log2(F.ceil(n / SIMILAR))).cast("int"))
    chars = members.where("not in_train and n is not null").select("n", F.explode(bands).alias("band")).groupBy("band").agg(F.sum("n")).collect()  # a row per power of 2
    return max([1, *(-(-int(0.27 * c) // (groups_of(b) * EVAL_ENTRIES_PER_TURN)) for b, c in chars)])


def _candidates(entries: DataFrame, turns: int) -> DataFrame:
    """Distinct (e64, t64) of different classes of similar size that share enough routing keys: in some group, and in all groups taken together, where a group in
    which too few are shared to be listed counts with the most that it can have."""
    placed = entries.repartition("shard").sortWithinPartitions("shard", "in_train")
    found = _shared_keys(placed, 0, turns)
    for turn in range(1, turns):
        found = found.unionAll(_shared_keys(placed, turn, turns))
    # a class that comes from several tasks gives equal rows
    each = found.repartition("e64", "t64").groupBy("e64", "t64", "shard").agg(F.max("shared").alias("shared"), F.max("least").alias("least"))
    per = each.groupBy("e64", "t64").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"), F.count(F.lit(1)).alias("listed"), F.max(F.floor(F.col("shard") / MOST_GROUPS)).alias("band"))
    groups = F.expr(f"shiftleft(1, cast(least(greatest(band - 6, 0), {MOST_GROUPS.bit_length() - 1}) as int))")
    return per.where(F.col("shared") + (groups - F.col("listed")) * (F.ceil(F.col("least") / groups) - 1) >= F.col("least")).select("e64", "t64")


def _passages(text: str) -> list[str]:
    """Every fourth of the distinct substrings in order of first appearance: more than 0.2 of them, so a similar text holds at least one."""
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))[::4]


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _coverage(text: str, passages: list[str], found: set[int], ids: dict[str, int]) -> float:
    """Share of the text inside merged matched intervals."""
    total = end = 0
    at = 0
    for p in passages:
        at = text.find(p, at)
        if ids[p] in found:
            total += at + GRAM - max(end, at)
            end = at + GRAM
    return total / len(text)


def scan_cell(evals: list[tuple[int, str]], trains: Iterator[tuple[int, str, list[int]]]) -> Iterator[tuple[int, int, float, float]]:
    """(e64, t64, similarity, coverage) of the similar pairs of one shard: one automaton, one scan of each training text."""
    import ahocorasick

    ids: dict[str, int] = {}
    passages = {e: _passages(text) for e, text in evals}
    automaton = ahocorasick.Automaton()
    for words in passages.values():
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
                automaton.add_word(w, ids[w])
    if not ids:
        return
    automaton.make_automaton()
    texts = dict(evals)
    id_sets = {e: {ids[w] for w in words} for e, words in passages.items()}
    gram_sets: dict[int, set[str]] = {}
    for t, text, wanted in trains:
        found = {i for _, i in automaton.iter(text)}
        own = None
        for e in wanted:
            hits = len(id_sets[e] & found)
            if not hits:
                continue
            if e not in gram_sets:
                gram_sets[e] = _grams(texts[e])
            n = len(gram_sets[e])
            if hits < len(passages[e]) - n // 5:
                continue
            own = _grams(text) if own is None else own
            both = len(gram_sets[e] & own)
            either = n + len(own) - both
            if both * 5 >= either * 4:
                yield e, t, both / either, _coverage(texts[e], passages[e], found, ids)


def similar_classes(members: DataFrame, st: Stage) -> DataFrame:
    """(e_cls, t_cls, similarity, coverage) for different classes of equal text, one with evaluation and one with training documents."""
    slim = members.select("doc_id", "in_train", "cls", "n")
    count = slim.count()
    sample = members.where("norm is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SAMPLE_DOCS))) == 0).select("norm").limit(2 * SAMPLE_DOCS)
    table = common_table([t for t in sample.toArrow()["norm"].to_pylist()])
    cand = st.keep(_candidates(_entries(members, table), _turns(slim)))
    involved = cand.select(F.col("e64").alias("c64")).union(cand.select(F.col("t64").alias("c64"))).distinct()
    reps = st.keep(slim.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).withColumn("c64", F.xxhash64("cls")).join(involved, "c64"))
    e, t = reps.select(F.col("c64").alias("e64"), F.col("n").alias("en")), reps.select(F.col("c64").alias("t64"), F.col("n").alias("tn"))
    # texts of very different lengths can't share enough; lengths bound the number of substrings only from above, so just one side is used
    total = cand.select("e64").distinct().join(e, "e64").agg(F.coalesce(F.sum("en"), F.lit(0))).first()[0]
    cells = max(1, int(total // EVAL_CHARS_PER_CELL))
    placed = cand.withColumn("cell", F.pmod(F.xxhash64("e64", F.lit(7)), F.lit(cells)))
    # a cell to which many training texts are routed is cut, its automaton being built once per cut
    load = placed.select("cell", "t64").distinct().join(t, "t64").groupBy("cell").agg(F.ceil(F.sum("tn") / TRAIN_CHARS_PER_CELL).cast("int").alias("cuts"))
    placed = st.keep(placed.join(load, "cell").withColumn("cut", F.pmod(F.xxhash64("t64", F.lit(9)), F.col("cuts"))))
    texts = st.keep(members.select("doc_id", "norm").join(reps.select("doc_id", "c64"), "doc_id").select("c64", "norm"))  # the narrow side is broadcast while it is small
    ev = placed.select("cell", "cut", F.col("e64").alias("c64")).distinct().join(texts, "c64").toDF("c64", "cell", "cut", "norm")
    tr = placed.groupBy("cell", "cut", F.col("t64").alias("c64")).agg(F.collect_list("e64").alias("wanted")).join(texts, "c64").toDF("c64", "cell", "cut", "wanted", "norm")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        evals = list(zip(left["c64"].to_pylist(), left["norm"].to_pylist(), strict=True))
        trains = ((c.as_py(), x.as_py(), w.as_py()) for c, x, w in zip(right["c64"], right["norm"], right["wanted"], strict=True))
        rows = list(scan_cell(evals, trains)) if evals else []
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(["e64", "t64", "similarity", "coverage"], cols, [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})

    found = st.keep(ev.groupBy("cell", "cut").cogroup(tr.groupBy("cell", "cut")).applyInArrow(run, "e64 long, t64 long, similarity double, coverage double"))
    name = reps.select("c64", "cls")
    return (
        found.join(name.withColumnRenamed("c64", "e64").withColumnRenamed("cls", "e_cls"), "e64")
        .join(name.withColumnRenamed("c64", "t64").withColumnRenamed("cls", "t_cls"), "t64")
        .select("e_cls", "t_cls", "similarity", "coverage")
    )


def _expand(links: DataFrame, ev: DataFrame, tr: DataFrame) -> DataFrame:
    """All (evaluation, training) document pairs of linked groups (eg, tg). A group with many training documents is cut into cells of bounded size and only
    its evaluation documents are repeated per cell, so no task holds an unbounded group."""
    cuts = tr.groupBy("tg").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_CELL).cast("int").alias("cuts"))
    wide = links.join(cuts, "tg").withColumn("cut", F.explode(F.expr("sequence(0, cuts - 1)")))
    slim = cuts.where("cuts > 1")
    salted = tr.join(slim, "tg", "left").withColumn("cut", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("t_id"), F.col("cuts"))).cast("int")).drop("cuts")
    return ev.join(wide.drop("cuts"), "eg").join(salted, ["tg", "cut"]).select("e_id", "t_id", "eg", "tg")


class Overlap:
    """Linked classes of one corpus. ``members`` (doc_id, known, in_train, source, parent, cls), ``links`` (eg, tg, similarity, coverage) between the class of
    evaluation texts ``eg`` and the class of training texts ``tg``, equal ones being linked with themselves at 1."""

    def __init__(self, docs: DataFrame):
        st = self.st = Stage(docs.sparkSession, "overlap")
        kept = st.keep(_members(docs))
        self.members = kept.drop("norm", "n")
        self.ev, self.tr = self.members.where("not in_train"), self.members.where("in_train")
        similar = similar_classes(kept, st)
        named = lambda d: d.where("cls is not null").select("cls").distinct()
        same = named(self.ev).join(named(self.tr), "cls").select("cls", F.col("cls").alias("tg"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
        self.links = st.keep(similar.select("e_cls", "t_cls", "similarity", "coverage").toDF("eg", "tg", "similarity", "coverage").union(same).groupBy("eg", "tg").agg(F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage")))

    def parents(self) -> DataFrame:
        """Parents on both sides."""
        named = lambda d: d.where("parent is not null").select("parent").distinct()
        return named(self.ev).join(named(self.tr), "parent")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b) of all linked documents, by text or by parent, each pair once."""
        links, ev, tr = self.links.select("eg", "tg"), self.ev, self.tr
        by_text = _expand(links, ev.select(F.col("doc_id").alias("e_id"), F.col("cls").alias("eg")), tr.select(F.col("doc_id").alias("t_id"), F.col("cls").alias("tg"))).select("e_id", "t_id")
        # every document is in one class, so pairs by text are distinct already; pairs by parent only add those whose classes aren't linked
        both = self.parents().select(F.col("parent").alias("eg"), F.col("parent").alias("tg"))
        by_parent = _expand(both, ev.select(F.col("doc_id").alias("e_id"), F.col("parent").alias("eg")), tr.select(F.col("doc_id").alias("t_id"), F.col("parent").alias("tg")))
        cls = self.members.select("doc_id", "cls")
        more = (
            by_parent.select("e_id", "t_id").join(cls.select(F.col("doc_id").alias("e_id"), F.col("cls").alias("eg")), "e_id").join(cls.select(F.col("doc_id").alias("t_id"), F.col("cls").alias("tg")), "t_id")
            .join(links, ["eg", "tg"], "left_anti").select("e_id", "t_id")
        )
        return by_text.unionByName(more).select(F.least("e_id", "t_id").alias("doc_a"), F.greatest("e_id", "t_id").alias("doc_b"))

    def classes(self) -> DataFrame:
        """One row per linked class of evaluation texts: its documents, linked training classes and their documents, best similarity, coverage by the training
        text that covers most of it."""
        size = lambda d, name, n: d.where("cls is not null").groupBy(F.col("cls").alias(name)).agg(F.count(F.lit(1)).alias(n))
        per = self.links.join(size(self.tr, "tg", "m"), "tg").groupBy("eg").agg(
            F.count(F.lit(1)).alias("train_classes"), F.sum("m").alias("train_documents"), F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage")
        )
        return per.join(size(self.ev, "eg", "documents"), "eg").select(F.col("eg").alias("text_class"), "documents", "train_classes", "train_documents", "similarity", "coverage")

    def report(self) -> DataFrame:
        """Per evaluation split and source: documents, those that also stand in train, their share, pairs, and the mean coverage of those with a similar text.

        Everything is counted by class, and by class and parent; no pair of documents is formed. A text linked only by its parent has no coverage."""
        total = self.ev.groupBy(F.col("known").alias("split_key"), "source").agg(F.count(F.lit(1)).alias("documents"))
        by_text = self.st.keep(self.classes())
        # parents on both sides, each with its classes and their documents; classes that are linked count as text
        groups = lambda d, *by: d.where("parent is not null").groupBy("parent", F.coalesce("cls", F.lit("")).alias("c"), *by).agg(F.count(F.lit(1)).alias("m"))
        e = groups(self.ev, "known", "source").join(self.parents(), "parent").withColumnRenamed("c", "eg").withColumnRenamed("m", "e_n")
        t = groups(self.tr).join(self.parents(), "parent").withColumnRenamed("c", "tg").withColumnRenamed("m", "t_n")
        extra = self.st.keep(e.join(t, "parent").join(self.links.select("eg", "tg"), ["eg", "tg"], "left_anti").groupBy("parent", "eg", "known", "source").agg(F.max("e_n").alias("e_n"), F.sum("t_n").alias("t_n")))
        texts = self.ev.join(by_text.select(F.col("text_class").alias("cls"), "train_documents", "coverage"), "cls")
        one = texts.groupBy(F.col("known").alias("split_key"), "source").agg(F.count(F.lit(1)).alias("linked"), F.sum("train_documents").alias("pairs"), F.sum("coverage").alias("covered"))
        two = extra.join(by_text.select(F.col("text_class").alias("eg"), F.lit(True).alias("counted")), "eg", "left").groupBy(F.col("known").alias("split_key"), "source").agg(
            F.sum(F.when(F.col("counted").isNull(), F.col("e_n")).otherwise(0)).alias("linked2"), F.sum(F.col("e_n") * F.col("t_n")).alias("pairs2")
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        on = lambda d: (total["split_key"] == d["split_key"]) & total["source"].eqNullSafe(d["source"])
        overlapping = zero(one["linked"]) + zero(two["linked2"])
        return total.join(one, on(one), "left").join(two, on(two), "left").select(
            total["split_key"], total["source"], total["documents"], overlapping.alias("overlapping"), F.round(overlapping / total["documents"], 6).alias("rate"),
            (zero(one["pairs"]) + zero(two["pairs2"])).alias("pairs"), F.round(one["covered"] / one["linked"], 6).alias("mean_coverage"),
        )


def cross_split_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), smaller id first: one of them in train, the other in validation or diagnostic, with the same parent or almost the same text.

    Documents without a known split take no part; null and blank parents are no parent; texts below 60 normalised characters (null and empty ones too) have no
    similar text; equal rows under several ids pair each. An empty table gives no pair."""
    return Overlap(docs).pairs()


def overlap_classes(docs: DataFrame) -> DataFrame:
    return Overlap(docs).classes()


def class_members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_class, split_key) of every document with a known split and at least 60 characters: the membership that goes with the classes."""
    return _members(docs).where("cls is not null").select("doc_id", F.col("cls").alias("text_class"), F.col("known").alias("split_key"))


def overlap_report(docs: DataFrame) -> DataFrame:
    return Overlap(docs).report()
