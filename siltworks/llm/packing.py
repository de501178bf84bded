"""Problem 9: filling fixed-capacity containers.

Bounded-space online packing: each partition keeps a fixed number of open windows, puts an item into the open window that it fits best, and when it
fits none emits the fullest one and opens a new window. What is still open at the end of a partition is merged with that of other partitions in a
second, far smaller pass over (window, size) rows. Nothing is sorted or shuffled by size; memory per task is the open windows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.token_budget import COUNT, count_tokens
from siltworks.llm.tokenizers import BYTE_BPE, DEFAULT_DIR
from siltworks.runtime import Stage

CAPACITY, OPEN = 2048, 64
LEFTOVERS_PER_TASK = 200_000
PLACED = "container_id string, doc_id long, part int, start long, n_tokens int, sealed boolean"


class Windows:
    """At most ``limit`` open windows ordered by free room; ``put`` returns the window an item went to and those it closed."""

    def __init__(self, capacity: int, limit: int, name: str):
        self.capacity, self.limit, self.name = capacity, limit, name
        self.room: list[tuple[int, int]] = []  # (free room, number), sorted
        self.made = 0

    def put(self, size: int) -> tuple[int, list[int]]:
        """The window of an item of 1 to ``capacity``, and the windows that are closed by it: full ones and the one that makes room."""
        if size == self.capacity:  # fills a window alone, the open ones stay open
            self.made += 1
            return self.made - 1, [self.made - 1]
        at = bisect.bisect_left(self.room, (size, -1))
        sealed = []
        if at < len(self.room):
            free, w = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                sealed.append(self.room.pop(0)[1])
            free, w, self.made = self.capacity, self.made, self.made + 1
        if free == size:
            sealed.append(w)
        else:
            bisect.insort(self.room, (free - size, w))
        return w, sealed


def place_items(sizes: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN, run_id: str = "a") -> DataFrame:
    """One row per placed piece of (doc_id, n_tokens) rows: container, part of the document, first token, tokens, and whether the container is closed.

    Items above the capacity fill whole containers with their first parts, only the rest is packed. Items of size 0 or null take no room: they
    have a null container. Repeated rows are packed each for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = f"{run_id}{TaskContext.get().partitionId():07d}-"
        win = Windows(capacity, open_windows, prefix)
        inside: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        whole = 0
        for b in batches:
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not n or n < 0:
                    out.append((None, doc, 0, 0, 0, True))
                    continue
                part = 0
                while n - part * capacity > capacity:
                    out.append((f"{prefix}w{whole}", doc, part, part * capacity, capacity, True))
                    whole += 1
                    part += 1
                start = part * capacity
                w, sealed = win.put(n - start)
                inside.setdefault(w, []).append((doc, part, start, n - start))
                for closed in sealed:
                    out.extend((f"{prefix}{closed}", *item, True) for item in inside.pop(closed))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        for w, items in inside.items():
            out.extend((f"{prefix}{w}", *item, False) for item in items)
        if out:
            yield _batch(out)

    return sizes.select("doc_id", "n_tokens").mapInArrow(run, PLACED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("container_id", pa.string()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("sealed", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def merge_leftovers(windows: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN) -> DataFrame:
    """(container_id, merged_id) for (container_id, used) rows of windows that were open at the end of their partition: packed again, best fit, windows being the items."""
    tasks = max(1, -(-windows.count() // LEFTOVERS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = f"m{TaskContext.get().partitionId():07d}-"
        win = Windows(capacity, open_windows, prefix)
        for b in batches:
            ids = b.column(0).to_pylist()
            to = [f"{prefix}{win.put(u)[0]}" for u in b.column(1).to_pylist()]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(to, pa.string())], names=["container_id", "merged_id"])

    # large windows first within each task, the order in which best fit wastes least
    spread = windows.select("container_id", F.col("used").cast("int").alias("used")).repartition(tasks, F.xxhash64("container_id")).sortWithinPartitions(F.desc("used"), "container_id")
    return spread.mapInArrow(run, "container_id string, merged_id string")


def pack(sizes: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN) -> DataFrame:
    """(container_id, doc_id, part, start, n_tokens): every piece of every item, each container filled up to ``capacity`` at most."""
    st = Stage(sizes.sparkSession, "packing")
    placed = st.keep(place_items(sizes, capacity, open_windows))
    left = st.keep(placed.where("not sealed").groupBy("container_id").agg(F.sum("n_tokens").alias("used")))
    merged = merge_leftovers(left, capacity, open_windows)
    shared = placed.where("not sealed").join(merged, "container_id").select(F.col("merged_id").alias("container_id"), "doc_id", "part", "start", "n_tokens")
    return placed.where("sealed").select("container_id", "doc_id", "part", "start", "n_tokens").unionByName(shared)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN, tokenizer: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """Null and empty texts have size 0 and a null container."""
    counted = count_tokens(docs.select("doc_id", "text"), keep=["doc_id"], tokenizer=tokenizer, folder=folder)
    return pack(counted.select("doc_id", F.col(COUNT).alias("n_tokens")), capacity, open_windows)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / F.count(F.lit(1)) / capacity, 6).alias("fill"))
