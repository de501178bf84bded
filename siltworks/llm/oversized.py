"""Problem 3: splitting oversized items at natural boundaries.

A text above the limit is parsed into a structure tree: sections nested by the depth of their headings, blank-line paragraphs (fenced code stays whole as long
as it fits), list items nested by indentation, lines, sentences. Sibling subtrees are merged bottom-up while they fit together; only a node that is too
large itself is descended into, and its pieces never run into its siblings. A sentence above the limit is cut at commas, then spaces, then
anywhere. Each piece but the first starts with the last ``overlap`` characters of the piece before. Only rows above the limit reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 6000, 200
PIECES = "doc_id long, piece int, start long, end long, overlap int, forced_cut boolean, forced int, text string"
DEEPEST = 40  # lists nested deeper than this are siblings at this depth

_HEADING = re.compile(r"^(?:(#{1,6})[ \t]|(={1,6})[^=\n]+=+[ \t]*$|\\((?:sub)*)section\b|<h([1-6])\b)", re.M)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_FENCE = re.compile(r"^```.*?(?:^```[^\n]*\n?|\Z)", re.M | re.S)
_ITEM = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,9}[.)、])[ \t]+", re.M)
_LINE = re.compile(r"\n")
# what closes a sentence stays with it, but only a few characters of it: the rest belongs to the stretch that follows
_SENTENCE = re.compile(r"[.!?。！？]+[\"'”’」』)\]]{0,4}\s{0,4}")
_CLAUSE = re.compile(r"[,;:，、；：]\s*")
_SPACE = re.compile(r"\s+")
#: A natural boundary: a line feed or the end of a sentence.
_NATURAL = re.compile(r"[\n.!?。！？]")


@dataclass
class Node:
    """A span of the text and the inner nodes that start inside it, in order; what lies before the first of them is a leaf of its own."""

    lo: int
    depth: int
    hi: int = 0
    inner: list[Node] = field(default_factory=list)

    def parts(self) -> list[tuple[int, int, Node | None]]:
        """The span as adjacent parts: the opening text, if any, and each inner node."""
        out: list[tuple[int, int, Node | None]] = []
        first = self.inner[0].lo if self.inner else self.hi
        if first > self.lo:
            out.append((self.lo, first, None))
        out.extend((n.lo, n.hi, n) for n in self.inner)
        return out


def _nest(starts: list[tuple[int, int]], lo: int, hi: int) -> Node:
    """A tree of (position, depth): a node reaches up to the next one of the same or a lower depth."""
    root = Node(lo, -1)
    stack = [root]
    for at, depth in starts:
        while stack[-1].depth >= depth:
            stack.pop().hi = at
        node = Node(at, depth)
        stack[-1].inner.append(node)
        stack.append(node)
    for node in stack:
        node.hi = hi
    return root


def _fences(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _FENCE.finditer(text, lo, hi)]


def _outside(cuts: list[int], fences: list[tuple[int, int]]) -> list[int]:
    """The positions, in order, that lie in no fenced block."""
    out, k = [], 0
    for c in cuts:
        while k < len(fences) and fences[k][1] <= c:
            k += 1
        if not (k < len(fences) and fences[k][0] < c < fences[k][1]):
            out.append(c)
    return out


def sections(text: str, lo: int, hi: int) -> Node:
    """Sections by the depth of their headings; what looks like a heading inside fenced code isn't one."""
    found = {}
    for m in _HEADING.finditer(text, lo, hi):
        marks, equals, sub, tag = m.groups()
        found[m.start()] = len(marks) if marks else len(equals) if equals else int(tag) if tag else len(sub or "") // 3 + 1
    inside = _outside(sorted(found), _fences(text, lo, hi))
    return _nest([(at, found[at]) for at in inside], lo, hi)


def list_items(text: str, lo: int, hi: int) -> Node:
    """List items by their indentation; an item holds the lines up to the next item that isn't deeper."""
    starts = [(m.start(), min(len(m[1].expandtabs(4)), DEEPEST)) for m in _ITEM.finditer(text, lo, hi)]
    return _nest(starts, lo, hi)


def _flat(cuts: list[int], lo: int, hi: int) -> list[tuple[int, int]]:
    at = [lo, *(c for c in cuts if lo < c < hi), hi]
    return list(zip(at, at[1:], strict=False))


def _paragraphs(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    fences = _fences(text, lo, hi)
    ends = {m.end() for m in _PARAGRAPH.finditer(text, lo, hi)} | {e for f in fences for e in f}
    return _flat(_outside(sorted(ends), fences), lo, hi)


def _after(pattern: re.Pattern):
    return lambda text, lo, hi: _flat([m.end() for m in pattern.finditer(text, lo, hi)], lo, hi)


_LINES, _SENTENCES, _CLAUSES, _WORDS = (_after(p) for p in (_LINE, _SENTENCE, _CLAUSE, _SPACE))


class Packer:
    """Packs one text into spans of at most ``room``; ``widest`` is the longest stretch without a natural boundary that it had to cut."""

    def __init__(self, text: str, room: int):
        self.text, self.room = text, room
        self.widest = 0
        self.out: list[tuple[int, int, bool]] = []

    def spans(self) -> list[tuple[int, int, bool]]:
        """(start, end, cut) that cover the text; ``cut`` tells that the end of the span isn't natural."""
        if self.text:
            self._level(0, len(self.text), 0)
        return self.out

    def _merge(self, parts: list[tuple[int, int, object]], descend, forced: bool = False) -> None:
        """Adjacent siblings share a span while they fit; one that is too large alone goes to ``descend`` and shares with none.

        ``forced`` tells that the boundaries between these siblings aren't natural."""
        open_at = open_to = None
        last = parts[-1][1] if parts else 0
        for a, b, inner in parts:
            if open_at is not None and (b - a > self.room or b - open_at > self.room):
                self.out.append((open_at, open_to, forced and open_to != last))
                open_at = None
            if b - a > self.room:
                descend(a, b, inner)
                if forced and b != last and self.out:
                    self.out[-1] = (*self.out[-1][:2], True)
                continue
            open_at = a if open_at is None else open_at
            open_to = b
        if open_at is not None:
            self.out.append((open_at, open_to, forced and open_to != last))

    def _tree(self, node: Node, below) -> None:
        """A node of a heading or list tree that is too large: its parts, each with its own tree, are merged or descended into."""
        self._merge(node.parts(), lambda a, b, inner: below(a, b) if inner is None else self._tree(inner, below) if inner.inner else below(a, b))

    def _level(self, lo: int, hi: int, level: int) -> None:
        text, here = self.text, lambda a, b, _=None: self._level(a, b, level + 1)
        if hi - lo <= self.room:
            self.out.append((lo, hi, False))
        elif level == 0:
            self._tree(sections(text, lo, hi), here)
        elif level == 1:
            self._merge([(a, b, None) for a, b in _paragraphs(text, lo, hi)], here)
        elif level == 2:
            # inside a fenced block a line that starts like a list item is code
            fenced = text.startswith("```", lo)
            self._tree(Node(lo, -1, hi) if fenced else list_items(text, lo, hi), here)
        elif level in (3, 4):
            self._merge([(a, b, None) for a, b in (_LINES, _SENTENCES)[level - 3](text, lo, hi)], here)
        elif level in (5, 6):
            if level == 5:
                self.widest = max(self.widest, self._stretch(lo))
            self._merge([(a, b, None) for a, b in (_CLAUSES, _WORDS)[level - 5](text, lo, hi)], here, forced=True)
        else:
            at = [*range(lo, hi, self.room), hi]
            self.out.extend((a, b, b != hi) for a, b in zip(at, at[1:], strict=False))

    def _stretch(self, lo: int) -> int:
        """Length of the stretch without a natural boundary that a sentence node lies in: closing signs of the sentence before belong to it."""
        start = lo
        while start > 0 and not _NATURAL.match(self.text[start - 1]):
            start -= 1
        m = _NATURAL.search(self.text, lo)
        return (m.start() if m else len(self.text)) - start


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, bool]], bool]:
    """((start, end, overlap, cut) of the pieces, whether a stretch above the limit had to be cut).

    ``start`` counts the overlap in, so ``text[start:end]`` is the piece. Every piece but the first repeats exactly ``overlap`` characters (all that is
    before it where that is less): room for it is kept free in every piece."""
    packer = Packer(text, limit - overlap)
    spans = packer.spans()
    return [(a - min(overlap, a), b, min(overlap, a), cut) for a, b, cut in spans], packer.widest > limit


def split_oversized(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text above ``limit`` code points (whatever the recorded token counts say).

    Shorter, empty and null texts have no rows. ``forced`` is 1 for all pieces of a text of which the packer had to cut a stretch above the limit that
    offers no natural boundary, ``forced_cut`` marks the pieces that end at no natural boundary. Repeated ids are split independently."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "end", "overlap", "forced_cut", "forced", "text"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i in range(b.num_rows):
                doc, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                pieces, forced = split_text(text, limit, overlap)
                for k, (lo, hi, back, cut) in enumerate(pieces):
                    rows.append((doc, k, lo, hi, back, cut, int(forced), text[lo:hi]))
                    held += hi - lo
                    if held > 8_000_000:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names, kinds)

    return docs.select("doc_id", "text").where(F.length("text") > limit).mapInArrow(run, T._parse_datatype_string(PIECES))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def found(docs: DataFrame) -> DataFrame:
    """One row per oversized text: its first piece carries what the packer met in the whole tree."""
    return split_oversized(docs).where("piece = 0").select("doc_id", "forced")
