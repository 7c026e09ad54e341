"""Benchmark passages in documents, by pigeonhole pieces and Myers' bit-parallel edit distance.

An item with an error budget of k edits is split into k + 1 pieces; wherever it occurs with k edits or
fewer, one piece occurs exactly. The pieces are the leaves of a binary tree whose nodes share out the
budget, so a hit is verified upwards: a parent's text is searched with the parent's own budget around the
hit, and only if all ancestors hold is the whole item found. This rejects chance hits after a few steps and
loses nothing. All pieces are searched at once by Aho-Corasick.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import text_only

#: Edits that are allowed for each character of an item.
ERROR_RATE = 0.1
#: Characters of items that are broadcast at once; a larger benchmark is taken in so many blocks.
BLOCK_CHARS = 16_000_000
_MARKS = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    """Lower case; runs of anything but letters and digits are one space."""
    return _MARKS.sub(" ", (text or "").lower()).strip()


def edit_search(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in text where pattern ends with at most `most` edits, the first of equals."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


@dataclass
class Node:
    """A stretch of an item with its own budget; start is its place in the item."""

    item: int
    start: int
    text: str
    budget: int
    parent: Node | None


def pieces(item: int, text: str, budget: int) -> list[Node]:
    """The budget + 1 leaves of the item's tree, in order."""
    leaves: list[Node] = []

    def split(start: int, part: str, k: int, parent: Node | None) -> None:
        node = Node(item, start, part, k, parent)
        if k == 0:
            leaves.append(node)
            return
        # left + right + 1 = k: more errors than both budgets on both sides would be more than k in all
        left = (k - 1) // 2
        right = k - 1 - left
        cut = round(len(part) * (left + 1) / (k + 1))
        split(start, part[:cut], left, node)
        split(start + cut, part[cut:], right, node)

    split(0, text, budget, None)
    return leaves


class Matcher:
    """The pieces of some items, ready to search texts."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float):
        self.ids: list[object] = []
        places: dict[str, list[Node]] = {}
        for item_id, raw in items:
            text = normalize(raw)
            if not text:
                continue
            # a piece has at least four characters
            budget = min(int(rate * len(text)), len(text) // 4 - 1)
            for leaf in pieces(len(self.ids), text, max(0, budget)):
                places.setdefault(leaf.text, []).append(leaf)
            self.ids.append(item_id)
        self.automaton = ahocorasick.Automaton()
        for piece, nodes in places.items():
            self.automaton.add_word(piece, nodes)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, raw: str | None) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the normalised text) of every item that the text has: its best place, the first of equals."""
        text = normalize(raw)
        if self.empty or not text:
            return []
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, nodes in self.automaton.iter(text):
            for leaf in nodes:
                if found.get(leaf.item, (1, 0))[0] == 0:
                    continue
                at, node = end + 1 - len(leaf.text) - leaf.start, leaf.parent  # where the item would begin
                best = (0, end + 1)
                while node is not None:
                    if (key := (id(node), at)) in tried:  # another leaf has led here
                        best = None
                        break
                    tried.add(key)
                    lo = max(0, at + node.start - node.budget)
                    hi = at + node.start + len(node.text) + node.budget
                    best = edit_search(node.text, text[lo:hi], node.budget)
                    if best is None:
                        break
                    best = (best[0], lo + best[1])
                    node = node.parent
                if best is not None and (leaf.item not in found or best < found[leaf.item]):
                    found[leaf.item] = best
        return [(self.ids[i], *v) for i, v in found.items()]


@lru_cache(maxsize=2)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, position for each row of docs (doc_id, text) and item of benchmark (item_id, text) that it contains.

    An item occurs where its normalised text ends with at most rate * length edits (never more than leave
    pieces of four characters); distance is the least of any place, position the end of the first such
    place in the normalised document. Items without letters or digits occur nowhere, and neither do they
    in null or empty texts. Items with equal texts are reported each, repeated rows too; an empty table on
    either side gives no rows.
    """
    docs = text_only(docs, "doc_id", "text")
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("distance", T.LongType()), T.StructField("position", T.LongType())])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(tuple(sorted((tuple(r) for r in part.collect()), key=repr)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.find(t.as_py())]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "distance", "position"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item of the benchmark (see contamination); one pass for each block of items."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    at = docs.columns.index("text")
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(tuple(sorted((tuple(r) for r in part.collect()), key=repr)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
