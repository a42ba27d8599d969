"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and every run of characters that are not
letters or digits becomes one space. An item of m characters may differ by
``m // CHARS_PER_ERROR`` edits. It is cut into that many pieces plus one: of
any k + 1 pieces, k edits leave one whole, so every match holds an exact piece
in about its place. Pieces are found by one Aho-Corasick pass over the whole
text, and the text around each hit is verified with Myers' bit-parallel
distance, in which an item is one machine integer of any length.

Items are a stated query set: they are broadcast in blocks of at most
``BLOCK_CHARS`` characters, each matched against all texts.

Defined cases: null or empty texts and items match nothing; repeated items and
rows each have their matches; a distance is the least over all places.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import tidy

CHARS_PER_ERROR = 20
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def budget(m: int) -> int:
    return m // CHARS_PER_ERROR


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of the error budget plus one nearly equal pieces."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any substring of the text."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(d | up))
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full  # a match may begin anywhere, so the top row adds nothing
        up = ((minus << 1) & full) | (full & ~(x | plus))
        down = plus & x
        if score < best:
            best = score
    return best


class ItemMatcher:
    """Items of one block, with the automaton of their pieces."""

    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick

        self.items = [(key, s) for key, s in ((k, normalised(t)) for k, t in items) if s]
        table: dict[str, list[tuple[int, int]]] = {}
        for i, (_, s) in enumerate(self.items):
            for offset, piece in pieces(s):
                table.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in table.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if table:
            self.automaton.make_automaton()
        self.empty = not table

    def matches(self, text: str) -> list[tuple[object, int]]:
        """(item key, least distance) of the items in a text, in the order of the items."""
        if self.empty or not text:
            return []
        s = normalised(text)
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, uses) in self.automaton.iter(s):
            for i, offset in uses:
                start = end + 1 - length - offset
                if best.get(i) == 0 or (i, start) in tried:
                    continue
                tried.add((i, start))
                item = self.items[i][1]
                k = budget(len(item))
                d = myers(item, s[max(0, start - k) : max(0, start + len(item) + k)])
                if d <= min(k, best.get(i, k)):
                    best[i] = d
        return [(self.items[i][0], best[i]) for i in sorted(best)]


def blocks_of(items: DataFrame):
    """Lists of (item_id, text) of at most BLOCK_CHARS characters (or one item)."""
    block, size = [], 0
    for r in items.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def _matcher(shared, cache={}):  # noqa: B006
    """The matcher of a broadcast block, built once per worker."""
    if shared.id not in cache:
        cache.clear()
        cache[shared.id] = ItemMatcher(shared.value)
    return cache[shared.id]


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and distance of every match."""
    spark = docs.sparkSession
    doc_kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int"
    out = spark.createDataFrame([], schema)
    for block in blocks_of(items):
        shared = _Shared(spark.sparkContext.broadcast(block))

        def run(batches, shared=shared):
            matcher = _matcher(shared)
            for batch in batches:
                rows = [
                    (d, key, n)
                    for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for key, n in matcher.matches(text or "")
                ]
                cols = list(zip(*rows)) if rows else [(), (), ()]
                kinds = [batch.schema.field("doc_id").type, pa.int64() if item_kind == "bigint" else None, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance"])

        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text matches no item."""
    spark = docs.sparkSession
    for block in blocks_of(items):
        shared = _Shared(spark.sparkContext.broadcast(block))

        def run(batches, shared=shared):
            matcher = _matcher(shared)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t or "") for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


class _Shared:
    """A broadcast with an id that survives pickling."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value
