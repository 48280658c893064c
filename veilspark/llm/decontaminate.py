"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space runs become one space.  An item of ``m`` characters may differ
from a passage by ``k = floor(rate * m)`` edits.  It is split into ``k + 1`` pieces: whatever k edits do, one piece is
left whole, so every passage within the budget holds an exact piece.  One Aho-Corasick automaton finds
the pieces of a block of items in one pass over each whole text; around each hit Myers' bit-parallel search
finds the least edit distance, and the passage counts if that is at most k.

Items are handled in blocks of bounded size, each broadcast on its own; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches, giving_back


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal lengths; at most one a character."""
    n = min(k + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)] if n else [0]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and the first end at which it occurs."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds a block of items (item_id, normalised text) in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for x, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((x, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end) for each item that the text holds: its nearest passage, the first of equals."""
        if not self.items or not text:
            return
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for x, offset in at:
                starts.setdefault(x, set()).add(end + 1 - size - offset)
        for x in sorted(starts):
            item, pattern, k = self.items[x]
            exact = text.find(pattern)
            if exact >= 0:
                yield item, 0, k, exact + len(pattern)
                continue
            best, end, low, high = k + 1, 0, None, None
            for s in [*sorted(starts[x]), None]:  # windows that overlap are searched once
                if low is not None and (s is None or s - k > high):
                    a = max(0, low)
                    distance, stop = myers(pattern, text[a:high])
                    if distance < best:
                        best, end = distance, a + stop
                    low = None
                if s is not None:
                    low = s - k if low is None else low
                    high = s + len(pattern) + k
            if best <= k:
                yield item, best, k, end


def item_blocks(benchmark: DataFrame, characters: int = 2_000_000) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's normalised items in blocks of about so many characters; null and blank items are left out."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        block.append((row.item_id, text))
        size += len(text)
        if size >= characters:
            yield block
            block, size = [], 0
    if block:
        yield block


_built: dict[tuple[str, float], Matcher] = {}


def _share(spark: SparkSession, block: list[tuple[int, str]]):
    """The block, broadcast under a name of its own: addresses and counters can come again in a reused worker."""
    return spark.sparkContext.broadcast((uuid4().hex, block))


def _matcher(shared, rate: float) -> Matcher:
    """One automaton for each block, rate and worker process."""
    name, block = shared.value
    if (name, rate) not in _built:
        _built.clear()
        _built[name, rate] = Matcher(block, rate)
    return _built[name, rate]


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, item_id, distance, budget, ends_at): one row for each document row and item that it holds within the budget.

    ends_at counts characters of the normalised text.  Null, empty and blank texts and items match nothing; an empty
    table on either side gives an empty result; repeated rows give repeated results.
    """
    bounded_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("ends_at", pa.int64())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, budget int, ends_at long")
    for block in item_blocks(benchmark):
        shared = _share(spark, block)

        def work(batches, shared=shared):
            matcher = _matcher(shared, rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matcher.search(normal(text))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

        out = out.union(docs.mapInArrow(giving_back(work), "doc_id long, item_id long, distance int, budget int, ends_at long"))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """The rows of ``docs`` (all columns) whose texts hold no item within the budget; null texts stay."""
    bounded_batches(spark)
    at = docs.columns.index("text")
    for block in item_blocks(benchmark):
        shared = _share(spark, block)

        def work(batches, shared=shared):
            matcher = _matcher(shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.search(normal(t)), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(giving_back(work), docs.schema)
    return docs
