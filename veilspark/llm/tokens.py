"""Token counts of fields or sections by offset-mapped attribution.

A whole document is encoded once (tokens across section borders stay as a model would see them); the
tokens' spans are then joined to the sections' spans, both sorted, and tokens that cross a border are allotted by an explicit rule:
``first`` (the section of its first character), ``last``, ``most`` (the section with most of its characters, the earlier
of equals) or ``split`` (each section its share of the characters).  Tokens outside every section count as section -1.

Spans are half-open and in characters.  Byte-level tokens can cut a character; a token's characters are those that begin in it,
and a token in which none begins counts at the character that it continues.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches

# fixed value: the public pattern that splits text before this vocabulary's merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """A byte-level encoder that also gives each token's character span."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:  # a vocabulary beside the installed library, not a table
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (characters) of the tokens of a whole text."""
        tokens = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ends = np.cumsum(self.size[tokens])
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        if len(raw) == len(text):  # one byte a character
            return ends - self.size[tokens], ends
        before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        start, end = before[ends - self.size[tokens]], before[ends]
        inside = start == end
        return start - inside, end


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (the last entry: outside all), and how many crossed one of its borders.

    ``sections`` has a row (start, end) for each, sorted and disjoint; empty sections get nothing.
    """
    n = len(sections)
    counts, crossed = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    if not n or not len(start):
        counts[n] = len(start)
        return counts, crossed
    a, b = sections[:, 0], sections[:, 1]

    def at(position: np.ndarray) -> np.ndarray:
        k = np.searchsorted(a, position, side="right") - 1
        return np.where((k >= 0) & (position < b[np.maximum(k, 0)]), k, n)

    first, last = at(start), at(np.maximum(end - 1, start))
    whole = first == last
    whole &= (first < n) | (np.searchsorted(a, np.maximum(end - 1, start), side="right") == np.searchsorted(a, start, side="right"))
    np.add.at(counts, first[whole], 1)
    for i in np.flatnonzero(~whole):
        low = max(0, int(np.searchsorted(b, start[i], side="right")))
        held = [(int(min(end[i], b[k]) - max(start[i], a[k])), k) for k in range(low, int(np.searchsorted(a, end[i], side="left"))) if min(end[i], b[k]) > max(start[i], a[k])]
        out = int(end[i] - start[i]) - sum(h for h, _ in held)
        for _, k in held:
            crossed[k] += 1
        if rule == "first":
            counts[first[i]] += 1
        elif rule == "last":
            counts[last[i]] += 1
        elif rule == "most":
            best = max(held, key=lambda h: (h[0], -h[1]), default=(0, n))
            counts[best[1] if best[0] >= out else n] += 1
        else:
            for size, k in held:
                counts[k] += size / (end[i] - start[i])
            counts[n] += out / (end[i] - start[i])
    return counts, crossed


def line_sections(text: str) -> np.ndarray:
    """(start, end) of the lines of a text, each with its line break; a text that ends with one has no further line."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(code == 10) + 1
    if not len(ends) or ends[-1] < len(code):
        ends = np.r_[ends, len(code)]
    return np.stack([np.r_[0, ends[:-1]], ends], axis=1) if len(code) else np.empty((0, 2), dtype=np.int64)


def count_tokens(spark: SparkSession, docs: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing): one row for each section of each row of ``docs(doc_id, text)``.

    ``sections`` names a column array<struct<start: int, end: int>> (sorted, disjoint); without it they are the text's lines.
    Tokens outside all sections are in a row with section -1 and null bounds.  A null or empty text, or one
    without sections and tokens, gives one row with section -1 and 0 tokens, so that no document is lost.
    """
    if rule not in ("first", "last", "most", "split"):
        raise ValueError(f"unknown rule {rule!r}")
    bounded_batches(spark)
    kinds = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64()), ("crossing", pa.int64())])

    def work(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            rows = []
            spans = batch.column(2).to_pylist() if sections else None
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = text or ""
                cut = line_sections(text) if spans is None else np.array([(s["start"], s["end"]) for s in spans[i] or []], dtype=np.int64).reshape(-1, 2)
                counts, crossed = attribute(*encoder.spans(text), cut, rule) if text else (np.zeros(len(cut) + 1), np.zeros(len(cut) + 1, dtype=np.int64))
                rows += [(doc, k, int(a), int(b), float(counts[k]), int(crossed[k])) for k, (a, b) in enumerate(cut)]
                if counts[-1] or not len(cut):
                    rows.append((doc, -1, None, None, float(counts[-1]), 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *([F.col(sections)] if sections else [])]
    return docs.select(*chosen).mapInArrow(work, "doc_id long, section int, start int, end int, tokens double, crossing long")
