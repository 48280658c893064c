"""Document quality by a linear-chain conditional random field over lines.

Each non-blank line is good or bad.  Its features describe its characters and words, and those of the lines before and
after it; a transition weight ties neighbours.  Forward-backward gives each line's marginal, and a document's
evidence is the mean of the marginals weighted by line length, which a logistic curve turns into a score.

Only documents are labelled: lines start with their document's label; after a first fit, lines of bad documents that
the field finds good are relabelled and it is fitted again.  Features are counts over character classes, taken for
whole batches of texts in a few array passes, and the chains of a batch are walked in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches, giving_back
from .shingles import batches as parts_of
from .shingles import mix

_LOW, _UP, _LETTER, _DIGIT, _SPACE, _NEWLINE, _POINT, _BAR, _BANG, _SIGN = range(10)
_CLASSES: list[np.ndarray] = []
_MARKS: list[np.ndarray] = []
N_FEATURES = 12


def _classes() -> np.ndarray:
    """Code point to character class."""
    if not _CLASSES:
        table = np.full(0x110000, _SIGN, dtype=np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = _LOW if c.islower() else _UP if c.isupper() else _LETTER
            elif c.isdigit():
                table[i] = _DIGIT
            elif c.isspace():
                table[i] = _SPACE
        for c in ".,;:'\"()-?’“”«»¿¡":
            table[ord(c)] = _POINT
        table[ord("\n")], table[ord("|")], table[ord("!")] = _NEWLINE, _BAR, _BANG
        _CLASSES.append(table)
    return _CLASSES[0]


def _marks() -> np.ndarray:
    """A fixed random number for each code point."""
    if not _MARKS:
        _MARKS.append(mix(np.arange(0x110000, dtype=np.uint64), 77))
    return _MARKS[0]


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines of all texts, each line's visible characters, and each line's text (index)."""
    raw = [((t or "") + "\n").encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b"".join(raw), dtype=np.uint32)
    kind = _classes()[code]
    newline = kind == _NEWLINE
    line = np.cumsum(newline) - newline
    n = int(line[-1]) + 1
    counts = np.bincount(line * 10 + kind, minlength=n * 10).reshape(n, 10).astype(np.float64)
    text_of = np.searchsorted(np.cumsum([len(r) // 4 for r in raw]), np.flatnonzero(newline), side="right")
    blank = (kind == _SPACE) | newline
    first = ~blank
    first[1:] &= blank[:-1]
    start = np.flatnonzero(first)
    with np.errstate(over="ignore"):  # words and lines are told apart by sums over their characters
        sums = np.r_[np.uint64(0), np.cumsum(_marks()[code] * ~blank, dtype=np.uint64)]
        stop = np.r_[start[1:], len(code)]
        word = sums[stop] - sums[start] if len(start) else np.empty(0, dtype=np.uint64)
    word_line = line[start]
    words = np.bincount(word_line, minlength=n)
    same = np.r_[False, word[1:] == word[:-1]] & np.r_[False, text_of[word_line][1:] == text_of[word_line][:-1]] if len(word) else np.zeros(0, dtype=bool)
    repeats = np.bincount(word_line[same], minlength=n)
    triple = np.zeros(len(code), dtype=bool)
    triple[2:] = (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & ~blank[2:]
    triples = np.bincount(line[triple], minlength=n)
    # a line that its text holds already
    edge = np.flatnonzero(newline)
    with np.errstate(over="ignore"):
        mark = mix(sums[edge] - sums[np.r_[0, edge[:-1] + 1]]) ^ mix(text_of.astype(np.uint64), 5)
    seen_before = np.ones(n, dtype=bool)
    seen_before[np.unique(mark, return_index=True)[1]] = False
    visible = counts.sum(axis=1) - counts[:, _SPACE] - counts[:, _NEWLINE]
    letters = counts[:, _LOW] + counts[:, _UP] + counts[:, _LETTER]
    v, w = np.maximum(visible, 1), np.maximum(words, 1)
    x = np.stack(
        [letters / v, counts[:, _UP] / np.maximum(letters, 1), counts[:, _DIGIT] / v, counts[:, _SIGN] / v, counts[:, _POINT] / v, np.minimum(1, 5 * counts[:, _BAR] / w), np.minimum(1, 5 * counts[:, _BANG] / w), repeats / w, np.minimum(1, 5 * triples / w), seen_before, np.minimum(1, np.log1p(visible) / 10), np.minimum(1, v / w / 20)],
        axis=1,
    )
    keep = visible > 0
    return x[keep], visible[keep], text_of[keep]


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text (0 beyond its ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = owner[1:] == owner[:-1]
        before[1:][same] = x[:-1][same]
        after[:-1][same] = x[1:][same]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(unary: np.ndarray, owner: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of the four transitions, by forward-backward over all chains in step.

    ``unary`` is the log-odds of good for a line; ``trans[i, j]`` the weight of a step from i to j (0 bad, 1 good).
    ``weight`` says how often each line's steps count (once without it).
    """
    n = len(unary)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, n])
    at = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[at], sizes[at]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    half = np.clip(unary, -60, 60) / 2
    psi = np.exp(np.stack([-half, half], axis=1))
    move = np.exp(trans)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    for t in range(steps):
        i = starts[: active[t]] + t
        a = psi[i] if t == 0 else (forward[i - 1] @ move) * psi[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        i = starts[: active[t + 1]] + t
        b = (psi[i + 1] * backward[i + 1]) @ move.T
        backward[i] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    p = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(np.r_[owner[1:] == owner[:-1], False])
    pair = forward[inner][:, :, None] * move[None] * (psi[inner + 1] * backward[inner + 1])[:, None, :]
    if not len(inner):
        return p, np.zeros((2, 2))
    pair = pair / pair.sum(axis=(1, 2), keepdims=True)
    return p, (pair if weight is None else pair * weight[inner][:, None, None]).sum(axis=0)


class LineField:
    """Weights of the field and of the curve from evidence to score."""

    def __init__(self):
        self.w, self.trans = np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2))
        self.curve, self.prior = np.zeros(2), 0.5

    def _fit_field(self, x, owner, y, weight, rounds: int = 60, rate: float = 0.3, l2: float = 1e-4) -> None:
        """Gradient ascent (Adam) on the weighted mean log-likelihood of the lines' labels."""
        inner = np.flatnonzero(np.r_[owner[1:] == owner[:-1], False])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner], y[inner + 1]), weight[inner])
        theta = np.r_[self.w, self.trans.ravel()]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, expected = marginals(x @ self.w, owner, self.trans, weight)
            g = np.r_[x.T @ (weight * (y - p)), (seen - expected).ravel()] / weight.sum() - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)

    def fit(self, texts: list[str], quality: list[int], counts: tuple[int, int] | None = None) -> LineField:
        """Fit on labelled documents; without both labels every score is the share of good ones (0.5 without any).

        ``counts`` are the bad and good documents that the given ones stand for, where these are a sample: each then
        weighs as many as it stands for, so scores and the share of good ones don't depend on the sample's balance.
        """
        quality = np.array(quality, dtype=np.int64)
        held = np.bincount(quality, minlength=2)
        counts = np.array(held if counts is None else counts, dtype=np.float64)
        if counts.sum():
            self.prior = float(counts[1] / counts.sum())
        if not held.all() or not counts.all():
            return self
        weight = (counts / held)[quality]
        weight /= weight.mean()
        x, visible, owner = line_features(texts)
        if not len(x):
            return self
        full, y, line_weight = with_neighbours(x, owner), quality[owner], weight[owner]
        self._fit_field(full, owner, y, line_weight)
        p, _ = marginals(full @ self.w, owner, self.trans)
        worst = np.full(len(texts), np.inf)
        np.minimum.at(worst, owner, p)
        self._fit_field(full, owner, np.where((y == 0) & (p > 0.5) & (worst[owner] < 0.5), 1, y), line_weight)
        evidence, known = self._evidence(full, visible, owner, len(texts))
        e, q, u = evidence[known], quality[known], weight[known]
        a = b = 0.0
        for _ in range(300):  # Newton steps with a small ridge
            z = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
            s = u * (z * (1 - z) + 1e-9)
            g = np.array([(u * (q - z) * e).sum() - 0.01 * a, (u * (q - z)).sum() - 0.01 * b])
            h = np.array([[(s * e * e).sum() + 0.01, (s * e).sum()], [(s * e).sum(), s.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.curve = np.array([a, b])
        return self

    def _evidence(self, full, visible, owner, n) -> tuple[np.ndarray, np.ndarray]:
        p, _ = marginals(full @ self.w, owner, self.trans)
        size = np.bincount(owner, weights=visible, minlength=n)
        return np.bincount(owner, weights=visible * p, minlength=n) / np.maximum(size, 1), size > 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not self.curve.any():
            return out
        for part in parts_of(texts):
            x, visible, owner = line_features([texts[i] for i in part])
            evidence, known = self._evidence(with_neighbours(x, owner), visible, owner, len(part))
            z = 1 / (1 + np.exp(-np.clip(self.curve[0] * evidence + self.curve[1], -60, 60)))
            out[part.start : part.stop] = np.where(known, z, self.prior)
        return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, documents: int = 800, longest: int = 8_000) -> LineField:
    """Fit on ``documents`` labelled texts of each quality (0, 1) at most, chosen by hash, of up to ``longest`` characters.

    The bounds keep the sample small on the driver whatever the table; each sampled text weighs as many of all labelled
    documents in ``docs`` (of any length) as it stands for.  ``labels(doc_id, quality)`` with other or null values, or
    with both values for one document, are left out.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).select("doc_id", "quality") for q in (0, 1)]
    sample = spark.createDataFrame(chosen[0].union(chosen[1]).toArrow())
    rows = docs.where(F.length("text") <= longest).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality").distinct().orderBy("doc_id", "text").limit(4 * documents).collect()
    counts = {r.quality: r["count"] for r in known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().collect()}
    return LineField().fit([r.text for r in rows], [r.quality for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def _fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def learned_field(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> LineField:
    """The field learned from rows whose crc32(doc_id) mod ``folds`` isn't ``held``."""
    return fit(spark, docs.where(_fold("doc_id", folds) != held).select("doc_id", "text"), labels.where(_fold("doc_id", folds) != held).select("doc_id", "quality"))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.

    Null, empty and blank texts have no line and score the share of good documents among all labelled, not held out ones.  A row with a null doc_id
    is scored, and neither held out nor learned from; an empty table gives an empty result.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(learned_field(spark, docs, labels, folds, held))

    def work(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(work), "doc_id long, score double")
    held_out = F.coalesce(_fold("doc_id", folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``least``."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(learned_field(spark, docs, labels))
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(giving_back(work), docs.schema)
