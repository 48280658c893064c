"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the longest
phrases that occur in that text; few phrases mean the language fits.  A phrase costs ``log2`` of the reference's length in
bits, and the language with the fewest bits a character wins (ties: the smaller name).

Letters are lower-cased, every run of other characters is one space.  A language's alphabet is that of its own text: a letter that
isn't in it has no step anywhere and so is a phrase of its own.  Greedy parsing restarts at the automaton's root, so
a missing step is the root's own step: completed this way, a batch of texts is parsed in step with array look-ups, in a dense table or,
for a wide alphabet, in a hash table of the edges.

Long texts are cut into blocks that are parsed side by side, each from the root; then each is parsed again from the state in
which the block before it really ended, until both parses are in the same state, which takes a few letters.  So the
phrases are those of one parse of the whole text, however long it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .shingles import batches as parts_of
from .shingles import mix

BLOCK = 1000
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point to its lower-cased letter, or 0 for what isn't a letter."""
    if not _FOLDED:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLDED.append(table)
    return _FOLDED[0]


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts with runs of non-letters as one 0, each text's bounds in them, and its letters."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    code = _folded()[np.frombuffer(b"".join(raw), dtype=np.uint32)]
    ends = np.cumsum([0, *[len(r) // 4 for r in raw]])
    keep = code > 0
    count = np.r_[0, np.cumsum(keep)]
    n_letters = count[ends[1:]] - count[ends[:-1]]
    keep[1:] |= code[:-1] > 0
    keep[ends[:-1][ends[:-1] < len(code)]] = True
    places = np.r_[0, np.cumsum(keep)]
    return code[keep], places[ends], n_letters


class Automaton:
    """Edges (state, symbol, next) of the suffix automaton of a sequence of symbols."""

    def __init__(self, symbols: list[int]):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            current = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = current
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        self.states, self.length = len(step), len(symbols)
        edges = [(s, c, t) for s, row in enumerate(step) for c, t in row.items()]
        self.edges = np.array(edges, dtype=np.int32).reshape(-1, 3)


_FLAG = np.int32(-(1 << 31))  # marks a step that begins a phrase


class Dense:
    """Completed steps of an automaton as one array over (state, symbol)."""

    def __init__(self, automaton: Automaton, width: int):
        root = _root(automaton, width)
        self.width, full = width, np.tile(root, (automaton.states, 1))
        rest = automaton.edges[automaton.edges[:, 0] > 0]
        full[rest[:, 0], rest[:, 1]] = rest[:, 2]
        self.steps = full.reshape(-1)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.steps[state * self.width + symbol]

    def one(self, state: int, symbol: int) -> int:
        return self.steps.item(state * self.width + symbol)


class Sparse:
    """The same steps from a hash table of the edges, for alphabets that make the dense array large."""

    def __init__(self, automaton: Automaton, width: int):
        self.width, self.root, self.edges = width, _root(automaton, width), None
        rest = automaton.edges[automaton.edges[:, 0] > 0].astype(np.int64)
        keys = rest[:, 0] * width + rest[:, 1]
        bits = max(4, int(2 * len(keys)).bit_length())
        while True:
            self.mask, self.keys, self.to = (1 << bits) - 1, np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
            left, self.probes = np.arange(len(keys)), 0
            while len(left) and self.probes < 3:
                at = self._place(keys[left], self.probes)
                free = self.keys[at] < 0
                self.keys[at[free]] = keys[left[free]]
                won = self.keys[at] == keys[left]
                self.to[at[won]] = rest[left[won], 2]
                left, self.probes = left[~won], self.probes + 1
            if not len(left):
                break
            bits += 1

    def _place(self, key: np.ndarray, probe: int) -> np.ndarray:
        return (mix(key.view(np.uint64), 701 + probe) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.root[symbol]
        key = state.astype(np.int64) * self.width + symbol
        for probe in range(self.probes):
            at = self._place(key, probe)
            out = np.where(self.keys[at] == key, self.to[at], out)
        return out

    def one(self, state: int, symbol: int) -> int:
        if self.edges is None:
            full = self.keys >= 0
            self.edges = dict(zip(self.keys[full].tolist(), self.to[full].tolist(), strict=True))
        return self.edges.get(state * self.width + symbol, self.root.item(symbol))


def _root(automaton: Automaton, width: int) -> np.ndarray:
    root = np.zeros(width, dtype=np.int32)
    own = automaton.edges[automaton.edges[:, 0] == 0]
    root[own[:, 1]] = own[:, 2]
    return root | _FLAG


def count_phrases(step, symbol: np.ndarray, start: np.ndarray, length: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block ``symbol[start : start + length]``; blocks are sorted by falling length.

    after: the block whose text goes on in this one, or -1 for the first block of a text.
    """
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    path, began = np.zeros((steps, len(start)), dtype=np.int32), np.zeros((steps, len(start)), dtype=bool)
    state = np.zeros(len(start), dtype=np.int32)
    for t in range(steps):
        n = active[t]
        to = step(state[:n], symbol[start[:n] + t])
        began[t, :n] = to < 0
        state[:n] = path[t, :n] = to & 0x7FFFFFFF
    entered = np.zeros(len(start), dtype=np.int32)
    follows = np.flatnonzero(after >= 0)
    rounds = 0
    while True:
        right = state[after[follows]]
        wrong = right != entered[follows]
        if not wrong.any():
            return began.sum(axis=0)
        blocks, rounds = follows[wrong], rounds + 1
        if rounds > 4:  # texts whose parses don't meet, as a phrase repeated over and over: block after block
            _chase(step, symbol, start, length, after, path, began, state, entered, blocks)
            continue
        entered[blocks] = now = right[wrong]
        for t in range(steps):
            inside = length[blocks] > t
            ended = blocks[~inside]
            state[ended] = now[~inside]
            blocks, now = blocks[inside], now[inside]
            if not len(blocks):
                break
            to = step(now, symbol[start[blocks] + t])
            now = to & 0x7FFFFFFF
            began[t, blocks] = to < 0
            apart = now != path[t, blocks]
            path[t, blocks] = now
            blocks, now = blocks[apart], now[apart]
        else:
            state[blocks] = now


def _chase(step, symbol, start, length, after, path, began, state, entered, blocks) -> None:
    """Parse each of the blocks again from the state before it, and what follows it, until the parses meet."""
    follower = np.full(len(start), -1)
    follower[after[after >= 0]] = np.flatnonzero(after >= 0)
    for b in blocks[np.argsort(start[blocks])].tolist():
        now = int(state[after[b]])
        while b >= 0 and entered[b] != now:
            entered[b], m = now, int(length[b])
            old, states, flags = path[:m, b].tolist(), [], []
            for t, c in enumerate(symbol[start[b] : start[b] + m].tolist()):
                to = step.one(now, c)
                now = to & 0x7FFFFFFF
                states.append(now)
                flags.append(to < 0)
                if now == old[t]:
                    break
            path[: len(states), b], began[: len(states), b] = states, flags
            if len(states) < m:  # they met: the rest of the block, and its end, stand
                break
            state[b] = now
            b = int(follower[b])


class Model:
    """Automata of the learned languages, each over its own alphabet; about 0.6 MB a language where excerpts hold 14,400 letters.

    dense: entries up to which steps are a dense array; together: languages whose steps are in memory at one time.
    """

    def __init__(self, samples: dict[str, list[str]], dense: int = 1 << 22, together: int = 16):
        self.names, self.dense, self.together = sorted(samples), dense, together
        coded = {name: letters(samples[name])[0] for name in self.names}
        self.chars = np.unique(np.concatenate([*coded.values(), np.zeros(1, dtype=np.uint32)]))  # 0 is the space
        self.own = [np.unique(coded[name]) for name in self.names]
        self.automata = [Automaton((1 + np.searchsorted(own, coded[name])).tolist()) for name, own in zip(self.names, self.own, strict=True)]
        self._ready: dict[int, Dense | Sparse] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_shared"} | {"_ready": {}}

    def symbols(self, code: np.ndarray) -> np.ndarray:
        """Indexes of letters in the joint alphabet; 0 for letters that are in no language's text."""
        if not hasattr(self, "_shared"):
            self._shared = np.zeros(0x110000, dtype=np.int32)
            self._shared[self.chars] = 1 + np.arange(len(self.chars))
        return self._shared[code]

    def _step(self, i: int) -> Dense | Sparse:
        if i not in self._ready:
            if len(self._ready) >= self.together:
                self._ready.clear()
            a, width = self.automata[i], 1 + len(self.own[i])
            self._ready[i] = Dense(a, width) if a.states * width <= self.dense else Sparse(a, width)
        return self._ready[i]

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases of each text in each language, characters parsed, letters)."""
        code, bounds, n_letters = letters(texts)
        joint = self.symbols(code)
        size = np.diff(bounds)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[:-1][owner] + k * BLOCK
        length = np.minimum(BLOCK, bounds[1:][owner] - start)
        at = np.argsort(-length, kind="stable")
        place = np.empty(len(at), dtype=np.int64)
        place[at] = np.arange(len(at))
        after = np.where(k > 0, np.r_[0, place[:-1]] if len(place) else place, -1)[at]
        owner, start, length = owner[at], start[at], length[at]
        counts = np.zeros((len(self.names), len(texts)), dtype=np.int64)
        for i, own in enumerate(self.own):
            local = np.zeros(1 + len(self.chars), dtype=np.int32)
            local[1 + np.searchsorted(self.chars, own)] = 1 + np.arange(len(own))
            found = count_phrases(self._step(i), local[joint], start, length, after)
            counts[i] = np.bincount(owner, weights=found, minlength=len(texts)).astype(np.int64)
        return counts, size, n_letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores
        for part in parts_of(texts, 1_000_000):
            counts, size, n_letters = self.parse([texts[i] for i in part])
            bits = counts * np.log2([max(2, a.length) for a in self.automata])[:, None]
            best = np.argmin(bits, axis=0)
            share = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
            for k, i in enumerate(part):
                if n_letters[k]:
                    names[i], scores[i] = self.names[best[k]], share[k]
        return names, scores


def fit(spark: SparkSession, labelled: DataFrame, rows: int = 24, excerpt: int = 600) -> Model:
    """Learn every language of ``labelled(lang, text)`` from ``rows`` texts, ``excerpt`` characters of each.

    These bounds also bound the automata (about two states a character).  Texts are chosen by hash.
    """
    labelled = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    chosen = labelled.groupBy("lang", F.expr(f"pmod(h, {rows})").alias("k")).agg(F.min("h").alias("h")).select("lang", "h")
    chosen = Scratch(spark).save(chosen, "chosen")
    few = chosen.count() <= 100_000  # ``rows`` for each language: 24 bytes each
    texts = labelled.join(F.broadcast(chosen) if few else chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    part = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(h), greatest(1, length(text) - {excerpt} + 1)) as int), {excerpt})")
    samples: dict[str, list[str]] = {}
    for row in texts.select("lang", "h", part.alias("text")).orderBy("lang", "h").collect():
        samples.setdefault(row.lang, []).append(row.text)
    return Model(samples)


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): one row for each row of ``docs``; ``und`` and 0 where the text is null or has no letter.

    score: the chance of the language under its bits, all languages being as likely.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify_documents(spark: SparkSession, docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose crc32(doc_id) mod ``folds`` is ``held`` are never learned from.

    A row with a null doc_id is predicted but neither held out nor learned from; an empty table gives an empty result.
    Equal rows get equal results, a text of any length is parsed whole, ties go to the smaller name, further columns
    of ``docs`` play no part.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fit(spark, docs.where(fold != held).select("lang", "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return identify(spark, docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
