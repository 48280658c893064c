"""N-gram Jaccard join by prefix filtering under several global token orders.

Documents with equal shingle sets are one *class*.  A class's prefix under a global order of
shingles holds its first ``n - ceil(t n) + 1`` shingles; classes that link share one under every
order.  With ``s`` shared prefix shingles the overlap is at most ``s + max(n_x - p_x, n_y - p_y)``,
which each order checks.  Candidates of the first order meet only the *signatures* of the others (their prefixes,
32 bits a shingle): pairs that any order rules out are dropped there, and whole sets move for the pairs
that are left.  Equal low bits of different shingles can only let a pair through.

The first order generates candidates.  It puts frequent shingles last, so that a passage that many
documents share isn't in their prefixes.  Which shingles are frequent is an unbiased estimate over all
documents of which the ``most_frequent`` largest are kept: it decides the order, and so the cost, never
the result.  The further orders are different hash orders.  Lists of frequent shingles are split over tasks by a salt; the list
of any other shingle is at most ``1 / most_frequent`` of all estimated shingles, and is read as a stream.

Groups of thousands of near copies share long posting lists.  From each list of ``crowd`` classes or
more, first only pairs with a centre of the list are verified, in ``rounds`` rounds with other centres for those not
yet linked; centres are classes that are on many such lists, as the text behind a group of copies is.  Then all
pairs of all lists whose classes aren't yet connected are candidates.  A class is left out of a list if all the lists
that it is on are fewer than the shared shingles it would need with any size on that list.  So no link between
different components is lost, and a group's pairs aren't all spelled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, bloom_of, bounded_batches, giving_back, in_bloom
from .shingles import mix, shingle_sets

_SINGLE_WEIGHT = 64


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set of hashes (signed)."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = mix(tokens, 301).sum(dtype=np.uint64) + mix(np.array([len(tokens)], dtype=np.uint64), 302)[0]
    return int(mix(np.array([total], dtype=np.uint64), 303).view(np.int64)[0])


def prefix_size(n, t_num: int, t_den: int):
    """Shingles in a prefix: n - ceil(t n) + 1."""
    return n - -(-t_num * n // t_den) + 1


def _needed(n, m, t_num: int, t_den: int):
    """Least overlap of sets of n and m that reaches the threshold."""
    return -(-t_num * (n + m) // (t_num + t_den))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class NgramJoin:
    """Finds all links of a table (doc_id, text); ``result`` is one row for each input row.

    threshold: as a fraction ``t_num / t_den``; width: words of a shingle; most_frequent: bound of the
    broadcast table of frequent shingles; least_frequent: documents that make a shingle frequent;
    crowd: list length from which centres are tried first, in so many rounds; tile: main members of a family
    of lists in one task;
    orders: global orders in all, at least 2; few: bound of the ends of pairs that are broadcast.
    """

    def __init__(self, spark: SparkSession, width: int = 5, t_num: int = 75, t_den: int = 100, most_frequent: int = 1 << 18, least_frequent: int = 64, crowd: int = 16, rounds: int = 2, tile: int = 128, orders: int = 3, few: int = 1 << 20):
        self.spark, self.scratch = spark, Scratch(spark)
        self.width, self.t_num, self.t_den = width, t_num, t_den
        self.few = few
        self._repeats, self._rows = False, 0  # found in the run: whether rows repeat; about how many posting rows are left
        self.most_frequent, self.least_frequent, self.crowd, self.rounds, self.tile, self.orders = most_frequent, least_frequent, crowd, rounds, tile, orders

    # -- sets, classes and frequent shingles ------------------------------------------------

    def _measure(self, docs: DataFrame) -> DataFrame:
        """kind 0: (doc_id, key, n) of each document; kind 1: (shingle, weight) towards document frequencies."""
        width, schema = self.width, pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

        def counted(parts: list[np.ndarray], block: int):
            tokens = np.sort(np.concatenate(parts))
            starts, runs = _runs(tokens)
            tokens = tokens[starts]
            keep = (runs > 1) | (mix(tokens, 401 + block) % np.uint64(_SINGLE_WEIGHT) == 0)
            weights = np.where(runs > 1, runs, _SINGLE_WEIGHT)[keep]
            return pa.record_batch([pa.array(np.ones(len(weights), dtype=np.int8)), _i64(tokens[keep]), pa.nulls(len(weights), pa.int64()), _i64(weights)], schema=schema)

        def work(batches):
            seen: set[int] = set()
            parts, held, block = [], 0, 0
            for batch in batches:
                keys, sizes = [], []
                for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                    keys.append(key := set_key(tokens))
                    sizes.append(len(tokens))
                    if len(tokens) and key not in seen:
                        seen.add(key)
                        parts.append(tokens)
                        held += len(tokens)
                        if held >= 1_000_000:
                            yield counted(parts, block)
                            parts, held, block = [], 0, block + 1
                ids = batch.column(0)
                yield pa.record_batch([pa.array(np.zeros(len(keys), dtype=np.int8)), ids, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)
            if parts:
                yield counted(parts, block)

        return docs.mapInArrow(giving_back(work), "kind byte, id long, key long, n long")

    def _frequent(self, measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        top = measured.where("kind = 1").groupBy("id").agg(F.sum("n").alias("df")).where(F.col("df") >= self.least_frequent)
        got = top.orderBy(F.desc("df"), "id").limit(self.most_frequent).toArrow()
        tokens, df = got["id"].to_numpy().view(np.uint64), got["df"].to_numpy()
        at = np.argsort(tokens)
        return tokens[at], df[at]

    # -- candidates -------------------------------------------------------------------------

    def _postings(self, docs: DataFrame, frequent) -> DataFrame:
        """(token, key, n, salt) for each class and each shingle of its prefix under the first order."""
        width, t_num, t_den, tile = self.width, self.t_num, self.t_den, 8192
        shared = self.spark.sparkContext.broadcast(frequent)
        schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("salt", pa.int32())])

        def work(batches):
            common, df = shared.value
            rank = np.minimum(np.log2(np.maximum(df, 1)) * 8, 254).astype(np.uint64) + np.uint64(1)
            seen: set[int] = set()
            for batch in batches:
                out = []
                for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                    n = len(tokens)
                    if not n or (key := set_key(tokens)) in seen:
                        continue
                    seen.add(key)
                    p = prefix_size(n, t_num, t_den)
                    order = mix(tokens, 601) >> np.uint64(8)
                    salt = np.zeros(n, dtype=np.int32)
                    if len(common):
                        at = np.searchsorted(common, tokens)
                        at[at == len(common)] = 0
                        hit = np.flatnonzero(common[at] == tokens)
                        order[hit] |= rank[at[hit]] << np.uint64(56)
                        parts = df[at[hit]] // tile + 1
                        salt[hit] = np.where(parts > 1, 1 + (key & 0x7FFFFFFF) % parts, 0)
                    take = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    out.append((tokens[take], key, n, salt[take]))
                if out:
                    size = [len(x[0]) for x in out]
                    yield pa.record_batch([_i64(np.concatenate([x[0] for x in out])), _i64(np.repeat([x[1] for x in out], size)), pa.array(np.repeat([x[2] for x in out], size).astype(np.int32)), pa.array(np.concatenate([x[3] for x in out]))], schema=schema)

        return docs.mapInArrow(giving_back(work), "token long, key long, n int, salt int")

    def _lists(self, postings: DataFrame) -> DataFrame:
        """(token, key, n) of posting lists of two classes or more, and of every part of a salted list, once each.

        A row needs only its neighbours in order, so a task holds a batch and never a list.
        """
        schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

        def work(batches):
            last, open_row, alone = None, None, False  # the row before this batch, not sent yet while it is alone
            for batch in batches:
                if not batch.num_rows:
                    continue
                token, key, n, salt = (_column(batch, c) for c in ("token", "key", "n", "salt"))
                same_list = np.r_[last is not None and token[0] == last[0] and salt[0] == last[2], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])]
                again = same_list & np.r_[last is not None and key[0] == last[1], key[1:] == key[:-1]]
                fresh = np.flatnonzero(~again)
                if len(fresh):
                    if alone and same_list[fresh[0]]:
                        yield pa.record_batch([pa.array([v], t) for v, t in zip(open_row, (pa.int64(), pa.int64(), pa.int32()), strict=True)], schema=schema)
                    joins = same_list[fresh]
                    followed = np.r_[joins[1:], False]
                    send = joins | followed | (salt[fresh] > 0)
                    if send.any():
                        at = fresh[send]
                        yield pa.record_batch([pa.array(token[at]), pa.array(key[at]), pa.array(n[at])], schema=schema)
                    open_row, alone = (int(token[fresh[-1]]), int(key[fresh[-1]]), int(n[fresh[-1]])), not send[-1]
                last = (token[-1], key[-1], salt[-1])

        return postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "key").mapInArrow(giving_back(work), "token long, key long, n int")

    def _stars(self, crowd: DataFrame, turn: int) -> DataFrame:
        """(a, b): pairs of a list's centre and its members that aren't linked yet."""
        weight = F.expr(f"popular * (1 + 0.0002 * pmod(xxhash64(key, pmod(token, 8), {turn}), 1000))")
        centres = crowd.groupBy("token").agg(F.max(F.struct(weight.alias("w"), "key", "n")).alias("c")).select("token", F.col("c.key").alias("a"), F.col("c.n").alias("an"))
        fit = f"least(n, an) * {self.t_den} >= greatest(n, an) * {self.t_num} and key <> a"
        open_rows = crowd.where("not linked").join(centres, "token").where(fit)
        return self.scratch.save(open_rows.select("a", F.col("key").alias("b")).distinct(), "stars", self._rows)

    def _unconnected(self, lists: DataFrame, linked: DataFrame) -> DataFrame:
        """(a, b): pairs of classes that aren't in one component yet and share enough lists.

        Short lists are compared list by list.  Crowded ones form families by the component that most of their members
        have; all lists of a family meet in the same tasks, so a pair's shared lists are counted there and aren't written
        one by one.  A family's main component is dealt in parts, its other members too; two parts of the main component never meet.
        """
        t_num, t_den, crowd, main_part, other_part = self.t_num, self.t_den, self.crowd, self.tile, 4 * self.tile

        def need(m):
            return f"(ceil({t_num} * (n + {m}) / {t_num + t_den}) - greatest(ceil({t_num} * n / {t_den}), ceil({t_num} * {m} / {t_den})) + 1)"

        rows = lists.select("token", "key", "n").join(linked.select(F.col("node").alias("key"), "component"), "key", "left").select("token", "key", "n", F.coalesce("component", "key").alias("component"))
        kinds = rows.groupBy("token", "component").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"))
        kinds = kinds.groupBy("token").agg(F.count("*").alias("parts"), F.sum("c").alias("m"), F.max(F.struct("c", "component")).getField("component").alias("main"), F.min("least").alias("least"), F.max("most").alias("most"))
        rows = rows.join(kinds.where("parts > 1").drop("parts"), "token")  # a list with one component has nothing left
        rows = rows.withColumn("least", F.expr(f"greatest(least, cast(ceil({t_num} * n / {t_den}) as int))")).withColumn("most", F.expr(f"least(most, cast(floor({t_den} * n / {t_num}) as int))"))
        rows = rows.withColumn("big", F.expr(f"m >= {crowd}")).withColumn("family", F.expr("if(big, main, token)")).withColumn("inner", F.expr("big and component = main"))
        rows = self.scratch.save(rows, "open", self._rows)
        rows = rows.join(rows.groupBy("key").agg(F.count("*").cast("int").alias("on")), "key").where(f"least <= most and on + 1 >= least({need('least')}, {need('most')})")
        short = rows.where("not big").select("token", "key", "n", "component", "on", F.lit(False).alias("big"), "family", F.lit(0).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        crowded = rows.where("big")
        members = crowded.select("family", "key", "inner").distinct().groupBy("family").agg(F.expr(f"cast(count_if(inner) div {main_part} as int) + 1").alias("p"), F.expr(f"cast(count_if(not inner) div {other_part} as int) + 1").alias("q"))
        crowded = crowded.join(members, "family").withColumn("part", F.expr("if(inner, pmod(xxhash64(key), p), p + pmod(xxhash64(key), q))").cast("int"))
        meets = F.expr("if(inner, transform(sequence(p, p + q - 1), k -> struct(part as i, k as j)), concat(transform(sequence(0, p - 1), k -> struct(k as i, part as j)), transform(sequence(p, p + q - 1), k -> struct(least(k, part) as i, greatest(k, part) as j))))")
        crowded = crowded.withColumn("tile", F.explode(meets)).select("token", "key", "n", "component", "on", "big", "family", "part", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("shared", pa.int32())])

        def required(n, m):
            return _needed(n, m, t_num, t_den) - np.maximum(-(-t_num * n // t_den), -(-t_num * m // t_den)) + 1

        def later(starts, stops, n, good):
            """Index pairs (left, right) of each run whose sizes fit and which are good; runs are in order of n."""
            stop_of = np.repeat(stops, stops - starts)
            left, k = np.repeat(starts, stops - starts) + np.arange(len(stop_of)) - np.repeat(np.cumsum(stops - starts) - (stops - starts), stops - starts), 1
            while len(left):
                fits = left + k < stop_of
                left, stop_of = left[fits], stop_of[fits]
                fits = n[left + k] * t_num <= n[left] * t_den
                left, stop_of = left[fits], stop_of[fits]
                pick = good(left, left + k)
                if pick.any():
                    yield left[pick], left[pick] + k
                k += 1

        def emit(a, b, na, nb, shared):
            swap = a > b
            return pa.record_batch([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, nb, na).astype(np.int32)), pa.array(np.where(swap, na, nb).astype(np.int32)), pa.array(shared.astype(np.int32))], schema=schema)

        names_in = ("token", "key", "n", "component", "on", "big", "family", "part", "i", "j")

        def tiles(batches):
            """Runs of whole tiles, in order; a task holds a batch and one open tile."""
            held: list[list[np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = [_column(batch, c) for c in names_in]
                of = [now[c] for c in (5, 6, 8, 9)]
                first = bool(held) and any(x[0] != held[-1][c][-1] for x, c in zip(of, (5, 6, 8, 9), strict=True))
                starts = np.flatnonzero(np.r_[first, np.logical_or.reduce([x[1:] != x[:-1] for x in of])])
                if len(starts):
                    held.append([x[: starts[-1]] for x in now])
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, now = [], [x[starts[-1] :] for x in now]
                held.append(now)
            if held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]

        def work(batches):
            for columns in tiles(batches):
                yield from met(*columns)

        def met(token, key, n, component, on, big, family, part, i, j):
            n, on = n.astype(np.int64), on.astype(np.int64)
            tile = np.r_[True, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (big[1:] != big[:-1])]
            starts = np.flatnonzero(tile | np.r_[True, token[1:] != token[:-1]])
            stops = np.r_[starts[1:], len(token)]
            small = ~big[starts]
            for left, right in later(starts[small], stops[small], n, lambda x, y: (component[x] != component[y]) & (np.minimum(on[x], on[y]) >= required(n[x], n[y]))):
                yield emit(key[left], key[right], n[left], n[right], np.ones(len(left)))
            edges = np.r_[np.flatnonzero(tile), len(token)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if not big[a]:
                    continue
                of = slice(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b)))
                names, first, own, lists_of = np.unique(key[a:b], return_index=True, return_inverse=True, return_counts=True)
                size, rest = n[a:b][first], on[a:b][first] - lists_of
                same = i[a] == j[a]
                codes, counts, held = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], 0

                def merge(codes, counts):
                    code, count = np.concatenate(codes), np.concatenate(counts)
                    at = np.argsort(code, kind="stable")
                    code, count = code[at], count[at]
                    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
                    return [code[begin]], [np.add.reduceat(count, begin) if len(begin) else count]

                for left, right in later(starts[of], stops[of], n, lambda x, y: (component[x] != component[y]) & (same | (part[x] != part[y]))):
                    x, y = own[left - a], own[right - a]
                    codes.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
                    counts.append(np.ones(len(x), dtype=np.int64))
                    held += len(x)
                    if held > 2_000_000:
                        codes, counts = merge(codes, counts)
                        held = 0
                codes, counts = merge(codes, counts)
                x, y = codes[0] // len(names), codes[0] % len(names)
                pick = counts[0] + np.minimum(rest[x], rest[y]) >= required(size[x], size[y])
                if pick.any():
                    x, y = x[pick], y[pick]
                    yield emit(names[x], names[y], size[x], size[y], counts[0][pick])

        made = short.union(crowded).repartition("big", "family", "i", "j").sortWithinPartitions("big", "family", "i", "j", "token", "n").mapInArrow(giving_back(work), "a long, b long, na int, nb int, shared int")
        pairs = made.groupBy("a", "b").agg(F.max("na").cast("long").alias("na"), F.max("nb").cast("long").alias("nb"), F.sum("shared").alias("shared"))
        n, m = F.col("na"), F.col("nb")
        rest = F.greatest(F.ceil(t_num * n / t_den), F.ceil(t_num * m / t_den)) - 1
        return pairs.where(F.col("shared") >= F.ceil(t_num * (n + m) / (t_num + t_den)) - rest).select("a", "b")

    # -- verification -----------------------------------------------------------------------

    def _sets(self, ends: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(key, n, signature, tokens) of the classes in ``ends(key)``, and of some that a full Bloom filter lets through.

        signature: the prefixes under the further orders; readers of it don't read the tokens.
        """
        width, orders, t_num, t_den = self.width, self.orders, self.t_num, self.t_den
        wanted = classes.join(ends, "key", "left_semi").select("rep", "key")
        bloom = self.spark.sparkContext.broadcast(bloom_of(wanted, "rep"))
        schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("signature", pa.binary()), ("tokens", pa.binary())])

        def sets(batches):
            seen: set[int] = set()
            for batch in batches:
                hit = np.flatnonzero(in_bloom(bloom.value, _column(batch, "doc_id")))
                if not len(hit):
                    continue
                keys, sizes, marks, held = [], [], [], []
                for tokens in shingle_sets(batch.column(1).take(pa.array(hit)).to_pylist(), width):
                    n = len(tokens)
                    if n and (key := set_key(tokens)) not in seen:
                        seen.add(key)
                        p = prefix_size(n, t_num, t_den)
                        keys.append(key)
                        sizes.append(n)
                        marks.append(b"".join(np.sort(np.partition(mix(tokens, 601 + order), p - 1)[:p].astype(np.uint32)).tobytes() for order in range(1, orders)))
                        held.append(tokens.tobytes())
                if keys:
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(held, pa.binary())], schema=schema)

        known = docs.mapInArrow(giving_back(sets), "key long, n int, signature binary, tokens binary")
        if self._repeats:  # the same row again and again: one of them
            known = known.dropDuplicates(["key"])
        return self.scratch.save(known, "sets", wide=True)

    def _meet(self, pairs: DataFrame, known: DataFrame, *fields: str) -> DataFrame:
        """(a, b, key, fields) for both ends of each pair, the two rows side by side.

        A pair is dealt by itself, so a centre of thousands of pairs is no hot key.  Where the ends are few they go to the sets
        (24 bytes a row, ``few`` rows at most); else only sets that a Bloom filter of the ends lets through are dealt by key.
        """
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
        rows = known.select("key", *fields)
        if 2 * pairs.count() <= self.few:
            ends = F.broadcast(ends)
        else:
            bloom = self.spark.sparkContext.broadcast(bloom_of(ends.select("key").distinct(), "key"))

            def wanted(batches):
                for batch in batches:
                    yield batch.filter(pa.array(in_bloom(bloom.value, _column(batch, "key"))))

            rows = rows.mapInArrow(giving_back(wanted), rows.schema)
        return rows.join(ends, "key").select("a", "b", "key", *fields).repartition("a", "b").sortWithinPartitions("a", "b", "key")

    def _filtered(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs (a, b) that share enough prefix shingles under every further order."""
        t_num, t_den, orders = self.t_num, self.t_den, self.orders

        def passes(n, x, m, y):
            x, y = (np.frombuffer(v, dtype=np.uint32).reshape(orders - 1, -1) for v in (x, y))
            least = max(1, _needed(n, m, t_num, t_den) - max(n - x.shape[1], m - y.shape[1]))
            return all(_common(u, v) >= least for u, v in zip(x, y, strict=True))

        met = self._meet(pairs, known, "n", "signature")
        return self.scratch.save(met.mapInArrow(giving_back(_two_by_two(passes)), "a long, b long"), "filtered", self._rows)

    def _compare(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs (a, b) of class keys that link: those that all orders let pass, on whole sets."""
        t_num, t_den = self.t_num, self.t_den

        def linked(n, x, m, y):
            shared = _common(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
            return t_den * shared >= t_num * (n + m - shared)

        met = self._meet(self._filtered(pairs, known), known, "n", "tokens")
        return self.scratch.save(met.mapInArrow(giving_back(_two_by_two(linked)), "a long, b long"), "links", self._rows)

    def _crowds(self, lists: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): links of centres of crowded lists."""
        crowd = lists.join(lists.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") >= self.crowd), "token", "left_semi")
        crowd = self.scratch.save(crowd.join(crowd.groupBy("key").agg(F.count("*").alias("popular")), "key"), "crowd", self._rows)
        known = self._sets(crowd.select("key").distinct(), docs, classes)
        found = self._compare(self._stars(crowd.withColumn("linked", F.lit(False)), 0), known)
        for turn in range(1, self.rounds):
            done = found.select(F.col("a").alias("key")).union(found.select(F.col("b").alias("key"))).distinct().withColumn("linked", F.lit(True))
            state = crowd.join(done, "key", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
            found = found.union(self._compare(self._stars(state, turn), known))
        self.scratch.drop(known, crowd)
        return found

    # -- the whole job ------------------------------------------------------------------------

    def result(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id): one row for each row of ``docs``.

        Null texts, empty texts and texts of white space have no shingles and link with nothing, nor do rows whose
        doc_id is null (their component_id is null).  Repeated rows and rows that repeat a text are one class; a
        doc_id that stands for several texts is in all their components and each of its rows names its own text's.
        Columns besides doc_id and text play no part.
        """
        bounded_batches(self.spark)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        measured = self.scratch.save(self._measure(docs), "measured")
        docs = docs.where("doc_id is not null and text is not null")
        frequent = self._frequent(measured)
        sized = measured.where("kind = 0").select(F.col("id").alias("doc_id"), "key", "n")
        counted = sized.where("n > 0 and doc_id is not null")
        self._repeats = not counted.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
        rows, postings = counted.agg(F.count("*"), F.expr(f"coalesce(sum(n - cast(ceil({self.t_num} * n / {self.t_den}) as long) + 1), 0)")).first()
        classes = self.scratch.save(counted.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes", rows)
        lists = self.scratch.save(self._lists(self._postings(docs, frequent)), "lists", postings // 4)
        self._rows = lists.count()
        edges = self._crowds(lists, docs, classes)
        merged = self.scratch.save(connected_components(edges, self.scratch, rows), "merged", rows)
        rest = self.scratch.save(self._unconnected(lists, merged), "pairs", self._rows)
        self.scratch.drop(lists)
        ends = rest.select(F.col("a").alias("key")).union(rest.select(F.col("b").alias("key"))).distinct()
        second = self._compare(rest, self._sets(ends, docs, classes))
        edges = merged.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)
        components = connected_components(edges, self.scratch, rows)
        named = classes.join(components, classes.key == components.node, "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        names = self.scratch.save(named.join(least, "component").select("key", "component_id"), "names", rows)
        out = sized.join(names.select(F.col("key").alias("class_key"), "component_id"), (F.col("n") > 0) & (F.col("key") == F.col("class_key")), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest doc_id of each component; one of rows that repeat an id and a text.

    Rows with a null doc_id link with nothing and all stay, as do rows without words.  An id that stands for different texts
    goes if one of them does.  Further columns are carried; an empty table stays empty.
    """
    found = NgramJoin(spark, **options)
    named = found.scratch.save(found.result(docs), "components")
    gone = named.where("doc_id <> component_id").select("doc_id").distinct()
    kept = without_ids(spark, docs, found.scratch.save(gone, "gone", named.count()))
    if not named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        once = kept.where("doc_id is not null").withColumn("__th", F.xxhash64("text")).dropDuplicates(["doc_id", "__th"]).drop("__th")
        kept = once.unionByName(kept.where("doc_id is null"))
    return kept


def without_ids(spark: SparkSession, docs: DataFrame, gone: DataFrame, few: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``gone(doc_id)``; null ids stay.

    The texts aren't shuffled: up to ``few`` ids (about 50 MB) are broadcast; of more, a Bloom filter picks the rows that have to meet them.
    """
    column, named = F.col("doc_id").cast("long"), gone.select(F.col("doc_id").alias("__gone"))
    if gone.count() <= few:
        return docs.join(F.broadcast(named), column == F.col("__gone"), "left_anti")
    bloom = spark.sparkContext.broadcast(bloom_of(gone, "doc_id"))

    def picked(want: bool):
        def work(batches):
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
                hit = in_bloom(bloom.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == want))

        return docs.mapInArrow(giving_back(work), docs.schema)

    return picked(False).unionAll(picked(True).join(named, column == F.col("__gone"), "left_anti"))


def _two_by_two(good):
    """The pairs of (a, b, key, n, payload) rows, sorted by pair and key, of which ``good(n, payload, n, payload)`` holds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        pair, first, done = None, None, False
        for batch in batches:
            a, b, key, n = (_column(batch, c) for c in ("a", "b", "key", "n"))
            out_a, out_b = [], []
            for r, payload in enumerate(batch.column(4)):
                now = (int(a[r]), int(b[r]))
                if now != pair:
                    pair, first, done = now, (key[r], int(n[r]), payload.as_py()), False
                elif not done and key[r] != first[0]:  # rows may repeat where ids do
                    done = True
                    if good(first[1], first[2], int(n[r]), payload.as_buffer()):
                        out_a.append(now[0])
                        out_b.append(now[1])
            if out_a:
                yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    return work


def _common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.sort(np.concatenate((x, y)), kind="stable")
    return int((z[1:] == z[:-1]).sum())


def ngram_components(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    return NgramJoin(spark, **options).result(docs)
