import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from veilspark.llm import sharding


def brute_capacity(sizes, shards):
    """Smallest largest part of a contiguous partition, by dynamic programming over every cut."""
    prefix = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(prefix))]
    return best[-1]


def test_search_matches_dynamic_programming():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 9, 40]) * rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))]
        shards = rng.randrange(1, 7)
        prefix = np.cumsum(sizes)
        found = sharding.smallest_capacity(prefix, max(max(sizes), -(-sum(sizes) // shards)), shards)
        assert found == brute_capacity(sizes, shards)
        assert len(sharding.greedy_cuts(prefix, found, shards)) == shards


def check(rows, out, shards):
    assert Counter((d, len((t or "").encode()) + 8, zlib.crc32(t.encode()) if t is not None else None) for d, t in rows) == Counter((r.doc_id, r["size"], r.text_crc32) for r in out)
    slots, loads, where = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        where[r.text_crc32, r["size"]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return loads


def test_documents(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randrange(1, 60) + str(rng.randrange(300))) for i in range(700)] + [(1000 + i, "hot text") for i in range(400)] + [(5, None), (None, "x"), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(spark, df, 6).collect()
    loads = check(rows, out, 6)
    groups = df.selectExpr("xxhash64(text) h", "coalesce(octet_length(text), 0) + 8 s").groupBy("h").sum("s").orderBy("h").collect()
    assert max(loads.values()) == brute_capacity([g[1] for g in groups], 6)


def test_zoom_reaches_single_groups(spark):
    # all groups in one 16-bit cell: only refining can find the cuts
    groups = spark.range(200).selectExpr("id * 3 + 7 as h", "1 + id % 13 as w", "1L as c")
    sizes = [1 + i % 13 for i in range(200)]
    cuts, capacity = sharding.solve(groups, 8)
    assert capacity == brute_capacity(sizes, 8) and len(cuts) == 7


def test_heavy_groups_leave_no_shard_empty(spark):
    rng = random.Random(4)
    small = [(i, "x" * rng.randrange(1, 90) + str(i)) for i in range(2000)]
    for heavy in ([(5000 + i, "hot text") for i in range(4000)], [(9000, "y" * 40_000), (9001, "z" * 15_000), (9002, None)] + [(None, "q")] * 900):
        rows = small + heavy
        out = sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
        loads = check(rows, out, 24)
        sizes = Counter()
        for _, t in rows:
            sizes[t] += len((t or "").encode()) + 8
        biggest, total = max(sizes.values()), sum(sizes.values())
        assert len(loads) == 24 and max(loads.values()) == biggest
        if sum(v * 24 > total for v in sizes.values()) == 1:  # a run between two heavy groups may be short
            rest = sorted(loads.values())[:-1]
            assert max(rest) < 1.2 * min(rest)


def test_plans_stay_within_the_smallest_capacity():
    rng = random.Random(12)
    for _ in range(400):
        sizes = [rng.choice([1, 2, 9, 300]) * rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))]
        shards = rng.randrange(1, 9)
        cells = np.array([[i, 64, w, w, 1] for i, w in enumerate(sizes)])
        ends, capacity, opened = sharding._plan(cells, 0, len(sizes), shards)
        loads = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        assert not opened and len(ends) == shards and ends[-1] == len(sizes) and ends == sorted(ends)
        assert max(loads) <= capacity == brute_capacity(sizes, shards)


def test_few_groups_and_empty(spark):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    check(rows, sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 24).collect(), 24)
    assert sharding.shard_documents(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
