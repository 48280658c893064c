import random
import re
from collections import Counter, defaultdict

from veilspark.llm import mixing


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        over = {s for s in free if target[s] + left * weight[s] / total >= 2 * sizes[s] - 1e-9}
        if not over:
            for s in free:
                target[s] += left * weight[s] / total
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in sizes if s not in free)
        for s in free:
            target[s] = 0.0
    return target


def make(seed, n):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", "é", None, "hot", "hot", "hot", "hot"]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 40, 200]))), rng.choice(sources)) for i in range(n)]


def test_targets_and_taken(spark):
    rows = make(1, 3000) + [(9000, None, "a"), (9001, "x y z", "b"), (7, "again and again", "hot"), (7, "again and again", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute_targets(dict(sizes))
    out = mixing.mix_report(spark, df).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in out:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 210, (s, taken[s], target[s])
    again = mixing.mix_report(spark, df.repartition(3)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_rounding_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 5), "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    total, runs = Counter(), 6
    for seed in range(runs):
        for r in mixing.mix_report(spark, df, seed=seed, fan=4).collect():
            total[r.doc_id] += r.taken // r["size"]
    assert abs(sum(total.values()) / len(rows) / runs - 1.5) < 0.1
    assert len(set(total.values())) > 3


def test_documents_keep_their_columns(spark):
    rows = make(2, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as copies", "3 as target")
    out = mixing.mix_documents(spark, df)
    assert out.columns == df.columns
    report = mixing.mix_report(spark, df).collect()
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in report if r["size"] and r.taken})


def test_rows_without_words_are_never_taken(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "a"), (None, "x y z", None), (5, None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix_documents(spark, df).collect()} <= {4, None}
    assert {r.doc_id: r.taken for r in mixing.mix_report(spark, df).collect() if r.doc_id not in (4, None)} == {1: 0, 2: 0, 3: 0, 5: 0}


def test_targets_of_many_sources(spark):
    from veilspark.llm.scratch import Scratch

    rng = random.Random(9)
    sizes = {f"s{i:04}": rng.choice([0, 1, 5, 1000, rng.randrange(10**6)]) for i in range(700)} | {None: 77, "é": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r.source: r.target for r in mixing.source_targets(df, Scratch(spark)).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_empty(spark):
    assert mixing.mix_report(spark, spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
