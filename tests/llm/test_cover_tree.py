import numpy as np
import pytest

from veilspark.llm import cover_tree


def brute(ids, vectors, least=0.95):
    good = [i for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, parent = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in good:
        for j in good:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], dtype=float), np.array(vectors[j], dtype=float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], low[find(i)], ids[i] == low[find(i)]) for i in range(len(ids)))


def clusters(seed, groups, size, dims, noise):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(size=dims)
        out += [(base + rng.normal(size=dims) * noise * rng.random()).astype(np.float32).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("noise", [0.02, 0.25, 0.6])
def test_trees_find_every_link(noise):
    x = np.array(clusters(1, 12, 40, 8, noise), dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = np.arange(1, len(x) + 1)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    links, root = cover_tree.link(cover_tree.CoverTree(x), m, None, None, 0.95)
    assert (links == hit @ m).all()
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(hit), strict=True))
    a, b = x[:200], x[200:]
    links, root = cover_tree.link(cover_tree.CoverTree(a), m[:200], cover_tree.CoverTree(b), m[200:], 0.95)
    hit = a @ b.T >= 0.95
    assert (links == np.r_[hit @ m[200:], m[:200] @ hit]).all()
    assert len(set(root)) >= len(set(root[:200]))


def test_table(spark):
    vectors = clusters(2, 10, 12, 16, 0.3) + clusters(3, 1, 60, 16, 0.1)
    vectors += [vectors[0]] * 30 + [[2 * c for c in vectors[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [2.0, 0.0]]
    ids = np.random.default_rng(0).permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as n_links")
    want = brute(ids, vectors)
    for options in ({"capacity": 50}, {"capacity": 7, "most_nodes": 3}, {"capacity": 9, "lengths": 1}, {}):
        assert sorted(tuple(r) for r in cover_tree.embedding_near_duplicates(spark, df, **options).collect()) == want
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # groups over many batches, and chunks of visitors
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        assert sorted(tuple(r) for r in cover_tree.embedding_near_duplicates(spark, df, capacity=2).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_many_lengths(spark):
    vectors = [v[: 1 + i % 40] for i, v in enumerate(clusters(5, 30, 12, 40, 0.2))]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in cover_tree.embedding_near_duplicates(spark, df, capacity=20, lengths=16).collect()) == brute(ids, vectors)


def test_rows_dealt_stay_bounded_for_vectors_in_groups(spark):
    from veilspark.llm.scratch import Scratch

    shares = []
    for groups in (40, 400):
        vectors = clusters(6, groups, 20, 32, 0.05)
        keys = np.random.default_rng(1).permutation(len(vectors)).tolist()  # hashes in the operator
        df = spark.createDataFrame([(i, 1, v, 32) for i, v in zip(keys, vectors, strict=True)], "key long, m long, embedding array<float>, dims int")
        dealt = cover_tree.cells_of(spark, Scratch(spark), df, {32: len(vectors)}, 0.95, 4096, 20, 1024)
        shares.append(dealt.count() / len(vectors))
    assert shares[0] < 1.5 and shares[1] < 1.5


def test_empty_and_useless(spark):
    assert cover_tree.embedding_near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    df = spark.createDataFrame([(4, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, cover_tree.embedding_near_duplicates(spark, df).collect())) == [(2, 0, 2, True), (4, 0, 4, True)]
