import random
import re
from collections import Counter

from veilspark.llm.ngram_join import NgramJoin, keep_first, prefix_size, without_ids


def brute(rows, width=5):
    """(n_shingles, component_id) by comparing every pair of whole sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 75 * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(rng, n, words=60, edits=2):
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in NgramJoin(spark, **options).result(df).collect())


def test_prefix_size():
    assert [prefix_size(n, 75, 100) for n in (1, 2, 3, 4, 5, 100)] == [1, 1, 1, 2, 2, 26]


def test_groups_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 90, edits=4) + near_copies(rng, 40, 30, 3) + near_copies(rng, 12, 200, 12)
    passage = " ".join(f"p{i}" for i in range(12))
    texts += [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts += ["One two", "one  TWO\n", "one", "", " \t\n", None, "a b c d e", "A B C D E", "İx É é É"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows, least_frequent=20) == brute(rows)
    assert run(spark, rows, least_frequent=5, tile=16, crowd=4, few=0) == brute(rows)


def test_driver_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_lists_over_many_small_batches(spark):
    # runs that cross batch borders, repeated rows on both sides of a border
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(6), 5, rng.choice((0, 0, 1))) for _ in range(3000)]
    rows = [(t, k, n, 0 if t % 3 else s) for t, k, n, s in rows] + [(1000 + t, 1, 5, 0) for t in range(50)]
    once = set(rows)
    length = Counter((t, s) for t, _, _, s in once)
    want = sorted((t, k, n) for t, k, n, s in once if s or length[t, s] > 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = NgramJoin(spark)._lists(spark.createDataFrame(rows, "token long, key long, n int, salt int")).collect()
            assert sorted(tuple(r) for r in got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tiles_over_small_batches_and_many_partitions(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 60, edits=5) + near_copies(rng, 50, 40, 6)
    texts += [" ".join(f"p{i}" for i in range(14)) + f" x{rng.randrange(10**6)} y{rng.randrange(10**6)}" for _ in range(60)]
    rows = list(enumerate(texts))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        assert run(spark, rows, least_frequent=5, tile=16, crowd=4) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_orders_are_intersected_before_sets_are_compared(spark):
    # sizes fit and the first order lets the pairs pass, but few shingles are shared
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, shared + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(60))) for i in range(12)]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rng, 4, 80, 1))]
    join = NgramJoin(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    measured = join._measure(docs).where("kind = 0").select("id", "key").collect()
    key = {r.id: r.key for r in measured}
    classes = spark.createDataFrame([(k, d) for d, k in key.items()], "key long, rep long")
    known = join._sets(classes.select("key"), docs, classes)
    pairs = spark.createDataFrame([(key[a], key[b]) for a in key for b in key if a < b and (a < 100) == (b < 100)], "a long, b long")
    left = {tuple(r) for r in join._filtered(pairs, known).collect()}
    assert not any((key[a], key[b]) in left for a in range(12) for b in range(12))
    assert {tuple(r) for r in join._compare(pairs, known).collect()} <= left


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == []
    rows = [(3, "x y z"), (3, "x y z"), (1, "q"), (1, None)]
    assert run(spark, rows) == [(1, 0, 1), (1, 1, 1), (3, 1, 3), (3, 1, 3)]


def test_null_ids_and_further_columns(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (7, "A b c d e f g"), (8, None)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, key int, component_id string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in NgramJoin(spark).result(docs).collect())
    assert got == [(0, 3, None), (0, 3, None), (3, 3, 3), (7, 3, 3), (8, 0, 8)]
    kept = keep_first(spark, docs.union(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 8]


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, "x" * 2_000_000), (4, " ".join(words[:100_000]))]
    got = run(spark, rows)
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_without_ids(spark):
    docs = spark.createDataFrame([(i % 500 if i % 50 else None, f"t{i}") for i in range(1000)], "doc_id int, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "doc_id long")
    want = sorted((r.doc_id or -1, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id % 3)
    for few in (1000, 0):
        out = without_ids(spark, docs.withColumn("more", docs.text), gone, few)
        assert out.columns == ["doc_id", "text", "more"]
        assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == want
