"""What the llm operators leave in an executor's memory."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from veilspark.llm import sharding
from veilspark.llm.ngram_join import NgramJoin


def test_sets_are_written_and_read_in_small_pieces(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(map(str, rng.integers(0, 10**9, 8000)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    join = NgramJoin(spark)
    classes = join._measure(docs).where("kind = 0").selectExpr("key", "id as rep")
    known = join._sets(classes.select("key"), docs, classes)
    assert known.count() == 300 and known.selectExpr("sum(length(tokens)) = 8 * sum(n)").first()[0]
    read = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in known.inputFiles()]
    groups = [m.row_group(i) for m in read for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 300 and sum(g.total_byte_size for g in groups) > 20 << 20
    assert max(g.total_byte_size for g in groups) < 10 << 20
    assert {g.column(c).compression for g in groups for c in range(g.num_columns)} == {"UNCOMPRESSED"}
    kept = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    try:
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
        join.result(docs.limit(2)).collect()
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    finally:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", kept)


def test_a_worker_gives_its_free_memory_back():
    code = """
import re, numpy as np
from veilspark.llm.scratch import giving_back
used = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def work(batches):
    for _ in batches:
        parts = [np.ones(12_000) for _ in range(1000)]
        last.append(np.ones(12_000))  # what stays lies above what is free
        del parts
        yield 1
last = []
assert list(giving_back(work)([1, 2])) == [1, 1]
before = used()
assert list(work([1, 2])) == [1, 1]
print(used() - before)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=60).stdout) > 40


def test_cells_to_refine_need_no_python_workers(spark, monkeypatch):
    kinds, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: kinds.append(type(data)) or make(self, data, *a, **k))
    groups = spark.range(200).selectExpr("id * 3 + 7 as h", "1 + id % 13 as w", "1L as c")
    cuts, _ = sharding.solve(groups, 8)
    assert len(cuts) == 7 and kinds and set(kinds) == {pa.Table}
