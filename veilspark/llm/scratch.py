"""Shared scratch tables, bounded filters and small helpers of the llm operators.

Intermediate results are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read them, so a lost executor costs a reread and
never a result.  Only where no such folder is set and the master is local (tests) one is made.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix


#: For tables of wide values that don't compress (sets of hashes): a writer holds one row group, so small ones; no dictionary, no codec's buffers.
_WIDE = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "10", "parquet.page.size.row.check.min": "10", "parquet.enable.dictionary": "false", "compression": "none"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, a temporary one in a local session and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scratch-"))
    return context.getCheckpointDir()


class Scratch:
    """A folder of intermediate tables; it is deleted when the session ends, single tables earlier by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._fs(self.top).deleteOnExit(self._path(self.top))

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self, where: str):
        return self._path(where).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, rows: int | None = None, each: int = 500_000, wide: bool = False) -> DataFrame:
        """Write and reread: cuts the lineage, and fixes what later steps see.

        The shuffle files of the write go as soon as it ends, not when the driver happens to collect its garbage.
        ``rows``: about how many narrow rows there will be; tasks of the last stage are joined until each writes about ``each``,
        so that many shuffle partitions don't become many small files.  ``wide``: rows of kilobytes that don't compress.
        """
        if rows is not None:
            df = df.coalesce(1 + rows // each)
        where = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**_WIDE if wide else {}).parquet(where)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for t in tables:
            self._fs(t._scratch_path).delete(self._path(t._scratch_path), True)


def _positions(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(ids.view(np.uint64), 501 + k) & np.uint64(bits - 1) for k in range(3)]


def bloom_of(ids: DataFrame, column: str, most_bits: int = 1 << 27) -> np.ndarray:
    """A Bloom filter (as words of 64 bits) of the non-null longs in ``column``.

    About 16 bits an id and never over ``most_bits`` (16 MB by default), so its size is bounded
    whatever the input and it may be broadcast.  A full filter only lets more rows through; the
    exact join that follows every use removes them.
    """
    ids = ids.select(column).where(F.col(column).isNotNull())
    bits = min(most_bits, max(1 << 13, 1 << (16 * ids.count()).bit_length()))

    def words(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits)))
            word = (at >> np.uint64(6)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, dtype=np.int64)
            flags = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(word) else np.empty(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(word[starts]), pa.array(flags.view(np.int64))], names=["word", "flags"])

    got = ids.mapInArrow(giving_back(words), "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["flags"].to_numpy()
    return out.view(np.uint64)


def in_bloom(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids may be in the filter; never False for one that is."""
    out = np.ones(len(ids), dtype=bool)
    for at in _positions(ids, len(bloom) * 64):
        out &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bounded_batches(spark: SparkSession, size: str = "4m", rows: int = 512) -> None:
    """Bounds the Arrow batches that go to Python in bytes, and those of Parquet's reader in rows, so that long texts or sets stay small in memory.

    The reader holds a batch's values of a column in one array that doubles as it grows: 4,096 sets of 7 kB are 64 MB in one piece.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def giving_back(work):
    """``work`` of a mapInArrow whose worker returns its free memory when a task ends: idle workers count as their executor's memory."""

    def trimmed(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return trimmed


__all__ = ["Scratch", "bloom_of", "bounded_batches", "giving_back", "in_bloom", "shared_folder"]
