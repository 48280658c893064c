"""Minimax contiguous partition of ordered atomic groups into shards.

Groups are equal texts (by 64-bit hash, which is also their order).  The smallest capacity for which
a greedy pass needs no more than ``shards`` shards is found by binary search; it bounds every shard.  Within that capacity each cut is as near to an even share as it can be.
Where one group alone sets the capacity, that group gets a shard, and the runs before and after it share the other shards by size and are solved again, within the same capacity.

The search runs on the driver over at most 65,536 *cells* (ranges of the hash space with their
sums) and a refinement of the few cells in which a cut can fall, 16 bits at a time, until those cells are single
groups.  So the result is exact, and what reaches the driver doesn't grow with the number of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def greedy_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive cell indexes) of the shards when each takes all that fits; None if it needs more shards."""
    ends, taken, total = [], 0, len(prefix)
    while len(ends) < shards:
        at = int(np.searchsorted(prefix, (prefix[taken - 1] if taken else 0) + capacity, side="right"))
        ends.append(at)
        if at == total:
            return ends + [total] * (shards - len(ends))
        if at == taken:
            return None
        taken = at
    return None


def even_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of the shards for a feasible capacity: each as near to an even share of what is left as the capacity allows."""
    n, total, latest = len(prefix), int(prefix[-1]), [len(prefix)]
    for _ in range(shards - 1):  # the earliest begin of the last 1, 2, ... shards
        before = (int(prefix[latest[-1] - 1]) if latest[-1] else 0) - capacity
        latest.append(0 if before <= 0 else int(np.searchsorted(prefix, before, side="left")) + 1)
    ends, taken = [], 0
    for left in range(shards, 0, -1):
        done = int(prefix[taken - 1]) if taken else 0
        most = int(np.searchsorted(prefix, done + capacity, side="right"))
        share = done + (total - done) / left
        at = int(np.searchsorted(prefix, share, side="left"))
        lower = int(prefix[at - 1]) if at else 0
        at += at < n and int(prefix[at]) - share <= share - lower
        at = max(at, latest[left - 1], min(taken + 1, n))
        at = max(min(at, most, n - (left - 1)), latest[left - 1], taken)
        ends.append(taken := n if left == 1 else at)
    return ends


def smallest_capacity(prefix: np.ndarray, least: int, shards: int) -> int:
    """Smallest feasible capacity of at least ``least``, by binary search."""
    low, high = max(1, least), max(int(prefix[-1]), 1) if len(prefix) else 1
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _cells(groups: DataFrame, bits: int) -> np.ndarray:
    """(first key, bits, size, largest group, groups), in key order."""
    got = groups.groupBy(F.expr(f"shiftright(h, {64 - bits})").alias("cell")).agg(F.sum("w").alias("w"), F.max("w").alias("most"), F.count("*").alias("n")).toArrow()
    columns = [got[c].to_numpy() for c in ("cell", "w", "most", "n")]
    at = np.argsort(columns[0])
    cell, w, most, n = (c[at].astype(np.int64) for c in columns)
    return np.stack([cell << np.int64(64 - bits), np.full(len(cell), bits), w, most, n], axis=1) if len(cell) else np.empty((0, 5), dtype=np.int64)


def _open_cells(cells: np.ndarray, shards: int, low: int, high: int) -> np.ndarray:
    """Indexes of cells of several groups in which a cut may fall for some capacity from low to high."""
    prefix = np.cumsum(cells[:, 2])
    total, first, last, found = int(prefix[-1]), 0, 0, np.zeros(len(cells), dtype=bool)
    for _ in range(shards):
        at = int(np.searchsorted(prefix, first + low, side="right"))
        first, last = int(prefix[at - 1]) if at else 0, min(total, last + high)
        a, b = int(np.searchsorted(prefix, first, side="right")), int(np.searchsorted(prefix, last, side="left"))
        found[a : b + 1] = True
    return np.flatnonzero(found & (cells[:, 4] > 1) & (cells[:, 1] < 64))


def _plan(cells: np.ndarray, begin: int, end: int, shards: int) -> tuple[list[int], int, set[int]]:
    """(ends of the shards of cells begin..end, their capacity, cells that must be opened before this is exact)."""
    part = cells[begin:end]
    prefix = np.cumsum(part[:, 2])
    total, heaviest = int(prefix[-1]), int(part[:, 3].max())
    low = max(heaviest, -(-total // shards))
    high = smallest_capacity(prefix, low, shards)
    opened = {begin + int(i) for i in _open_cells(part, shards, low, high)}
    ends = [begin + e for e in even_cuts(prefix, high, shards)]
    if opened or shards < 3 or high > heaviest or heaviest * shards <= total:
        return ends, high, opened
    heavy = begin + int(np.argmax(part[:, 3]))
    if cells[heavy, 4] > 1:
        return ends, high, {heavy}
    sides = [(a, b) for a, b in ((begin, heavy), (heavy + 1, end)) if a < b]
    if not sides or len(sides) > shards - 1:
        return ends, high, opened
    weight = [int(cells[a:b, 2].sum()) for a, b in sides]
    given = [1] * len(sides)
    for _ in range(shards - 1 - len(sides)):  # each further shard to the side whose shards are largest
        k = max(range(len(sides)), key=lambda i: weight[i] / given[i])
        given[k] += 1
    plans = [_plan(cells, a, b, n) for (a, b), n in zip(sides, given, strict=True)]
    opened = set().union(*(p[2] for p in plans))
    if not opened and max(p[1] for p in plans) > high:
        return ends, high, opened
    cuts = sorted([e for p in plans for e in p[0]] + [heavy, heavy + 1])
    cuts = sorted({*cuts} - {begin})
    return cuts + [end] * (shards - len(cuts)), high, opened


def solve(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First key of shards 1.. (shard 0 begins at the lowest key), and the capacity."""
    cells = _cells(groups, 16)
    if not len(cells):
        return [], 0
    while True:
        ends, capacity, opened = _plan(cells, 0, len(cells), shards)
        if not opened:
            return [int(cells[e, 0]) for e in ends[:-1] if e < len(cells)], capacity
        at = np.array(sorted(opened))
        bits = int(cells[at, 1].min())
        at = at[cells[at, 1] == bits]
        # as an Arrow table: a list would be read by Python workers, which then stay with the executors
        wanted = groups.sparkSession.createDataFrame(pa.table({"cell": pa.array([int(k) >> (64 - bits) for k in cells[at, 0]], pa.int64())}))
        finer = _cells(groups.withColumn("cell", F.expr(f"shiftright(h, {64 - bits})")).join(F.broadcast(wanted), "cell", "left_semi"), bits + 16)
        cells = np.concatenate([np.delete(cells, at, axis=0), finer])
        cells = cells[np.argsort(cells[:, 0], kind="stable")]


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of ``docs``.

    size is the text's UTF-8 bytes plus 8; a null text counts 8 and its checksum is null, and null texts
    are one group.  Empty shards are left only where there are fewer groups than shards; an empty table gives no rows.
    Slots number a shard's rows from 0, by ranges of groups (and by parts of a crowded range), in it by group.  Repeated rows and
    null ids have slots of their own; further columns play no part.  The law is ``bytes``.
    What the driver holds and what is broadcast is at most 131,072 rows of 40 bytes: cells, and parts of cells.
    """
    scratch = Scratch(spark)
    rows = scratch.save(
        docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("pos")),
        "rows",
    )
    groups = scratch.save(rows.groupBy("h").agg(F.sum("size").alias("w"), F.count("*").alias("c")), "groups")
    cuts, _ = solve(groups, shards)
    keys = ", ".join(f"{c}L" if c > -(1 << 63) else "(-9223372036854775807L - 1L)" for c in cuts)
    shard = F.expr(f"size(filter(array({keys}), k -> k <= h))") if cuts else F.lit(0)
    # ranks: rows are dealt by (cell, salt), a cell of many rows to many salts; at most 2 * 65,536 of them
    total = rows.count()
    share = max(16, total >> 16)
    crowded = groups.groupBy(F.expr("shiftright(h, 48)").alias("cell")).agg(F.sum("c").alias("c")).where(F.col("c") > share).select("cell", F.expr(f"cast(c div {share} as int) + 1").alias("salts"))
    placed = rows.withColumn("cell", F.expr("shiftright(h, 48)")).join(F.broadcast(crowded), "cell", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "h", "pos", "cell", shard.cast("int").alias("shard"), F.expr("cast(pmod(xxhash64(pos), coalesce(salts, 1)) as int)").alias("salt"))
    counts = placed.groupBy("shard", "cell", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "salt").orderBy("h", "doc_id", "pos"))
    out = placed.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "cell", "salt"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, where: str) -> None:
    """Write the documents themselves, one folder a shard, in slot order."""
    full = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(where)
