"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size gives each of its documents the same expected number of copies.  The whole part
is certain; the fractional parts are rounded in pairs: between two documents as many words as possible move from
one probability to the other, with chances that keep both expectations, until one becomes 0 or 1.  Moved words, not
probabilities, are conserved, so a source's taken words differ from its target by the last residual document at most.

Pairing is a tree: documents are dealt by hash into groups of ``fan``; a group is folded to one residual;
residuals are dealt into groups again.  No task ever holds more than a group, whatever a source's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
_ITEM = "struct<size: bigint, doc_id: bigint, th: bigint, m: bigint, p: double>"
_DONE = "array<struct<doc_id: bigint, th: bigint, m: bigint, size: bigint, up: int>>"


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all sizes; no target
    is over ``most`` times its source's size, and the excess goes to the others by weight.  The fixed point is
    ``min(most * size, level * weight)``: the level rises from the even share as sources reach their bound, which ends when no more do.

    Sources are ranked in ranges, from counts of the ranges, so that any number of them is dealt over tasks.
    """
    name = F.col("source").asc_nulls_last()
    dealt = scratch.save(sizes.select("source", "source_size").repartitionByRange(name).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("part").count().collect())  # a row for each range
    starts = [0]
    for part in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(part, 0))
    place = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = scratch.save(dealt.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("r", F.col("cap") / F.col("w")), "weights")
    level, before = 0.0, -1.0
    while level != before:  # sums of whole numbers: exact, whatever their order
        before, full = level, F.col("r") <= F.lit(level)
        size, capped, free = t.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        level = max(level, (share * size - capped) / free) if free else level
    return t.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target") if level else F.lit(0.0).alias("target"))


def _fold(seed: int) -> str:
    """One group's items, largest first, to (carry, done)."""
    flows = "named_struct('a', acc.carry, 'b', x, 'd1', least(acc.carry.p * acc.carry.size, (1 - x.p) * x.size), 'd2', least((1 - acc.carry.p) * acc.carry.size, x.p * x.size), 'u', shiftrightunsigned(xxhash64(acc.carry.doc_id, acc.carry.th, x.doc_id, x.th, {seed}L), 11) * 1.1102230246251565e-16D)".replace("{seed}", str(seed))
    item = "named_struct('size', {k}.size, 'doc_id', {k}.doc_id, 'th', {k}.th, 'm', {k}.m, 'p', greatest(0D, least(1D, {p})))"
    done = "named_struct('doc_id', {k}.doc_id, 'th', {k}.th, 'm', {k}.m, 'size', {k}.size, 'up', {up})"

    def step(carry: str, p: str, ended: str, up: int) -> str:
        return f"named_struct('carry', {item.format(k=carry, p=p)}, 'done', concat(acc.done, array({done.format(k=ended, up=up)})))"

    give = f"if(t.a.p * t.a.size <= (1 - t.b.p) * t.b.size, {step('t.b', 't.b.p + t.d1 / t.b.size', 't.a', 0)}, {step('t.a', 't.a.p - t.d1 / t.a.size', 't.b', 1)})"
    take = f"if((1 - t.a.p) * t.a.size <= t.b.p * t.b.size, {step('t.b', 't.b.p - t.d2 / t.b.size', 't.a', 1)}, {step('t.a', 't.a.p + t.d2 / t.a.size', 't.b', 0)})"
    merge = f"if(acc.carry is null, named_struct('carry', x, 'done', acc.done), element_at(transform(array({flows}), t -> if(t.u * (t.d1 + t.d2) < t.d2, {give}, {take})), 1))"
    return f"aggregate(items, named_struct('carry', cast(null as {_ITEM}), 'done', cast(array() as {_DONE})), (acc, x) -> {merge})"


def mix_units(spark: SparkSession, docs: DataFrame, seed: int = 17, fan: int = 64, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, th, size, m, source_size, target, copies) for each distinct row; m: how often it occurs.

    th is the hash of the text.  Equal rows are one unit that is taken or left as a whole.
    """
    scratch = Scratch(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("th"), size.alias("size"))
    units = scratch.save(rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("m")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    sources = scratch.save(source_targets(sources, scratch, weights, share, most).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "sources")
    most_units = sources.agg(F.max("n")).first()[0] or 0
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = full.withColumn("base", F.floor(per + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), per - F.col("base")))
    loose = (F.col("p") > 1e-12) & (F.col("size") > 0)
    work = full.where(loose).select("source", F.expr(f"pmod(xxhash64(doc_id, th, {seed}L), n div {fan} + 1)").alias("bucket"), F.expr("named_struct('size', size * m, 'doc_id', doc_id, 'th', th, 'm', m, 'p', p)").alias("item"))
    buckets, decided = most_units // fan + 1, []
    while True:
        level = work.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        level = scratch.save(level.select("source", "bucket", F.expr(_fold(seed)).alias("f")), "level")
        decided.append(level.select("source", F.explode("f.done").alias("d")))
        if buckets == 1:
            break
        buckets = (buckets - 1) // fan + 1
        work = level.select("source", F.expr(f"bucket div {fan}").alias("bucket"), F.col("f.carry").alias("item"))
    # the last residual of a source goes to the nearer side
    decided.append(level.select("source", F.expr("named_struct('doc_id', f.carry.doc_id, 'th', f.carry.th, 'm', f.carry.m, 'size', f.carry.size, 'up', cast(f.carry.p >= 0.5 as int))").alias("d")))
    ups = decided[0]
    for d in decided[1:]:
        ups = ups.union(d)
    ups = ups.select("source", "d.doc_id", "d.th", "d.m", F.expr("d.size div d.m").alias("size"), "d.up").union(full.where(~loose).select("source", "doc_id", "th", "m", "size", F.lit(0).alias("up")))
    out = ups.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.when(F.col("size") > 0, F.floor(per + 1e-12).cast("int") + F.col("up")).otherwise(0)
    return out.select("doc_id", "source", "th", "size", "m", "source_size", "target", copies.alias("copies"))


def mix_report(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row for each row of ``docs``.

    A null text has size 0 and is never taken; a source of size 0 has target 0; a null source is a source of its own;
    an empty table gives an empty result.
    """
    units = mix_units(spark, docs, **options)
    out = units.withColumn("taken", F.col("copies") * F.col("size")).withColumn("one", F.explode(F.expr("sequence(1L, m)")))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is taken, with the columns of ``docs``.

    Texts that are null or have no words have size 0 and are never taken; a null source is a source of its own, rows with a null
    doc_id are taken like others; repeated rows are taken or left together; an empty table stays empty.
    """
    units = mix_units(spark, docs, **options).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("th").alias("__th"), F.col("copies").alias("__copies"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__th"))
    return docs.join(units, same).withColumn("__k", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)
