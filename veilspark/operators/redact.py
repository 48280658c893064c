"""Text redaction: every kept span is masked; overlapping spans are merged first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, category): islands of overlapping or nested spans, with the category of the first by (start, ord)."""
    order = [F.col("start"), F.col("ord"), F.col("end").desc()]
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = found.withColumn("__new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    x = x.withColumn("__island", F.sum("__new").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("category", F.struct("start", "ord")).alias("category")).drop("__island")


def _rebuilt(text: Column, spans: Column) -> Column:
    """The text with array<struct<start, end, by>> in order replaced."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), s["by"]).alias("out")),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )


def merged_in(found: Column) -> Column:
    """``merged_spans`` of one text's array<struct<category, ord, start, end, ...>>: array<struct<start, end, category>>."""
    order = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["ord"].alias("ord"), (-m["end"]).alias("last"), m["category"].alias("category"))))
    kind = "array<struct<start:int,end:int,category:string>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        new = F.struct(s["start"].alias("start"), (-s["last"]).alias("end"), s["category"].alias("category"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], -s["last"]).alias("end"), last["category"].alias("category"))
        return F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))

    return F.aggregate(order, F.array().cast(kind), add)


def redact_in(text: Column, found: Column, mask: str | None = None) -> Column:
    """``redact`` of one text by the matches in an array, without a join."""
    by = lambda s: F.concat(F.lit("["), F.upper(s["category"]), F.lit("]")) if mask is None else F.repeat(F.lit(mask), s["end"] - s["start"])
    return F.when(F.size(found) > 0, _rebuilt(text, F.transform(merged_in(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by"))))).otherwise(text)


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mask: str | None = None) -> DataFrame:
    """docs with every span of ``found(key, category, ord, start, end)`` replaced by ``[CATEGORY]`` (or by ``mask`` for each character).

    Rows without spans are unchanged. Replacements match no pattern, so a second pass finds nothing new in them.
    """
    by = F.concat(F.lit("["), F.upper("category"), F.lit("]")) if mask is None else F.repeat(F.lit(mask), F.col("end") - F.col("start"))
    spans = merged_spans(found, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", by.alias("by")))).alias("__spans"))
    out = docs.join(spans, key, "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(_rebuilt(F.col(text), F.col("__spans"))))
    return out.select(*docs.columns)
