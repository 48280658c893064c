"""The adapter for a named-entity model: a plain callable predict(texts, labels, threshold) in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<start:int,end:int,label:string,score:double>>"


def chunks(text: Column, most: int = 1000, least: int = 12) -> Column:
    """array<struct<offset, text>>: whole lines packed up to ``most`` characters (a longer line alone), without chunks of few letters and digits."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,text:string>>").alias("out"))

    def pack(acc, line):
        last = F.try_element_at(acc["out"], F.lit(-1))
        fits = (F.size(acc["out"]) > 0) & (F.length(last["text"]) + 1 + F.length(line) <= most)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["offset"].alias("offset"), F.concat(last["text"], F.lit("\n"), line).alias("text"))))
        fresh = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("offset"), line.alias("text"))))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(fits, grown).otherwise(fresh).alias("out"))

    packed = F.aggregate(lines, start, pack, lambda acc: acc["out"])
    return F.filter(packed, lambda c: F.length(F.regexp_replace(c["text"], r"[^\p{L}\p{Nd}]", "")) >= least)


def find_entities(docs: DataFrame, load: Callable[[], Callable], labels: tuple[str, ...], threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, label, score, match): the model's findings over whole texts, in chunks; invalid spans go.

    ``load`` returns the model once for each worker's iterator, and fails there before any text is read.
    """

    @F.pandas_udf(KIND)
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield pd.Series([[dict(start=int(e["start"]), end=int(e["end"]), label=e["label"], score=float(e["score"])) for e in found] for found in predict(texts.tolist(), list(labels), threshold)])

    parts = docs.select(key, F.explode(chunks(F.col(text))).alias("c")).select(key, F.col("c.offset").alias("offset"), F.col("c.text").alias("chunk"))
    found = parts.withColumn("e", F.explode(model("chunk"))).where("e.start >= 0 and e.end > e.start and e.end <= length(chunk)")
    return found.select(key, (F.col("e.start") + F.col("offset")).alias("start"), (F.col("e.end") + F.col("offset")).alias("end"), F.col("e.label").alias("label"), F.col("e.score").alias("score"), F.expr("substring(chunk, e.start + 1, e.end - e.start)").alias("match"))
