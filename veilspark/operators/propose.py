"""Proposed denylist terms with their reasons and counts; never applied by themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filename_phrase, normalized, redactable
from ..policy import Policy, java
from .labels import LABEL_VALUE, following_counts, is_firm, label_value
from .layout import tasks
from .suppress import proposal_rejection

_ANY_LABEL = java(r"^[A-Za-z][A-Za-z/&'. -]{1,38}:\s+(\S.*)$")


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions refer to and never repeat: a generator keeps the optimizer from inlining it."""
    return df.withColumn(name, F.explode(F.array(value)))


def without_label(x: Column) -> Column:
    """The value behind a label at the start of a phrase, else the phrase."""
    value = normalized(F.when(x.rlike(LABEL_VALUE), F.regexp_extract(x, LABEL_VALUE, 1)).when(x.rlike(_ANY_LABEL), F.regexp_extract(x, _ANY_LABEL, 1)))
    return F.when(value.isNotNull() & redactable(value, True), value).otherwise(x)


def propose_terms(lines: DataFrame, policy: Policy, paths: DataFrame | None = None) -> DataFrame:
    """lines(doc_id, ord, text, x0..y1) to (term, occurrences, reasons), in the terms' order."""
    text = normalized(F.col("text"))
    parts = [
        (lines.select(label_value(text).alias("value")).where("value is not null"), "labelled_value"),
        (following_counts(lines), "label_following_line"),
        (lines.where(is_firm(text)).select(text.alias("value")), "firm_name_pattern"),
    ]
    if paths is not None:
        parts.append((paths.select(filename_phrase(F.col("path")).alias("value")).where("value is not null"), "source_filename"))
    reasons = [why for _, why in parts]  # a bit each
    every = reduce(DataFrame.union, [p.select("value", (F.col("labels") if "labels" in p.columns else F.lit(1)).cast("long").alias("n"), F.lit(1 << k).alias("why")) for k, (p, _) in enumerate(parts)])
    every = every.groupBy("value").agg(F.sum("n").alias("n"), F.bit_or("why").alias("why")).repartition(tasks(lines))  # each distinct phrase is examined once, by all cores
    every = computed(every, "term", normalized(F.col("value")))
    for step in ("once", "twice"):  # up to two labels
        every = computed(every, step, without_label(F.col("term"))).drop("term").withColumnRenamed(step, "term")
    every = every.where(redactable(F.col("term"), True))
    words = F.size(F.regexp_extract_all("term", F.lit(java(r"\w+")), F.lit(0)))
    every = every.where((words >= 2) & (F.length(F.regexp_replace("term", r"[^\p{L}\p{Nd}]", "")) >= 7))
    every = computed(every, "rejected", proposal_rejection(F.col("term"), policy)).where("rejected is null")
    every = every.groupBy("term").agg(F.sum("n").alias("occurrences"), F.bit_or("why").alias("why"))
    named = F.filter(F.array(*[F.when(F.col("why").bitwiseAND(1 << reasons.index(w)) != 0, F.lit(w)) for w in sorted(reasons)]), lambda w: w.isNotNull())
    return every.select("term", "occurrences", named.alias("reasons")).orderBy(F.lower("term"), "term")
