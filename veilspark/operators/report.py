"""Counts, caps and states of reports; counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capped


def sorted_counts(df: DataFrame, keys: list[str], of: str) -> DataFrame:
    """(keys, counts): a map of counts by value, key-sorted."""
    counted = df.groupBy(*keys, of).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n")))).alias("counts"))


def rule_counts(suppressed: DataFrame, rule: str = "rule") -> DataFrame:
    """By the rule's kind: what stands before its first colon; with a column ``n`` a row stands for so many equal ones."""
    n = F.sum("n") if "n" in suppressed.columns else F.count("*")
    return suppressed.groupBy(F.substring_index(rule, ":", 1).alias("rule")).agg(n.alias("n"))


def page_categories(detections: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    return detections.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def residual_cap(residuals: DataFrame, doc: str = "doc_id", order: str = "ord", most: int = 200) -> DataFrame:
    """(doc, kept, truncated): how many details a report lists (a report's feature; the residuals themselves all stay)."""
    n = residuals.groupBy(doc).agg(F.count(order).alias("n"))
    return n.select(doc, F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("truncated"))


def form_records(findings: DataFrame, caps: dict[str, int] | None = None, default: int = 500) -> DataFrame:
    """(doc_id, label, form, occurrences, pages, score_max, listed): one row for each form, capped a label in first-seen order.

    findings(doc_id, label, form, page, score, ord). Forms beyond the cap aren't listed but still counted.
    """
    forms = findings.groupBy("doc_id", "label", "form").agg(F.count("*").alias("occurrences"), F.slice(F.array_sort(F.collect_set("page")), 1, 5).alias("pages"), F.max("score").alias("score_max"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("first"))
    return forms.withColumn("listed", rank <= capped(F.col("label"), caps or {}, default)).drop("first")


def best_span(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end")) -> DataFrame:
    """One label for identical spans: the highest score, the first of equals."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return findings.withColumn("__k", k).where("__k = 1").drop("__k")


def release_status(checks_pass: Column, review: Column, incomplete: Column) -> Column:
    """The five states. checks_pass: all automatic checks; review: null, complete or another status; incomplete: number of reasons."""
    return (
        F.when(~F.coalesce(checks_pass, F.lit(False)), "FAIL")
        .when(review.isNull() | (review == ""), "REVIEW_REQUIRED")
        .when(review != "complete", "REVIEW_INCOMPLETE")
        .when(incomplete > 0, "REVIEW_INCOMPLETE")
        .otherwise("RELEASED")
    )


def incompleteness(reports: DataFrame) -> DataFrame:
    """(doc_id, reasons) from truncated residual and finding lists."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown document"))
    reasons = F.array(F.when(F.col("residuals_truncated") > 0, F.concat(name, F.lit(": residual findings truncated"))), F.when(F.col("findings_truncated") > 0, F.concat(name, F.lit(": NER review findings truncated"))))
    return reports.select("doc_id", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def page_profile(pages: DataFrame) -> DataFrame:
    """Pages, seconds and the largest memory by kind of page."""
    return pages.groupBy("page_kind").agg(F.count("*").alias("pages"), F.sum("seconds").alias("seconds"), F.max("rss").alias("rss"))


def missing_fields(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Expected fields without a non-blank value."""
    return expected.join(given.where(F.trim("value") != "").select("field").distinct(), "field", "left_anti")


def prune_candidates(runs: DataFrame, now: Column, days: int) -> DataFrame:
    """Run folders older than so many days; hidden ones stay."""
    return runs.where((F.col("modified") < now - F.expr(f"INTERVAL {days} DAYS")) & ~F.col("name").startswith("."))


def stale(recorded: DataFrame, live: DataFrame, key: str = "name") -> DataFrame:
    """Recorded against live hashes: current, stale or missing."""
    x = recorded.select(key, F.col("hash").alias("__r")).join(live.select(key, F.col("hash").alias("__l"), F.lit(True).alias("__there")), key, "left")
    return x.select(key, F.when(F.col("__there").isNull(), "missing").when(F.col("__r").eqNullSafe(F.col("__l")), "current").otherwise("stale").alias("state"))
