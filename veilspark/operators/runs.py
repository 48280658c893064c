"""What a run over many documents keeps: pages, checks, states, manifests, statistics and the order of its findings."""

from __future__ import annotations

import secrets
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rects as R

SCHEMA_REPORT, SCHEMA_MANIFEST = 4, 1


def run_id(now: datetime | None = None) -> str:
    """A sortable name: the time in UTC and eight random hexadecimal digits."""
    return f"{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S.%fZ')}-{secrets.token_hex(4)}"


def points(rect: Column, scale: Column) -> Column:
    """A rectangle of rendered pixels in points of the page."""
    return R.rect(*[rect[k] / scale for k in R.SIDES])


def span_rect(words: Column, start: Column, end: Column, line: Column) -> Column:
    """The union of the words(text, x0, y0, x1, y1) of a line that the characters [start, end) touch; the line's own rectangle if none."""
    begin = F.expr("0")
    placed = F.aggregate(
        words,
        F.struct(begin.cast("int").alias("at"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("r")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w["text"]) + 1).cast("int").alias("at"),
            F.when((acc["at"] < end) & (acc["at"] + F.length(w["text"]) > start), F.when(acc["r"].isNull(), R.rect(*[w[k] for k in R.SIDES])).otherwise(R.union(acc["r"], R.rect(*[w[k] for k in R.SIDES])))).otherwise(acc["r"]).alias("r"),
        ),
    )
    return F.coalesce(placed["r"], line)


def area_ratio(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, ratio): the area of a page's images over the page's; pages without images have 0."""
    sums = images.groupBy("doc_id", "page").agg(F.sum(R.area(F.col("rect"))).alias("__a"))
    return pages.join(sums, ["doc_id", "page"], "left").select("doc_id", "page", (F.coalesce("__a", F.lit(0.0)) / R.area(F.col("rect"))).alias("ratio"))


def residual_split(residuals: DataFrame) -> DataFrame:
    """(doc_id, denylist, direct): residuals of exact terms and of patterns."""
    exact = F.col("category") == "denylist"
    return residuals.groupBy("doc_id").agg(F.count_if(exact).alias("denylist"), F.count_if(~exact).alias("direct"))


def checks_pass(checks: DataFrame) -> DataFrame:
    """checks(doc_id, check, ok) to (doc_id, passed, failed): a missing answer is a failure; failed checks by name."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return checks.groupBy("doc_id").agg(F.every(ok).alias("passed"), F.array_sort(F.collect_set(F.when(~ok, F.col("check")))).alias("failed"))


def page_mismatches(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc_id, page, problem): pages of a source and its output by position that are missing, added or of another size."""
    x, y = source.select("doc_id", "page", F.struct("width", "height").alias("__s")), output.select("doc_id", "page", F.struct("width", "height").alias("__o"))
    problem = F.when(F.col("__o").isNull(), "missing").when(F.col("__s").isNull(), "added").when(F.col("__s") != F.col("__o"), "size")
    return x.join(y, ["doc_id", "page"], "full").select("doc_id", "page", problem.alias("problem")).where("problem is not null")


def output_hashes(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """documents(doc_id) with the manifest's output_sha256; error says which the manifest lacks."""
    out = documents.join(manifest.select("doc_id", "output_sha256"), "doc_id", "left")
    return out.withColumn("error", F.when(F.col("output_sha256").isNull(), F.concat(F.lit("no output in the manifest: "), F.col("doc_id").cast("string"))))


def document_terms(shared: DataFrame, intake: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, term): the shared terms for every document and the intake's terms for its own; shared is a configured list."""
    own = intake.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "term")
    return documents.select("doc_id").distinct().join(F.broadcast(shared.select("term").distinct())).union(own).distinct()


def raster_pages(needed: DataFrame, fragile: DataFrame) -> DataFrame:
    """(doc_id, page) that either side asks to be rendered, once each."""
    return needed.select("doc_id", "page").union(fragile.select("doc_id", "page")).distinct()


def in_order(findings: DataFrame) -> DataFrame:
    """Model findings with their rank in a report: many occurrences first, then label, then folded form; never by digest."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("occurrences"), "label", F.lower("form"), "form")))


def merged_streams(*streams: DataFrame) -> DataFrame:
    """One stream of detections(doc_id, page, ord, rect, category): the detectors in the order given, each in its own."""
    out = None
    for k, s in enumerate(streams):
        part = s.select("doc_id", "page", F.lit(k).alias("stream"), "ord", "rect", "category")
        out = part if out is None else out.unionByName(part)
    return out


def status_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("release_status").agg(F.count("*").alias("documents"))


def run_statistics(reports: DataFrame) -> DataFrame:
    """One row: documents, pages and rendered pages of a run."""
    return reports.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("rendered"), F.lit(0)).alias("rendered"))


def match_totals(hits: DataFrame) -> DataFrame:
    """hits(doc_id, page, surface) to counts by page and, with a null page, by document."""
    return hits.rollup("doc_id", "page").agg(F.count_if(F.col("surface") == "extracted").alias("extracted"), F.count_if(F.col("surface") == "rendered").alias("rendered")).where("doc_id is not null")


def document_rows(items: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, total, missed, recall): labelled items of a document and those still found in its output."""
    hit = matched.select("doc_id", "item_id").distinct().withColumn("__m", F.lit(1))
    out = items.join(hit, ["doc_id", "item_id"], "left").groupBy("doc_id").agg(F.count("*").alias("total"), F.count("__m").alias("missed"))
    return out.withColumn("recall", 1 - F.col("missed") / F.col("total"))


def finished_runs(runs: DataFrame) -> DataFrame:
    """Runs whose review is complete: only their crops may go."""
    return runs.where(F.coalesce(F.col("review") == "complete", F.lit(False)))


def until_failure(reports: DataFrame, order: str = "ord") -> DataFrame:
    """reports(ord, failed) with state: done, FAIL for the first failure, not_started after it.

    The first failure is one minimum over all documents; the batch isn't brought into one place.
    """
    first = reports.where(F.coalesce(F.col("failed"), F.lit(True))).agg(F.min(order).alias("__first"))
    state = F.when(F.col("__first").isNull() | (F.col(order) < F.col("__first")), "done").when(F.col(order) == F.col("__first"), "FAIL").otherwise("not_started")
    return reports.join(F.broadcast(first)).withColumn("state", state).drop("__first")


def report_payload(reports: DataFrame, run: str, status: str) -> DataFrame:
    """The report document: one row and JSON value a document, with the run's name and state (a file a task, not one array)."""
    return reports.select(F.lit(SCHEMA_REPORT).alias("schema_version"), F.lit(run).alias("run_id"), F.lit(status).alias("status"), F.struct(*reports.columns).alias("document"))


def manifest_payload(reports: DataFrame, run: str) -> DataFrame:
    """The manifest: run_id, statistics and states, one row."""
    stats = run_statistics(reports).select(F.struct("*").alias("statistics"))
    states = status_counts(reports).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("release_status", "documents")))).alias("states"))
    return stats.join(states).select(F.lit(SCHEMA_MANIFEST).alias("schema_version"), F.lit(run).alias("run_id"), "statistics", "states")


def summary(manifest: DataFrame) -> str:
    """The manifest's row as a short text for reviewers."""
    row = manifest.first()
    states = "\n".join(f"- {k}: {v}" for k, v in sorted((row.states or {}).items()))
    return f"# Run {row.run_id}\n\n{row.statistics.documents} documents, {row.statistics.pages} pages, {row.statistics.rendered} rendered\n\n{states}\n"
