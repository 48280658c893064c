"""Structured Streaming forms. Stateless stages run unchanged on streams; the rest is below. Extensions are marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triage import latest_decisions
from ..plans.engine import Engine


def redact_stream(docs: DataFrame, engine: Engine) -> DataFrame:
    """Findings of a stream of documents (doc_id, text): scan and suppression are stateless."""
    return engine.matches(docs)


def upsert_decisions(stream: DataFrame, path: str, checkpoint: str, read: Callable[[str], DataFrame | None]):
    """Keeps the last decision of each finding: every batch is merged into a new version of the table.

    Versions are folders named by batch, so a batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = read(f"{path}/v{batch_id - 1}") if batch_id else None
        merged = latest_decisions(batch) if before is None else latest_decisions(before, batch)
        merged.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """An extension: counts by event time in tumbling or sliding windows, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide or width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions of each user by event time."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
