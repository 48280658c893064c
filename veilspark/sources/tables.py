"""Readers and writers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized, redactable

OCR_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
LABEL_SCHEMA = "doc_id string, source_pdf string, page_count int, exported_at string, items array<struct<id: string, page: int, bbox: array<double>, scale: double, category: string, sensitivity: string, disposition: string, note: string>>"
DISPOSITIONS, LABEL_KINDS = ("redact", "keep"), ("person", "firm", "project", "address", "contact", "account_id", "path", "signature", "barcode", "manufacturer", "standard", "schedule", "boilerplate", "structural", "garbage", "other")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content, sha256)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path).withColumn("sha256", F.sha2("content", 256))


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated words without quoting; malformed numbers stop the run, blank words go."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").schema(OCR_SCHEMA).csv(path)
    return rows.where(F.trim("text") != "")


def read_terms(spark: SparkSession, path: str, allow_short: bool = False, skip_private: bool = False) -> DataFrame:
    """(term) from a JSON object of strings or lists of strings; keys that begin with _ can be skipped."""
    whole = spark.read.text(path, wholetext=True)
    fields = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    values = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = fields.select("key", F.explode(values).alias("value"))
    if skip_private:
        rows = rows.where(~F.col("key").startswith("_"))
    return rows.select(normalized(F.col("value")).alias("term")).where(redactable(F.col("term"), allow_short)).distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(path)


def label_violations(labels: DataFrame) -> DataFrame:
    """(doc_id, message): the first rule that each export breaks, in the rules' order; no row for a valid one."""
    item = F.explode_outer("items")
    rows = labels.select("doc_id", "page_count", item.alias("i"))
    says = lambda k, message: F.struct(F.lit(k).alias("k"), message.alias("message"))
    broken = (
        F.when(F.col("doc_id").isNull() | (F.col("doc_id") == ""), says(0, F.lit("doc_id missing")))
        .when(F.col("i").isNull(), F.lit(None))
        .when(F.col("i.id").isNull(), says(1, F.lit("item without id")))
        .when(~F.coalesce(F.col("i.page").between(0, F.col("page_count") - 1), F.lit(False)), says(2, F.concat(F.lit("page out of range: "), F.col("i.id"))))
        .when(F.coalesce(F.size("i.bbox") != 4, F.lit(True)) | (F.col("i.bbox")[0] >= F.col("i.bbox")[2]) | (F.col("i.bbox")[1] >= F.col("i.bbox")[3]), says(3, F.concat(F.lit("bad bbox: "), F.col("i.id"))))
        .when(~F.coalesce(F.col("i.scale") > 0, F.lit(False)), says(4, F.concat(F.lit("bad scale: "), F.col("i.id"))))
        .when(~F.coalesce(F.col("i.category").isin(*LABEL_KINDS), F.lit(False)), says(5, F.concat(F.lit("unknown category: "), F.col("i.id"))))
        .when(~F.coalesce(F.col("i.sensitivity").isin("sensitive", "not_sensitive"), F.lit(False)), says(6, F.concat(F.lit("unknown sensitivity: "), F.col("i.id"))))
        .when(~F.coalesce(F.col("i.disposition").isin(*DISPOSITIONS), F.lit(False)), says(7, F.concat(F.lit("unknown disposition: "), F.col("i.id"))))
    )
    return rows.select("doc_id", broken.alias("b")).where("b is not null").groupBy("doc_id").agg(F.min("b").alias("b")).select("doc_id", "b.message")


def write_labels(spark: SparkSession, labels: DataFrame, root: str, name: str = "labels") -> str:
    """Write a label export as JSON lines once all rules hold; an earlier export of that name is replaced as a whole.

    Raises ValueError, and leaves the earlier export as it was, if any document breaks a rule.
    """
    broken = label_violations(labels).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r.doc_id}: {r.message}" for r in broken))
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging, final = path(f"{root}/.staging-{name}"), path(f"{root}/{name}")
    labels.write.mode("overwrite").json(staging.toString())
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    old = path(f"{root}/.replaced-{name}")
    fs.delete(old, True)
    had = fs.exists(final) and fs.rename(final, old)
    if not fs.rename(staging, final):
        if had:
            fs.rename(old, final)
        raise OSError(f"cannot publish {final.toString()}")
    fs.delete(old, True)
    return final.toString()


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write a run's tables to a hidden staging folder, then make them visible by one rename; an existing run is never replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging, final = path(f"{root}/.staging-{run_id}"), path(f"{root}/{run_id}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(final.toString())
    for name, df in tables.items():
        df.write.parquet(f"{staging.toString()}/{name}")
    if not fs.rename(staging, final):
        raise OSError(f"cannot publish {final.toString()}")
    return final.toString()
