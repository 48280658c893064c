"""Review of findings: plain descriptions, decisions (the last wins) and what they would add to the policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISPOSITIONS = ("sensitive", "safe", "duplicate", "escalate")

# fixed values: descriptions of categories
PLAIN_GUESS = {
    "denylist": "matches something we've flagged before", "street_address": "looks like an address", "city_state_zip": "looks like an address", "po_box": "looks like an address",
    "email": "looks like an email address", "phone": "looks like a phone number", "url": "looks like a web address", "file_path": "looks like a file path",
    "coordinate": "looks like a map coordinate", "parcel_or_lot": "looks like a parcel or lot number", "permit_or_application": "looks like a permit or application number",
    "project_or_job_number": "looks like a project or job number", "credentialed_person": "looks like a person's name with a professional title",
    "labelled_identifier": "looks like an identifier next to a form label", "person name": "looks like a person's name", "company name": "looks like a company name",
    "organization": "looks like a company name", "project name": "looks like a project name", "street address": "looks like an address", "city": "looks like a city name",
}
GENERIC_GUESS = "flagged item"


def plain_guess(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PLAIN_GUESS.items() for x in kv]), category), F.lit(GENERIC_GUESS))


def finding_ids(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Adds finding_id from document, page, category and digest; an ordinal tells repeated ones apart."""
    same = ["doc_id", "page", "category", "digest"]
    n = F.row_number().over(Window.partitionBy(*same).orderBy(order))
    return findings.withColumn("finding_id", F.concat_ws(":", *[F.col(c).cast("string") for c in same], n.cast("string")))


def latest_decisions(*tables: DataFrame) -> DataFrame:
    """One decision for each finding: the last; unknown dispositions are refused, rows without an output hash too."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.where(F.col("disposition").isin(*DISPOSITIONS) & F.col("output_sha256").isNotNull())
    last = Window.partitionBy("finding_id").orderBy(F.desc("decided_at"), F.desc("disposition"))
    return every.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def with_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    return findings.join(decisions.select("finding_id", "disposition", "note"), "finding_id", "left")


def promotion_preview(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(finding_id, category, goes_to): duplicates would go to the denylist, safe ones to the vocabularies; nothing is applied."""
    to = F.when(F.col("disposition") == "duplicate", "denylist").when(F.col("disposition") == "safe", "lexicon")
    return findings.join(decisions.select("finding_id", "disposition"), "finding_id").select("finding_id", "category", to.alias("goes_to")).where("goes_to is not null")
