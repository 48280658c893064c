"""Evaluation of a policy on labelled strings, and of a run on labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy_values as V
from ..functions import rects as R
from ..policy import Policy, denylist_pattern, java
from .spatial import overlapping
from .suppress import proposal_rejection, suppression_reason

MUST_SURVIVE = ("manufacturer", "boilerplate", "structural", "garbage", "hard_negative")
NOISY = ("manufacturer", "boilerplate", "structural", "garbage")


def classify(golden: DataFrame, policy: Policy) -> DataFrame:
    """golden(term, verdict) with action (redacted, suppressed, passed), why and rejected."""
    pattern = denylist_pattern(policy.terms)
    hit = F.col("term").rlike(java(pattern)) if pattern else F.lit(False)
    why = suppression_reason(F.col("term"), policy)
    return golden.select("*", F.when(hit, "redacted").when(why.isNotNull(), "suppressed").otherwise("passed").alias("action"), F.when(~hit, why).alias("why"), proposal_rejection(F.col("term"), policy).alias("rejected"))


def outcomes(classified: DataFrame) -> DataFrame:
    """(verdict, redacted, suppressed, passed, rejected); with a column ``n`` a row stands for so many equal ones."""
    n = F.col("n") if "n" in classified.columns else F.lit(1)
    total = lambda held: F.coalesce(F.sum(F.when(held, n)), F.lit(0)).cast("long")
    return classified.groupBy("verdict").agg(*[total(F.col("action") == a).alias(a) for a in ("redacted", "suppressed", "passed")], total(F.col("rejected").isNotNull()).alias("rejected"))


def metrics(counted: DataFrame) -> DataFrame:
    """One row: recall over parties, over-redaction over what must survive, noise handled; as counts."""
    total = F.col("redacted") + F.col("suppressed") + F.col("passed")
    party, stays, noisy = F.col("verdict") == "party", F.col("verdict").isin(*MUST_SURVIVE), F.col("verdict").isin(*NOISY)
    pick = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    return counted.agg(
        pick(party, F.col("redacted")).alias("party_redacted"), pick(party, total).alias("party_total"), pick(stays, F.col("redacted")).alias("survive_redacted"), pick(stays, total).alias("survive_total"),
        pick(noisy, F.col("suppressed") + F.least("rejected", "passed")).alias("noisy_handled"), pick(noisy, total).alias("noisy_total"),
    )


def failures(classified: DataFrame) -> DataFrame:
    kind = (
        F.when((F.col("verdict") == "party") & (F.col("action") != "redacted"), "LEAK")
        .when(F.col("verdict").isin(*MUST_SURVIVE) & (F.col("action") == "redacted"), "OVER-REDACTED")
        .when((F.col("verdict") == "hard_negative") & (F.col("action") == "suppressed"), "WRONGLY SUPPRESSED")
        .when((F.col("verdict") == "party") & F.col("rejected").isNotNull(), "DERIVATION WOULD DROP")
    )
    return classified.withColumn("failure", kind).where("failure is not null")


def satisfies(label: Column, category: Column) -> Column:
    """Whether a finding's category can stand for a label's; unknown categories can't."""
    known = F.create_map(*[x for k, v in V.EQUIVALENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.element_at(known, category), label), F.lit(False))


def match_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """items(doc_id, item_id, page from 0, rect, category) with the first finding that meets them by page, overlap and category.

    found(doc_id, surface, ord, page from 1 or an array of such pages, rect, category); surface 0 (residuals) comes before
    1 (model findings).  A finding's category is spread over the labels that it can stand for, and rectangles over a
    grid, so that only near ones of fitting kinds meet; the first is a minimum, combined before the shuffle.
    """
    stands = F.create_map(*[v for k, labels in V.EQUIVALENT.items() for v in (F.lit(k), F.array(*map(F.lit, sorted(labels))))])
    x = items.select("doc_id", "item_id", (F.col("page") + 1).cast("long").alias("page"), F.col("rect").alias("__a"), F.col("category").alias("label"))
    pages = F.col("page") if found.schema["page"].dataType.simpleString().startswith("array") else F.array("page")
    y = found.withColumn("page", F.explode(F.transform(F.array_distinct(pages), lambda p: p.cast("long"))))
    y = y.select("doc_id", "page", "surface", "ord", F.col("rect").alias("__b"), F.col("category").alias("found_category"), F.explode(F.element_at(stands, F.col("category"))).alias("label"))
    both = overlapping(x, y, ["doc_id", "page", "label"], "__a", "__b").where(R.iou(F.col("__a"), F.col("__b")) >= V.IOU_MATCH)
    return both.groupBy("doc_id", "item_id").agg(F.min(F.struct("surface", "ord", "found_category")).alias("f")).select("doc_id", "item_id", "f.surface", "f.ord", "f.found_category")


def missed(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Labels that are still found in the output."""
    return items.join(matched.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")


def hit(items: DataFrame, matched: DataFrame) -> DataFrame:
    return items.join(matched.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")


def over_redacted(keep: DataFrame, page_categories: DataFrame) -> DataFrame:
    """(doc_id, item_id) of labels to keep whose page has a redaction of an equivalent category, each item once."""
    seen = page_categories.select("doc_id", (F.col("page") - 1).alias("page"), F.explode("categories").alias("__c"))
    hits = keep.join(seen, (keep.doc_id == seen.doc_id) & (keep.page == seen.page) & satisfies(keep.category, F.col("__c")), "left_semi")
    return hits.select("doc_id", "item_id").distinct()


def by_tag(rows: DataFrame, tags: str, keys: tuple[str, ...] = ("hits", "total")) -> DataFrame:
    """Sums by tag; a document counts once for each of its tags, and as unknown without any."""
    tag = F.explode(F.when(F.size(F.coalesce(tags, F.array())) > 0, F.col(tags)).otherwise(F.array(F.lit("unknown"))))
    return rows.select(tag.alias("tag"), *keys).groupBy("tag").agg(*[F.sum(k).alias(k) for k in keys])
