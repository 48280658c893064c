"""The whole run as one lazy plan: scan, rule out, redact, scan again, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import containing_line, keyed_digest, masked_shape
from ..operators.propose import computed
from ..operators.redact import redact_in
from ..operators.report import release_status
from ..operators.scan import matches_in, scan
from ..operators.suppress import candidate_suppression, product_evidence
from ..policy import Policy


_FOUND = "array<struct<category:string,ord:int,start:int,end:int,match:string>>"


def _open(found: str) -> Column:
    return F.filter(found, lambda m: m["rule"].isNull())


def _counts(values: Column) -> Column:
    """A key-sorted map of counts by value, null without values."""
    keys = F.array_sort(F.array_distinct(values))
    return F.when(F.size(values) > 0, F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.size(F.filter(values, lambda v: v == k)).cast("long").alias("n")))))


def around(found: Column, kept: Column) -> Column:
    """Matches without what overlaps the kept spans: a match becomes the parts that lie before, between and after them."""
    def pieces(m: Column) -> Column:
        inner = F.array_sort(F.transform(F.filter(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"])), lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"))))
        starts, ends = F.concat(F.array(m["start"]), F.transform(inner, lambda k: k["end"])), F.concat(F.transform(inner, lambda k: k["start"]), F.array(m["end"]))
        parts = F.zip_with(starts, ends, lambda a, b: F.struct(m["category"].alias("category"), m["ord"].alias("ord"), a.alias("start"), b.alias("end")))
        return F.filter(parts, lambda p: p["start"] < p["end"])

    return F.flatten(F.transform(found, pieces))


class Engine:
    """Stages over docs(doc_id, text); each returns a DataFrame and nothing runs before a sink asks.

    A text and its matches stay in one row, so that a run scans each text once for each look and shuffles none.
    """

    def __init__(self, policy: Policy, run_key: bytes = b"run"):
        self.policy, self.run_key = policy, run_key

    def matches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, category, ord, start, end, match, rule, evidence): rule says why a match is ruled out, or null."""
        found = scan(docs.select("doc_id", "text"), policy=self.policy)
        line = containing_line(F.col("text"), F.col("start"), F.col("end"))
        rule = candidate_suppression(F.col("category"), F.col("match"), self.policy, context=line)
        found = computed(found, "rule", rule)
        return found.select("doc_id", "category", "ord", "start", "end", "match", "rule", product_evidence(F.col("text"), F.col("start"), F.col("end"), self.policy).alias("evidence"))

    def _looked(self, docs: DataFrame, name: str, text: str = "text") -> DataFrame:
        """docs with array<struct<category, ord, start, end, match, rule>> of what a look at a text finds."""
        found = matches_in(F.col(text), self.policy)
        if "clean" in docs.columns:  # a look at this very text found nothing open, and would again
            found = F.when(~F.coalesce("clean", F.lit(False)), found).otherwise(F.array().cast(_FOUND))
        docs = computed(docs, "__found", found)
        line = lambda m: containing_line(F.col(text), m["start"], m["end"])
        ruled = F.transform("__found", lambda m: F.struct(*[m[k].alias(k) for k in ("category", "ord", "start", "end", "match")], candidate_suppression(m["category"], m["match"], self.policy, context=line(m)).alias("rule")))
        return computed(docs, name, ruled).drop("__found")

    def redact(self, docs: DataFrame, mask: str | None = None, keep: tuple[str, ...] = (), mark: bool = False) -> DataFrame:
        """docs without what the policy finds; matches of the categories in ``keep`` stay whole, other matches go around them.

        With ``mark``, a column ``clean`` says that the look found nothing open, so that the text is as it was and a later look
        would find the same: ``sweep`` and ``residuals`` by the same policy pass such rows over.
        """
        looked = self._looked(docs, "__m")
        goes = F.filter("__m", lambda m: m["rule"].isNull() & ~m["category"].isin(*keep)) if keep else _open("__m")
        if keep:
            goes = around(goes, F.filter("__m", lambda m: m["category"].isin(*keep)))
        return computed(looked, "__out", redact_in(F.col("text"), goes, mask)).withColumn("text", F.col("__out")).select(*[c for c in docs.columns if c != "clean"], *([(F.size(_open("__m")) == 0).alias("clean")] if mark else []))

    def sweep(self, redacted: DataFrame, mask: str | None = None) -> DataFrame:
        """A second pass over the output: what only redaction brought together is redacted too."""
        return self.redact(redacted, mask, mark="clean" in redacted.columns)

    def residuals(self, redacted: DataFrame) -> DataFrame:
        """What a reader of the output could still find; values only as keyed digests and shapes."""
        left = self.matches(redacted.where("not coalesce(clean, false)") if "clean" in redacted.columns else redacted).where("rule is null")
        return left.select("doc_id", "category", "ord", "start", keyed_digest(self.run_key, F.col("match")).alias("digest"), masked_shape(F.col("match")).alias("shape"))

    def remediate(self, redacted: DataFrame, mask: str | None = None) -> DataFrame:
        """(doc_id, text, remediated, passed): what the output still holds is redacted once, then the output is scanned again.

        ``remediated`` lists the categories that had to be patched; such a document fails however clean the second look is,
        as does one that still holds something. There is no third look.
        """
        rows = self._looked(redacted, "__left")
        rows = computed(rows, "__text", redact_in(F.col("text"), _open("__left"), mask))
        rows = self._looked(rows, "__again", "__text")
        names = F.array_sort(F.array_distinct(F.transform(_open("__left"), lambda m: m["category"])))
        return rows.select("doc_id", F.col("__text").alias("text"), names.alias("remediated"), ((F.size(_open("__left")) == 0) & (F.size(_open("__again")) == 0)).alias("passed"))

    def report(self, docs: DataFrame, redacted: DataFrame | None = None, mask: str | None = None) -> DataFrame:
        """(doc_id, redactions, suppressed, residuals, residuals_truncated, release_status), one row a document.

        Without ``redacted`` the output is made here, from the same look at each text that the counts come from.
        """
        rows = self._looked(docs.select("doc_id", "text"), "__m")
        if redacted is None:
            rows = computed(rows, "__text", redact_in(F.col("text"), _open("__m"), mask))
            rows = self._looked(rows, "__left", "__text").withColumn("__n", F.size(_open("__left")).cast("long"))
        else:
            left = self._looked(redacted.select("doc_id", "text"), "__left").groupBy("doc_id").agg(F.sum(F.size(_open("__left"))).alias("__n"))
            rows = rows.drop("text").join(left, "doc_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0).cast("long")))
        out = F.filter("__m", lambda m: m["rule"].isNotNull())
        cut = F.greatest(F.col("__n") - self.policy.most_residuals, F.lit(0))
        return rows.select(
            "doc_id", _counts(F.transform(_open("__m"), lambda m: m["category"])).alias("redactions"), _counts(F.transform(out, lambda m: F.substring_index(m["rule"], ":", 1))).alias("suppressed"),
            F.col("__n").alias("residuals"), cut.alias("residuals_truncated"), F.when(F.col("__n") == 0, "AUTOMATED_PASS").otherwise("FAIL").alias("release_status"),
        )

    def run_status(self, report: DataFrame, review: str | None = None) -> DataFrame:
        """One row: the run's state."""
        totals = report.agg(F.coalesce(F.every(F.col("release_status") == "AUTOMATED_PASS"), F.lit(False)).alias("ok"), F.count_if(F.col("residuals_truncated") > 0).alias("n"))
        return totals.select(release_status(F.col("ok"), F.lit(review).cast("string"), F.col("n")).alias("status"))
