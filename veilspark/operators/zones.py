"""Division and part of a specification, carried down the pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy_values as V
from ..policy import java


def page_zones(lines: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "line") -> DataFrame:
    """(doc, page, zone): the zone at each page's end, null before the first heading.

    A section heading sets the division and clears the part. The note behind ``|`` is derived from both and isn't carried,
    so pages without a heading repeat the zone unchanged.
    """
    section, part = java(f"(?i){V.SECTION_HEADER}"), java(f"(?i){V.PART_HEADER}")
    x = lines.withColumn("division", F.when(F.col("text").rlike(section), F.left(F.regexp_replace(F.regexp_extract("text", section, 1), r"\D", ""), F.lit(2))))
    x = x.withColumn("part", F.when(F.col("text").rlike(part), F.upper(F.regexp_extract("text", part, 2))))
    down = Window.partitionBy(doc).orderBy(page, order)
    x = x.withColumn("section_no", F.count("division").over(down)).withColumn("division", F.last("division", True).over(down))
    x = x.withColumn("part", F.last("part", True).over(Window.partitionBy(doc, "section_no").orderBy(page, order)))
    last = x.groupBy(doc, page).agg(F.max_by(F.struct("division", "part"), order).alias("z"))
    division, kind = F.coalesce("z.division", F.lit("")), F.coalesce("z.part", F.lit(""))
    note = F.when(division.isin(*V.PARTY_DIVISIONS), "|contracting").when(kind == "PRODUCTS", "|products").otherwise("")
    return last.select(doc, page, F.when((division != "") | (kind != ""), F.concat(division, F.lit("/"), kind, note)).alias("zone"))
