"""Detections with rectangles: one policy over extracted lines and over recognised words.

lines(doc_id, page, block, line, ord, text, x0, y0, x1, y1, words): ``line`` orders a block, ``ord`` a page, words are
array<struct<text, x0, y0, x1, y1>>, may be empty (a match then has its line's rectangle). Both forms return
(doc_id, page, rect, category, detector, start, end, text, evidence, suppressed_by), a row for each rectangle of a match.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rects as R
from ..functions.text import containing_line, normalized
from ..policy import Policy
from . import labels, layout
from .propose import computed
from .runs import span_rect
from .scan import matches_in
from .spatial import cells_crossed
from .suppress import candidate_suppression, product_phrase, product_window

PAGE = ("doc_id", "page")
OUT = (*PAGE, "rect", "category", "detector", "start", "end", "text", "evidence", "suppressed_by")
LABELLED = "labelled_identifier"


def line_rect() -> Column:
    return R.rect(*map(F.col, R.SIDES))


def ocr_lines(words: DataFrame) -> DataFrame:
    """words(doc_id, page, block, par, line, text, left, top, width, height) to lines of a page from top to bottom.

    A line's words are ordered by their left edge; ``block`` becomes (block, par), so that paragraphs are blocks. Lines at the
    same place are ordered by (block, par, line).
    """
    word = F.struct(F.col("left").cast("double").alias("x0"), F.col("top").cast("double").alias("y0"), "text", (F.col("left") + F.col("width")).cast("double").alias("x1"), (F.col("top") + F.col("height")).cast("double").alias("y1"))
    lines = words.groupBy(*PAGE, "block", "par", "line").agg(F.sort_array(F.collect_list(word)).alias("w"))
    side = lambda pick, k: pick(F.transform("w", lambda t: t[k]))
    lines = lines.select(
        *PAGE, F.struct("block", "par").alias("block"), "line", F.array_join(F.transform("w", lambda t: t["text"]), " ").alias("text"),
        side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"),
        F.transform("w", lambda t: F.struct(t["text"].alias("text"), *[t[k].alias(k) for k in R.SIDES])).alias("words"),
    )
    return lines.withColumn("ord", F.struct("y0", "x0", "block", "line"))


def block_matches(lines: DataFrame, policy: Policy, whole_page: bool = True) -> DataFrame:
    """(doc_id, page, mid, category, start, end, match, context, evidence, rect): patterns by block, terms by page (or by block).

    A block breaks patterns so that unrelated text can't form an address; an exact term may cross blocks. There is a row
    for each line that a match touches, with the line's part of its rectangle. A block's (a page's) lines stay beside its text
    in one row, so that a match reads the lines it touches there and joins with none.
    """
    made = []
    patterns = [(("block",), ("line",), replace(policy, terms=policy.terms if not whole_page else ()), None)]
    if whole_page and policy.terms:
        patterns.append(((), ("ord",), policy, ("denylist",)))
    for extra, order, rules, categories in patterns:
        scope = (*PAGE, *extra)
        known = lines.where(" and ".join(f"{k} is not null" for k in (*scope, "text")))
        placed = layout.with_offsets(known, scope, (*order, "text"))
        held = placed.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", line_rect().alias("rect"), "words"))).alias("__p"))
        held = computed(held, "text", F.array_join(F.transform("__p", lambda t: t["text"]), "\n"))
        touched = lambda m: F.filter("__p", lambda t: (t["end"] > m["start"]) & (t["start"] < m["end"]))  # noqa: E731, B023
        whole = lambda m: F.struct(m.alias("m"), containing_line(F.col("text"), m["start"], m["end"]).alias("context"), product_window(F.col("text"), m["start"], m["end"]).alias("near"), touched(m).alias("lines"))  # noqa: E731, B023
        # each array is computed before it is exploded: a filter that the optimizer makes from an explode would compute it again
        found = computed(computed(held, "__m", matches_in(F.col("text"), rules, categories)).where(F.size("__m") > 0), "__w", F.transform("__m", whole)).select(*scope, F.explode("__w").alias("__w"))
        found = found.select(*scope, *[F.col(f"__w.m.{k}").alias(k) for k in ("category", "start", "end", "match")], "__w.context", product_phrase(F.col("__w.near"), policy).alias("evidence"), F.explode("__w.lines").alias("__l"))
        found = found.withColumn("mid", F.to_json(F.struct(*scope, "category", "start", "end"), {"ignoreNullFields": "false"}))
        at = F.col("__l.start")
        part = span_rect(F.col("__l.words"), F.greatest(F.lit(0), F.col("start") - at), F.least(F.col("__l.end"), "end") - at, F.col("__l.rect"))
        made.append(found.select(*PAGE, "mid", "category", "start", "end", "match", "context", "evidence", part.alias("rect")))
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def _label_rows(lines: DataFrame, policy: Policy, scale: float, value_wins: bool) -> DataFrame:
    value = labels.label_value(F.col("text"))
    same = lines.withColumn("__v", value).where("__v is not null")
    start, end = F.length("text") - F.length("__v"), F.length("text")
    same = same.select(*PAGE, span_rect(F.col("words"), start, end, line_rect()).alias("rect"), F.col("text").alias("context"), start.alias("start"), end.alias("end"), F.col("__v").alias("text"))
    below = labels.following_values(lines, PAGE, scale=scale, value_wins=value_wins)
    below = below.select(*PAGE, R.rect(*map(F.col, R.SIDES)).alias("rect"), F.col("raw").alias("context"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("raw").alias("text"))
    both = computed(same.unionByName(below), "suppressed_by", candidate_suppression(F.lit(LABELLED), F.col("text"), policy, context=F.col("context")))
    return both.withColumns({"category": F.lit(LABELLED), "detector": F.lit("label"), "evidence": F.lit(None).cast("string")}).select(*OUT)


def _pattern_rows(found: DataFrame, policy: Policy, cells: DataFrame | None) -> DataFrame:
    crossed = None
    if cells is not None:
        found = found.join(cells_crossed(found, cells, PAGE, "mid"), "mid")
        crossed = F.col("cells")
    ruled = computed(found, "suppressed_by", candidate_suppression(F.col("category"), F.col("match"), policy, cells=crossed, context=F.col("context")))
    detector = F.when(F.col("category") == "denylist", "denylist").otherwise("pattern")
    return ruled.withColumn("detector", detector).withColumn("text", F.col("match")).select(*OUT)


def line_detections(lines: DataFrame, policy: Policy, cells: DataFrame | None = None) -> DataFrame:
    """Patterns, terms and labelled values of extracted lines; cells(doc_id, page, cell_id, rect) rule out what tables break."""
    lines = layout.by_page(lines, PAGE)
    return _pattern_rows(block_matches(lines, policy), policy, cells).unionByName(_label_rows(lines, policy, 1.0, True))


def ocr_detections(words: DataFrame, policy: Policy, scale: float) -> DataFrame:
    """The same policy over recognised words in pixels; terms by paragraph, no table cells; rectangles in points."""
    lines = ocr_lines(layout.by_page(words, PAGE))
    found = _pattern_rows(block_matches(lines, policy, whole_page=False), policy, None).unionByName(_label_rows(lines, policy, scale, False))
    return found.withColumn("rect", R.rect(*[F.col("rect")[k] / scale for k in R.SIDES]))


def map_labels(lines: DataFrame) -> DataFrame:
    """Lines that name a map, as labels(doc_id, page, label_id, rect) for the nearest image."""
    return lines.where(labels.is_map_label(normalized(F.col("text")))).select(*PAGE, F.col("ord").alias("label_id"), line_rect().alias("rect"))
