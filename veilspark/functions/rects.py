"""Rectangles as four columns x0, y0, x1, y1 (or a struct of them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def _overlap(a: Column, b: Column, k: str) -> Column:
    return F.least(a[k + "1"], b[k + "1"]) - F.greatest(a[k + "0"], b[k + "0"])


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def intersects(a: Column, b: Column, least: float = 0.0) -> Column:
    return (_overlap(a, b, "x") > least) & (_overlap(a, b, "y") > least)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if disjoint or degenerate."""
    inner = F.greatest(F.lit(0.0), _overlap(a, b, "x")) * F.greatest(F.lit(0.0), _overlap(a, b, "y"))
    union = area(a) + area(b) - inner
    return F.when((inner > 0) & (union > 0), inner / union).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def padded(a: Column, page: Column, by: float = 1.5) -> Column:
    return rect(F.greatest(a["x0"] - by, page["x0"]), F.greatest(a["y0"] - by, page["y0"]), F.least(a["x1"] + by, page["x1"]), F.least(a["y1"] + by, page["y1"]))


def half_points(a: Column) -> list[Column]:
    """Keys of the half-point grid, halves to even."""
    return [F.bround(a[k] * 2).cast("long").alias("h" + k) for k in SIDES]


def scaled(normal: Column, width: Column, height: Column) -> Column:
    return rect(normal["x0"] * width, normal["y0"] * height, normal["x1"] * width, normal["y1"] * height)
