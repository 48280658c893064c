"""Joins and deduplication over rectangles; every join has the page as its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy_values as V
from ..functions import rects as R


def overlapping(x: DataFrame, y: DataFrame, key: list[str], a: str, b: str, cell: tuple[float, float] = (64.0, 16.0)) -> DataFrame:
    """Pairs of rows of x and y with equal keys whose rectangles ``a`` and ``b`` overlap, each once.

    Rectangles go to the grid cells that they touch; a pair counts in the cell that holds the upper left corner of its
    overlap.  So a page of n rectangles costs the pairs that are near each other, not n squared, and a crowded page is many keys.
    """
    w, h = cell

    def spots(df: DataFrame, rect: str) -> DataFrame:
        r = f"{rect}."
        span = [F.sequence(F.floor(F.col(r + lo) / s), F.floor(F.greatest(F.col(r + lo), F.col(r + hi)) / s)) for lo, hi, s in (("x0", "x1", w), ("y0", "y1", h))]
        return df.withColumn("__gx", F.explode(span[0])).withColumn("__gy", F.explode(span[1]))

    both = spots(x, a).join(spots(y, b), [*key, "__gx", "__gy"])
    left, top = F.greatest(F.col(a)["x0"], F.col(b)["x0"]), F.greatest(F.col(a)["y0"], F.col(b)["y0"])
    mine = (F.col("__gx") == F.floor(left / w)) & (F.col("__gy") == F.floor(top / h))
    return both.where(mine & R.intersects(F.col(a), F.col(b), 0.0)).drop("__gx", "__gy")


def region_rects(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Configured regions on the pages that they name; regions are a small configured list."""
    both = pages.join(F.broadcast(regions), F.col("all_pages") | F.array_contains("pages", F.col("page")))
    return both.select("doc_id", "page", "name", "category", R.scaled(F.col("rect"), F.col("width"), F.col("height")).alias("rect"))


def cells_crossed(matches: DataFrame, cells: DataFrame, key: tuple[str, ...] = ("doc_id", "page"), ident: str = "match_id") -> DataFrame:
    """(ident, cells): distinct table cells that the rectangles of one match overlap by more than a point; only fragile categories look."""
    x = matches.where(F.col("category").isin(*V.TABLE_FRAGILE)).select(*key, ident, F.col("rect").alias("__m"))
    hit = overlapping(x, cells.select(*key, "cell_id", F.col("rect").alias("__c")), list(key), "__m", "__c").where(R.intersects(F.col("__m"), F.col("__c"), 1.0))
    counted = hit.groupBy(ident).agg(F.countDistinct("cell_id").alias("cells"))
    return matches.select(ident).distinct().join(counted, ident, "left").select(ident, F.coalesce("cells", F.lit(0)).alias("cells"))


def nearest_images(labels: DataFrame, images: DataFrame, pages: DataFrame, key: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(key, label_id, rect): each map label with its nearest image, or a box of 38 % of the page around it.

    A page's distinct rectangles are one array, which each label reads in its own row: no row for each pair is made or sorted.
    """
    p = pages.select(*key, F.col("rect").alias("__p"))
    x = labels.select(*key, "label_id", F.col("rect").alias("__l")).join(p, list(key))
    seen = images.groupBy(*key, F.col("rect").alias("__i")).agg(F.min("image_id").alias("image_id"))  # equal rectangles: the smallest id wins anyway
    seen = seen.groupBy(*key).agg(F.collect_list(F.struct("image_id", "__i")).alias("__all"))

    def near(i: Column) -> Column:
        whole = R.union(i["__i"], F.col("__l"))
        return F.when(R.area(whole) <= R.area(F.col("__p")) * 0.45, F.struct(R.area(whole).alias("a"), i["image_id"].alias("image_id"), whole.alias("rect")))

    joined = x.join(seen, list(key), "left").select(*key, "label_id", "__l", "__p", F.array_min(F.transform("__all", near)).alias("__b"))
    best = joined.groupBy(*key, "label_id").agg(F.min("__b").alias("b"), F.first("__l").alias("l"), F.first("__p").alias("p"))
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    w, h = (F.col("p.x1") - F.col("p.x0")) * 0.19, (F.col("p.y1") - F.col("p.y0")) * 0.19
    box = R.rect(F.greatest(cx - w, F.col("p.x0")), F.greatest(cy - h, F.col("p.y0")), F.least(cx + w, F.col("p.x1")), F.least(cy + h, F.col("p.y1")))
    return best.select(*key, "label_id", F.coalesce("b.rect", box).alias("rect"))


def dedupe_half_points(detections: DataFrame, key: tuple[str, ...] = ("doc_id", "page"), order: str = "ord") -> DataFrame:
    """One detection for each rectangle on the half-point grid, the first; empty rectangles go."""
    real = detections.where((F.col("rect.x1") > F.col("rect.x0")) & (F.col("rect.y1") > F.col("rect.y0")))
    grid = [c for c in R.half_points(F.col("rect"))]
    named = real.select("*", *grid)
    first = Window.partitionBy(*key, *["h" + k for k in R.SIDES]).orderBy(order)
    return named.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", *["h" + k for k in R.SIDES])


def repeated_images(images: DataFrame, least: int = 3) -> DataFrame:
    """Images on so many distinct pages or more."""
    return images.groupBy("doc_id", "image_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)


def in_margin(rect: Column, width: Column, height: Column) -> Column:
    share = R.area(rect) / (width * height)
    return ((rect["y1"] <= 0.2 * height) | (rect["y0"] >= 0.8 * height) | (rect["x0"] >= 0.8 * width)) & share.between(1e-5, 0.06)


def repeated_margin_images(images: DataFrame, pages: DataFrame, least: int = 3, crowd: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((doc_id, page, image_id, rect) of images that recur in the margins, (doc_id, page) left out as too complex).

    images(doc_id, page, image_id, rect), pages(doc_id, page, width, height). Pages of more than ``crowd`` images are for the
    raster pass and come back by name; the same image at the same hundredth of a point counts once a page.
    """
    crowded = images.groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("doc_id", "page")
    places = images.join(crowded, ["doc_id", "page"], "left_anti").where("image_id > 0")
    near = [F.bround(F.col("rect")[k], 2).alias("__" + k) for k in R.SIDES]
    places = places.select("*", *near).groupBy("doc_id", "page", "image_id", *["__" + k for k in R.SIDES]).agg(F.min("rect").alias("rect"))
    kept = places.join(repeated_images(places, least), ["doc_id", "image_id"], "left_semi").join(pages, ["doc_id", "page"])
    return kept.where(in_margin(F.col("rect"), F.col("width"), F.col("height"))).select("doc_id", "page", "image_id", "rect"), crowded
