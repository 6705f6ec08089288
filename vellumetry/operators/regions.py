"""Candidate boxes to regions: filters, types, noise, columns, order. Rows have page_id, slot, x, y, w, h and what is named.

slot numbers a page's boxes; it breaks ties, as no order of rows is promised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.functions.geometry import intersection, iou
from vellumetry.operators.model import COMPILE_RANK, LAYOUT, OTHER_RANK, Layout


def geometry_ok(p: Layout = LAYOUT) -> Column:
    """Is a box neither too small, too large, too low, nor a strip at an edge, the seam or the gutter?"""
    x, y, w, h = (F.col(c) for c in "xywh")
    area, centre = w * h, x + w / 2
    return (
        (area >= p.min_area)
        & (area <= p.max_area)
        & (h >= p.min_height)
        & ~((x < p.edge) & (w < p.edge_width))
        & ~((x + w > 1 - p.edge) & (w < p.edge_width))
        & ~((h > p.seam_height) & (w / (h + 1e-6) < p.seam_aspect))
        & ~((centre > p.gutter[0]) & (centre < p.gutter[1]) & (w < p.gutter_width))
    )


def sharp_enough(boxes: DataFrame, sharp: str = "sharp", p: Layout = LAYOUT) -> DataFrame:
    """Boxes at least as sharp as their page asks: a share of the exact median where there are enough boxes, else a floor."""
    page = boxes.groupBy("page_id").agg(F.count("*").alias("_n"), F.median(sharp).alias("_m"))
    limit = F.when(F.col("_n") >= p.sharp_from, F.greatest(F.lit(p.sharp_floor), p.sharp_share * F.col("_m"))).otherwise(p.sharp_floor)
    return boxes.join(page, "page_id").where(F.col(sharp) >= limit).drop("_n", "_m")


def to_page_shares(boxes: DataFrame) -> DataFrame:
    """Pixels of a crop to shares of the page image: columns bx, by, bw, bh, px, py, page_w, page_h."""
    return (
        boxes.withColumn("x", (F.col("px") + F.col("bx")) / F.col("page_w"))
        .withColumn("y", (F.col("py") + F.col("by")) / F.col("page_h"))
        .withColumn("w", F.col("bw") / F.col("page_w"))
        .withColumn("h", F.col("bh") / F.col("page_h"))
    )


def region_type(density: Column, crop_w: Column | None = None, crop_area: Column | None = None) -> tuple[Column, Column]:
    """(type, confidence): the first rule that fits. crop_w and crop_area are the width and area as shares of the cropped page, where these differ from w and w x h."""
    y, h, w = F.col("y"), F.col("h"), F.col("w") if crop_w is None else crop_w
    top = (y < 0.20) & (h < 0.08)
    foot = (y > 0.90) & (h < 0.06) & (w < 0.30)
    tiny = (F.col("w") * h if crop_area is None else crop_area) < 0.002
    rtype = F.when(top & (w > 0.20), "header").when(top & (w <= 0.20), "pagenum").when(foot, "pagenum").when(density > 0.03, "body").otherwise("unknown")
    sure = F.when(top & (w > 0.20), 0.88).when(top & (w <= 0.20), 0.82).when(foot, 0.85).when(density > 0.03, 0.80).when(tiny, 0.10).otherwise(0.40)
    return rtype, sure


def classified(boxes: DataFrame, density: str = "td") -> DataFrame:
    rtype, sure = region_type(F.col(density))
    return boxes.withColumn("rtype", rtype).withColumn("confidence", sure)


def without_noise(regions: DataFrame, p: Layout = LAYOUT) -> DataFrame:
    return regions.where(~((F.col("rtype") == "unknown") & (F.col("confidence") < p.noise)))


def overlapping_pairs(regions: DataFrame, p: Layout = LAYOUT) -> DataFrame:
    """(page_id, s1, s2, iou) of boxes of one page that overlap by more than the limit, s1 < s2.

    A join on the page with a residual predicate: the pairs of a page are bounded by its boxes.
    """
    boxes = regions.select("page_id", "slot", "x", "y", "w", "h")
    pairs = boxes.alias("a").join(boxes.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.slot") < F.col("b.slot")))
    return pairs.select("a.page_id", F.col("a.slot").alias("s1"), F.col("b.slot").alias("s2"), iou("a", "b").alias("iou")).where(F.col("iou") > p.overlap)


def best_overlaps(regions: DataFrame, others: DataFrame) -> DataFrame:
    """(page_id, s1, s2, iou): for each region the box of others that overlaps it most, if any does; ties go to the lower slot."""
    a, b = (d.select("page_id", "slot", "x", "y", "w", "h") for d in (regions, others))
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.slot") != F.col("b.slot")))
    met = pairs.where(intersection("a", "b") > 0).select("a.page_id", F.col("a.slot").alias("s1"), F.col("b.slot").alias("s2"), iou("a", "b").alias("iou"))
    best = F.max_by(F.struct("s2", "iou"), F.struct(F.round("iou", 9), -F.col("s2")))
    return met.groupBy("page_id", "s1").agg(best.alias("best")).select("page_id", "s1", "best.s2", "best.iou")


def demoted_headers(regions: DataFrame) -> DataFrame:
    """Headers that don't lie above all body of their page become body."""
    page = Window.partitionBy("page_id")
    first = F.min(F.when(F.col("rtype") == "body", F.col("y"))).over(page)
    return regions.withColumn("rtype", F.when((F.col("rtype") == "header") & (F.col("y") >= first), "body").otherwise(F.col("rtype")))


def with_columns_assigned(regions: DataFrame, gutters: DataFrame) -> DataFrame:
    """Adds col_no: 1 left of the page's gutter, 2 right of it, 0 without a gutter and for what isn't body. gutters: (page_id, gutter)."""
    centre = F.col("x") + F.col("w") / 2
    number = F.when((F.col("rtype") != "body") | F.col("gutter").isNull(), 0).when(centre < F.col("gutter"), 1).otherwise(2)
    return regions.join(gutters, "page_id", "left").withColumn("col_no", number).drop("gutter")


def reading_order(regions: DataFrame, tie: str = "slot") -> DataFrame:
    """Adds ord from 0: headers by y, body by column and y, others by y, page numbers by y. Columns count only where both are used."""
    page = Window.partitionBy("page_id")
    column = F.coalesce(F.col("col_no"), F.lit(0)) if "col_no" in regions.columns else F.lit(0)
    body = F.col("rtype") == "body"
    two = (F.max(F.when(body & (column == 1), 1)).over(page) == 1) & (F.max(F.when(body & (column == 2), 1)).over(page) == 1)
    rank = F.when(F.col("rtype") == "header", 0).when(body, 1).when(F.col("rtype") == "pagenum", 3).otherwise(2)
    order = Window.partitionBy("page_id").orderBy("_rank", "_col", "y", tie)
    ranked = regions.withColumn("_rank", rank).withColumn("_col", F.when(body & F.coalesce(two, F.lit(False)), column).otherwise(0))
    return ranked.withColumn("ord", (F.row_number().over(order) - 1).cast("bigint")).drop("_rank", "_col")


def ordered_arrays(regions: DataFrame, tie: str = "slot") -> DataFrame:
    """(page_id, segments ARRAY<STRUCT>): each page's regions in reading order; a page's regions are few."""
    return regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", tie, "rtype", "x", "y", "w", "h"))).alias("segments"))


def collapsed_bodies(regions: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The bounding box of all body of a page (or page and column), with the highest confidence."""
    return regions.where(F.col("rtype") == "body").groupBy(*by).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.max("confidence").alias("confidence")
    )


def islands(regions: DataFrame, gap: float) -> DataFrame:
    """(page_id, rtype, g, y1, y2, n): runs of boxes of a type with vertical gaps of at most gap, ignoring x. A plain-window case of the adjacent merge."""
    order = Window.partitionBy("page_id", "rtype").orderBy("y", "slot")
    reach = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = regions.withColumn("_reach", reach).withColumn("_new", F.when(F.col("y") - F.col("_reach") <= gap, 0).otherwise(1))
    runs = starts.withColumn("g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page_id", "rtype", "g").agg(F.min("y").alias("y1"), F.max(F.col("y") + F.col("h")).alias("y2"), F.count("*").alias("n"))


def compile_rank(rtype: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in COMPILE_RANK.items() for x in kv))
    return F.coalesce(F.element_at(known, rtype), F.lit(OTHER_RANK))
