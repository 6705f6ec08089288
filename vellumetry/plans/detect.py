"""Whole pipelines: images to regions, regions to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import raster
from vellumetry.operators import merge, regions, text
from vellumetry.operators.model import LAYOUT, Layout
from vellumetry.plans.importing import prepared_crops
from vellumetry.sources.images import pixels

_CANDIDATE = "path string, slot bigint, bx int, by int, bw int, bh int, px int, py int, page_w int, page_h int, crop_w int, crop_h int, sharp double, td double, gutter double"


def candidate_boxes(images: DataFrame, denoised: bool = True) -> DataFrame:
    """Candidate boxes of all readable images; pixels don't leave the raster stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CANDIDATE.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = raster.candidates(pixels(r.data, r.height, r.width, r.channels), denoised)
                rows += [{"path": r.path, "slot": i, **b} for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    return images.where("data is not null").select("path", "height", "width", "channels", "data").mapInPandas(run, _CANDIDATE)


def detect(
    boxes: DataFrame,
    expected: DataFrame | None = None,
    merge_body: bool = True,
    preserve_paragraphs: bool = False,
    preserve_lines: bool = False,
    p: Layout = LAYOUT,
) -> DataFrame:
    """Regions in reading order from candidate boxes: page_id, slot, bx, by, bw, bh, px, py, page_w, page_h, crop_w, crop_h, sharp, td, gutter.

    Filters and types are expressions; all that depends on the order of a page's boxes is one pass over them.
    """
    crop = boxes.withColumn("x", F.col("bx") / F.col("crop_w")).withColumn("y", F.col("by") / F.col("crop_h")).withColumn("w", F.col("bw") / F.col("crop_w")).withColumn("h", F.col("bh") / F.col("crop_h"))
    kept = regions.sharp_enough(crop.where(regions.geometry_ok(p)).withColumn("crop_share", F.col("w")).withColumn("crop_area", F.col("w") * F.col("h")), "sharp", p)
    placed = regions.to_page_shares(kept)
    rtype, sure = regions.region_type(F.col("td"), F.col("crop_share"), F.col("crop_area"))
    typed = placed.withColumn("rtype", rtype).withColumn("confidence", sure)
    gutters = typed.groupBy("page_id").agg(F.max("gutter").alias("gutter"))
    mode = "newlines" if preserve_lines else "paragraphs" if preserve_paragraphs else "default"
    return merge.laid_out(typed, gutters, expected, mode, merge_body, p)


def recognise(found: DataFrame, recogniser: Callable[[DataFrame], DataFrame], newlines: bool = False, images: DataFrame | None = None) -> DataFrame:
    """(region_id, text, confidence, word_count, skipped, error) of each region. found: region_id, rtype, x, y, w, h, image_w, image_h.

    recogniser turns the crops asked for into a word table (region_id, idx, word, conf, block, par, line[, error]);
    a table of stored words will do. With images, and found's path, what it gets has the prepared crop in
    column crop, a PNG. One region's error leaves the others as they are.
    """
    asked = text.crop_boxes(found)
    wanted = asked.where(~F.col("skip"))
    words = recogniser(wanted if images is None else wanted.join(prepared_crops(images, found.drop("image_w", "image_h")), "region_id"))
    errors = words.where("error is not null").groupBy("region_id").agg(F.min("error").alias("error")) if "error" in words.columns else None
    done = text.assembled(words if errors is None else words.where("error is null"), newlines)
    out = asked.select("region_id", F.col("skip").alias("skipped")).join(done, "region_id", "left")
    out = out.withColumn("error", F.lit(None).cast("string")) if errors is None else out.join(errors, "region_id", "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("word_count", F.coalesce("word_count", F.lit(0)))
