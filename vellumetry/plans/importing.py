"""Scans in, crops out: images to page rows and page images, regions to what a recogniser reads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.functions import raster
from vellumetry.functions.strings import basename
from vellumetry.operators import text
from vellumetry.operators.model import SPLIT, Split
from vellumetry.sources.images import pixels, png, written

_IMPORTED = "path string, left_path string, right_path string, spine_x int, method string, image_w int, image_h int, is_single boolean, error string"


def profiles(images: DataFrame) -> DataFrame:
    """(path, width, height, profile): the mean brightness of each column of each readable image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.path, r.width, r.height, raster.column_brightness(pixels(r.data, r.height, r.width, r.channels)).tolist()) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "profile"])

    return images.where("data is not null").select("path", "width", "height", "channels", "data").mapInPandas(run, "path string, width int, height int, profile array<double>")


def imported(images: DataFrame, out_dir: str | None = None, p: Split = SPLIT) -> DataFrame:
    """(path, left_path, right_path, spine_x, method, image_w, image_h, is_single, error): a row for each image, split at its spine.

    One pass: pixels are decoded, measured, cut and, with out_dir, written where they are read, and never
    shuffled. out_dir must be a folder all executors share. A file that can't be read, or cut, has an
    error and nothing else; the others go on. Page images are named by the scan and a digest of its
    path, so a task that runs twice writes the same files, and scans of one name don't meet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.data is None:
                    rows.append((r.path, None, None, None, None, None, None, None, r.error or "cannot read image"))
                    continue
                try:
                    image = pixels(r.data, r.height, r.width, r.channels)
                    single = r.width / r.height < p.single_below
                    spine, method = (r.width, "single") if single else raster.spine(raster.column_brightness(image), p)
                    parts = {"single": image} if single else {"left": image[:, :spine], "right": image[:, spine:]}
                    stem = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    names = [f"{stem}-{hashlib.sha1(r.path.encode()).hexdigest()[:8]}_{side}.png" for side in parts]
                    if out_dir is not None:
                        names = [written(out_dir, n, png(x[..., 2::-1] if x.shape[2] >= 3 else x[..., 0])) for n, x in zip(names, parts.values(), strict=True)]
                    rows.append((r.path, names[0], None if single else names[1], spine, method, r.width, r.height, single, None))
                except (ValueError, OSError) as e:
                    rows.append((r.path, None, None, None, None, r.width, r.height, None, str(e)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _IMPORTED.split(", ")])
            yield out.astype({"spine_x": "Int32", "image_w": "Int32", "image_h": "Int32", "is_single": "boolean"})

    return images.select("path", "width", "height", "channels", "data", "error").mapInPandas(run, _IMPORTED)


def spread_rows(found: DataFrame) -> DataFrame:
    """What imported() gives as rows of spreads: volume_id and spread_id, pos in order of file name and path, and the columns of a spread.

    A folder is a volume. Images that failed have no row.
    """
    good = found.where("error is null")
    folder, name = F.regexp_extract("path", r"^(.*)[/\\\\]", 1), basename(F.col("path"))
    named = good.withColumn("volume_id", F.substring(F.sha2(folder, 256), 1, 8)).withColumn("_name", name)
    order = Window.partitionBy("volume_id").orderBy("_name", "path")  # a volume's names, without pixels
    return named.select(
        "volume_id", F.substring(F.sha2("path", 256), 1, 8).alias("spread_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("path").alias("original_path"),
        "left_path", "right_path", "spine_x", F.col("method").alias("split_method"), "image_w", "image_h", F.lit(False).alias("detection_run"),
    )


_CROP = "region_id string, crop_w int, crop_h int, crop binary, error string"


def prepared_crops(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, crop_w, crop_h, crop, error): what the recogniser reads of each region that isn't skipped: its crop evened, enlarged and in black and white, as PNG.

    regions: path of the page image, region_id, rtype, x, y, w, h. The boxes go to their image, an array
    for each (an image's regions are few); regions of images that can't be read have an error.
    """
    known = F.col("data").isNotNull()
    sized = regions.join(images.select("path", F.when(known, F.col("width")).alias("image_w"), F.when(known, F.col("height")).alias("image_h")), "path", "left")
    asked = text.crop_boxes(sized).where(~F.coalesce("skip", F.lit(False)))
    boxes = asked.groupBy("path").agg(F.collect_list(F.struct("region_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2", "scale")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.data is None:
                    rows += [(b["region_id"], None, None, None, "cannot read image") for b in r.boxes]
                    continue
                image = pixels(r.data, int(r.height), int(r.width), int(r.channels))
                for b in r.boxes:
                    try:
                        x1, y1, x2, y2 = (int(b[c]) for c in ("crop_x1", "crop_y1", "crop_x2", "crop_y2"))
                        made = raster.prepared(image[y1:y2, x1:x2], b["scale"])
                        rows.append((b["region_id"], made.shape[1], made.shape[0], png(made), None))
                    except ValueError as e:
                        rows.append((b["region_id"], None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CROP.split(", ")]).astype({"crop_w": "Int32", "crop_h": "Int32"})

    whole = boxes.join(images.select("path", "width", "height", "channels", "data"), "path", "left")
    return whole.select("path", "boxes", "width", "height", "channels", "data").mapInPandas(run, _CROP)
