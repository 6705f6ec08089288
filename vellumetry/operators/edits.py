"""Edits of saved pages as relational operations: an edit log is merged, later edits win. All results are new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.operators.model import EDITABLE_TYPES


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by order, nulls first. An aggregate: partial maxima cut a hot key's rows down on their own tasks."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows put in by key; new wins, and of new's own duplicates the greatest by all its columns. All columns must be sortable."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, ["_new", *(c for c in old.columns if c not in keys)]).drop("_new")


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a row in done: work that is left."""
    return items.join(done.select(key), key, "left_anti")


def replaced(segments: DataFrame, found: DataFrame, page: str = "page_id") -> DataFrame:
    """Detection run again: pages in found lose all their segments to the new ones. Results stay; orphans() shows what they have lost."""
    return segments.join(found.select(page).distinct(), page, "left_anti").unionByName(found, allowMissingColumns=True)


def orphans(results: DataFrame, segments: DataFrame, key: str = "region_id") -> DataFrame:
    return results.join(segments.select(key), key, "left_anti")


def drawn(segments: DataFrame, log: DataFrame) -> DataFrame:
    """log: page_id, region_id, rtype, x, y, w, h, w_px, h_px. Boxes under 10 pixels either way are dropped; the rest are sure and manual."""
    new = log.where((F.col("w_px") >= 10) & (F.col("h_px") >= 10)).withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("manual")).drop("w_px", "h_px")
    return segments.unionByName(new, allowMissingColumns=True)


def moved(segments: DataFrame, log: DataFrame) -> DataFrame:
    """log: region_id, at, x, y, w_px, h_px, page_w, page_h. The last move of a region holds; at least 20 x 16 pixels; not beyond the left and top."""
    last = latest_by(log, ["region_id"], ["at", "x", "y", "w_px", "h_px"]).select(
        "region_id",
        F.greatest(F.lit(0.0), "x").alias("_x"),
        F.greatest(F.lit(0.0), "y").alias("_y"),
        (F.greatest(F.lit(20.0), "w_px") / F.col("page_w")).alias("_w"),
        (F.greatest(F.lit(16.0), "h_px") / F.col("page_h")).alias("_h"),
    )
    joined = segments.join(last, "region_id", "left")
    for c in "xywh":
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined


def deleted(segments: DataFrame, results: DataFrame, log: DataFrame, key: str = "region_id") -> tuple[DataFrame, DataFrame]:
    """Segments and results without the deleted regions."""
    gone = log.select(key)
    return segments.join(gone, key, "left_anti"), results.join(gone, key, "left_anti")


def retyped(segments: DataFrame, log: DataFrame) -> DataFrame:
    """log: region_id, at, new_type. The last valid type holds; a person is sure."""
    last = latest_by(log.where(F.col("new_type").isin(*EDITABLE_TYPES)), ["region_id"], ["at", "new_type"]).select("region_id", "new_type")
    joined = segments.join(last, "region_id", "left")
    sure = F.when(F.col("new_type").isNotNull(), 1.0).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", sure).withColumn("rtype", F.coalesce("new_type", "rtype")).drop("new_type")


def retexted(results: DataFrame, log: DataFrame, key: str = "region_id") -> DataFrame:
    """log: key, at, new_text. Text changes; word count and confidence stay as recognised."""
    last = latest_by(log, [key], ["at", "new_text"]).select(key, "new_text")
    return results.join(last, key, "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def reordered(spreads: DataFrame, moves: DataFrame, by: str = "volume_id") -> DataFrame:
    """moves: (by, from_pos, to_pos), one move for each volume: the spread at from_pos is taken out and put in at to_pos."""
    joined = spreads.join(moves, by, "left")
    pos, a, b = F.col("pos"), F.col("from_pos"), F.col("to_pos")
    shifted = F.when(pos == a, b).when((pos > a) & (pos <= b), pos - 1).when((pos < a) & (pos >= b), pos + 1).otherwise(pos)
    return joined.withColumn("pos", F.when(a.isNull(), pos).otherwise(shifted)).drop("from_pos", "to_pos")


def renumbered(spreads: DataFrame, by: str = "volume_id", key: str = "spread_id") -> DataFrame:
    """pos made gapless from 0, as after a spread is deleted."""
    order = Window.partitionBy(by).orderBy("pos", key)
    return spreads.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def detection_flags(new_lines: bool) -> dict[str, bool]:
    """One switch sets paragraphs and lines together; merging is its opposite."""
    return {"merge_body": not new_lines, "preserve_paras": new_lines, "preserve_newlines": new_lines}


def shown_types(regions: DataFrame, off: list[str]) -> DataFrame:
    """Regions whose type isn't switched off; a type without a switch, null too, is shown."""
    return regions.where(F.col("rtype").isNull() | ~F.col("rtype").isin(*off)) if off else regions


def mean_confidence(spreads: DataFrame, results: DataFrame, key: str = "spread_id") -> DataFrame:
    """(key, confidence): the mean over a spread's results, missing ones as 0; 0 without results."""
    mean = results.groupBy(key).agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("m"))
    return spreads.select(key).distinct().join(mean, key, "left").select(key, F.coalesce("m", F.lit(0.0)).alias("confidence"))
