"""Spreads into pages: routing by shape, and the spine from a brightness profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.operators.model import SPLIT, Split


def route(spreads: DataFrame, width: str = "image_w", height: str = "image_h", spine: str = "spine_x", p: Split = SPLIT) -> DataFrame:
    """Adds is_single, and spine and right_path as they must be: a single page's spine is its width and it has no right page.

    Null or zero sizes leave is_single null and the rest as it is.
    """
    shape = F.when(F.col(height) > 0, F.col(width) / F.col(height))
    single = shape < p.single_below
    return (
        spreads.withColumn("is_single", single)
        .withColumn(spine, F.when(single, F.col(width)).otherwise(F.col(spine)))
        .withColumn("right_path", F.when(single, F.lit(None).cast("string")).otherwise(F.col("right_path")))
    )


def profile_rows(profiles: DataFrame, id_col: str, values: str) -> DataFrame:
    """(id, x, b): one row for each position of an array profile; null and empty profiles give none."""
    return profiles.select(F.col(id_col).alias("id"), F.posexplode(values).alias("x", "b")).select("id", "x", F.col("b").cast("double").alias("b"))


def spines(rows: DataFrame, p: Split = SPLIT) -> DataFrame:
    """(id, spine_x, method) from (id, x, b) with x from 0: the darkest place of the smoothed profile's middle band, if it is dark enough.

    The smoothing divides by the kernel's size at the ends too, as a zero-padded convolution does.
    Profiles are windows of one page's columns, so no group grows with the data.
    """
    half = p.smoothing // 2
    ordered = Window.partitionBy("id").orderBy("x")
    smooth = rows.select(
        "id",
        "x",
        (F.sum("b").over(ordered.rowsBetween(-half, p.smoothing - half - 1)) / p.smoothing).alias("s"),
        F.count("*").over(Window.partitionBy("id")).alias("w"),
    )
    inside = (F.col("x") >= (F.col("w") * p.band[0]).cast("int")) & (F.col("x") < (F.col("w") * p.band[1]).cast("int"))
    found = smooth.groupBy("id").agg(
        F.max("w").alias("w"),
        F.avg("s").alias("mean"),
        F.min(F.when(inside, F.col("s"))).alias("low"),
        F.min_by(F.when(inside, F.col("x")), F.when(inside, F.struct(F.round("s", 9).alias("s"), "x"))).alias("at"),
    )
    deep = ((F.col("mean") - F.col("low")) / (F.col("mean") + 1e-6)) >= p.contrast
    place = F.when(deep, F.col("at")).otherwise(F.floor(F.col("w") / 2))
    clamped = F.greatest((F.col("w") * p.clamp[0]).cast("int"), F.least((F.col("w") * p.clamp[1]).cast("int"), place))
    return found.select("id", clamped.cast("bigint").alias("spine_x"), F.when(deep, "detected").otherwise("centre").alias("method"))
