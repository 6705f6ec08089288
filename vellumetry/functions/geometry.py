"""Boxes as columns: x, y, w, h are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(alias: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{alias}.{c}") for c in "xywh")


def intersection(a: str, b: str) -> Column:
    """Shared area of two aliased rows with x, y, w, h; 0 if they don't meet."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = box(a), box(b)
    width = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    height = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two aliased rows; null for two boxes without area."""
    (*_, aw, ah), (*_, bw, bh) = box(a), box(b)
    shared = intersection(a, b)
    union = aw * ah + bw * bh - shared
    return F.when(union > 0, shared / union)
