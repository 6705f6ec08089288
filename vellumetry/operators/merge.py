"""Merges whose result depends on the order boxes are taken in. Each works on one page's boxes, which are few, many pages in an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.operators.model import LAYOUT, Layout

REGION = "page_id bigint, slot bigint, rtype string, confidence double, source string, col_no int, x double, y double, w double, h double"
_NAMES = [c.split()[0] for c in REGION.split(", ")]


def _iou(a: dict, b: dict) -> float:
    width = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    height = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if width <= 0 or height <= 0:
        return 0.0
    shared = width * height
    return shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared)


def _union(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return {"x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y}


def merge_overlaps(boxes: list[dict], p: Layout = LAYOUT) -> list[dict]:
    """Each box not yet taken, in order of y, x and slot, takes all later ones that overlap it (not what it has grown to).

    The group's surest member, the first on ties, gives type, source and slot; its confidence drops a little.
    """
    left = sorted(boxes, key=lambda b: (b["y"], b["x"], b["slot"]))
    out = []
    while left:
        seed, *rest = left
        group = [seed, *(b for b in rest if _iou(seed, b) > p.overlap)]
        left = [b for b in rest if not _iou(seed, b) > p.overlap]
        if len(group) == 1:
            out.append(seed)
            continue
        best = max(group, key=lambda b: b["confidence"])
        box = dict(group[0])
        for b in group[1:]:
            box |= _union(box, b)
        out.append({**best, **{k: box[k] for k in "xywh"}, "confidence": best["confidence"] * p.merged_confidence})
    return out


def merge_adjacent(boxes: list[dict], gap: float, p: Layout = LAYOUT, reset_column: bool = False) -> list[dict]:
    """Joins boxes of one type and column, one under the other within gap, in passes until nothing joins any more.

    A pass takes the boxes in order of y, x and slot; each grows by every later one that fits what it has
    grown to. They must overlap sideways by half the narrower one and not overlap downward. The upper
    one's slot and source stay, the higher confidence too. reset_column gives joined boxes column 0, so
    that they may join across columns later; without it columns never mix.
    """
    left, joined = boxes, True
    while joined:
        joined, out = False, []
        left = sorted(left, key=lambda b: (b["y"], b["x"], b["slot"]))
        while left:
            a, rest = left[0], []
            for b in left[1:]:
                space = b["y"] - (a["y"] + a["h"])
                side = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
                if a["rtype"] == b["rtype"] and a["col_no"] == b["col_no"] and 0 <= space <= gap and side >= p.column_overlap * min(a["w"], b["w"]):
                    a = {**a, **_union(a, b), "confidence": max(a["confidence"], b["confidence"]), "col_no": 0 if reset_column else a["col_no"]}
                    joined = True
                else:
                    rest.append(b)
            out.append(a)
            left = rest
        left = out
    return left


def blend_template(boxes: list[dict], expected: list[dict], p: Layout = LAYOUT) -> list[dict]:
    """Each expected box raises the detected one that overlaps it most, whatever its type, or is added at a lower confidence. Of equals the lower slot counts."""
    out, used = [dict(b) for b in sorted(boxes, key=lambda b: b["slot"])], set()
    for e in sorted(expected, key=lambda b: b["slot"]):
        best = max(((_iou(b, e), -i) for i, b in enumerate(out[: len(boxes)])), default=(0.0, 0))
        if best[0] > p.blend_overlap and -best[1] not in used:
            used.add(-best[1])
            b = out[-best[1]]
            b |= {"confidence": min(0.98, b["confidence"] + 0.15), "source": "detected+template"}
        else:
            sure = e["confidence"]
            out.append({**e, "source": "template", "confidence": (0.70 if sure is None else sure) * 0.85})
    return out


def joined_by_type(boxes: list[dict], gap: float | None, collapse: bool, p: Layout = LAYOUT, reset_column: bool = False) -> list[dict]:
    """Body joined within gap (None: left as it is), other types within theirs; collapse then makes one box of all body of a column."""
    body = [b for b in boxes if b["rtype"] == "body"]
    rest = [b for b in boxes if b["rtype"] != "body"]
    if gap is not None:
        body = merge_adjacent(body, gap, p, reset_column)
    if collapse:
        columns: dict[int, dict] = {}
        for b in sorted(body, key=lambda b: (b["y"], b["x"], b["slot"])):
            a = columns.get(b["col_no"])
            columns[b["col_no"]] = b if a is None else {**a, **_union(a, b), "confidence": max(a["confidence"], b["confidence"])}
        body = list(columns.values())
    return body + merge_adjacent(rest, p.gap_other, p, reset_column)


def _with_columns(boxes: list[dict], gutter: float | None) -> list[dict]:
    return [{**b, "col_no": 0 if b["rtype"] != "body" or gutter is None else 1 if b["x"] + b["w"] / 2 < gutter else 2} for b in boxes]


def lay_out(boxes: list[dict], gutter: float | None, due: list[dict] | None, gap: float | None, collapse: bool, p: Layout = LAYOUT) -> list[dict]:
    """A page's typed boxes as regions in reading order: overlaps, noise, columns, neighbours, headers that aren't, what is due, order."""
    kept = [b for b in merge_overlaps(boxes, p) if not (b["rtype"] == "unknown" and b["confidence"] < p.noise)]
    out = joined_by_type(_with_columns(kept, gutter), gap, collapse, p)
    first = min((b["y"] for b in out if b["rtype"] == "body"), default=None)
    out = [{**b, "rtype": "body"} if b["rtype"] == "header" and first is not None and b["y"] >= first else b for b in out]
    if due is not None:
        base = max((b["slot"] for b in out), default=0)
        out = blend_template(out, [{**e, "slot": e["slot"] + base} for e in due], p)
    out = _with_columns(out, gutter)
    two = {b["col_no"] for b in out if b["rtype"] == "body"} >= {1, 2}
    rank = {"header": 0, "body": 1, "pagenum": 3}
    out.sort(key=lambda b: (rank.get(b["rtype"], 2), b["col_no"] if two and b["rtype"] == "body" else 0, b["y"], b["slot"]))
    return [{**b, "ord": n} for n, b in enumerate(out)]


def _lists(column: pa.ListArray) -> list[list[dict] | None]:
    """The boxes of each page; null where there is no list."""
    flat = column.flatten()
    names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    rows = [dict(zip(names, values, strict=True)) for values in zip(*(flat.field(i).to_pylist() for i in range(len(names))), strict=True)]
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else rows[at : at + n])
        at += n or 0
    return out


def _pages(regions: DataFrame, name: str) -> DataFrame:
    """One row for each page with its boxes as an array; a page's boxes are few."""
    return regions.groupBy("page_id").agg(F.collect_list(F.struct(*_NAMES[1:])).alias(name))


_ARROW = [("page_id", pa.int64()), ("slot", pa.int64()), ("rtype", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("col_no", pa.int32()), *((c, pa.float64()) for c in "xywh")]


def _flat(pages: DataFrame, run: Callable[..., list[dict]], more: tuple[tuple[str, pa.DataType], ...] = ()) -> DataFrame:
    """run over the arrays (and other columns) of each page, many pages in an Arrow batch: no frame is built for a page."""
    arrow = [*_ARROW, *more]

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            out: list[dict] = []
            columns = [_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns[1:]]
            for page_id, *given in zip(batch.column(0).to_pylist(), *columns, strict=True):
                found = run(*given)
                ids += [page_id] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([b[name] for b in out], kind) for name, kind in arrow[1:])], names=[name for name, _ in arrow])

    kinds = {pa.int64(): "bigint"}
    return pages.mapInArrow(batched, REGION + "".join(f", {name} {kinds[kind]}" for name, kind in more))


def _grouped(regions: DataFrame, run: Callable[[list[dict]], list[dict]], may_join: Callable[[Column, Column], Column]) -> DataFrame:
    """run over pages with a pair of boxes that may join; the others, mostly nearly all, never leave the JVM."""
    pages = _pages(regions, "boxes")
    pair = F.exists("boxes", lambda a: F.exists("boxes", lambda b: (a["slot"] != b["slot"]) & may_join(a, b)))
    marked = pages.withColumn("_pair", F.coalesce(pair, F.lit(True)))
    rest = marked.where(~F.col("_pair")).select("page_id", F.inline("boxes"))
    return _flat(marked.where("_pair").select("page_id", "boxes"), run).unionByName(rest.select(*_NAMES))


def _side(a: Column, b: Column, at: str, size: str) -> Column:
    """How far two boxes' extents overlap along one axis; negative if they don't."""
    return F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at])


def _typed(regions: DataFrame, unsure: float | None = 0.0) -> DataFrame:
    """The columns the merges need. Boxes without a place are left out; a null confidence counts as unsure, a null column as 0."""
    for name, default in (("source", F.lit("detected")), ("col_no", F.lit(0))):
        if name not in regions.columns:
            regions = regions.withColumn(name, default)
    typed = regions.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in REGION.split(", "))).where("x is not null and y is not null and w is not null and h is not null")
    return typed.fillna({"col_no": 0} if unsure is None else {"col_no": 0, "confidence": unsure})


def overlaps_merged(regions: DataFrame, p: Layout = LAYOUT) -> DataFrame:
    def may_join(a: Column, b: Column) -> Column:
        width, height = _side(a, b, "x", "w"), _side(a, b, "y", "h")
        union = a["w"] * a["h"] + b["w"] * b["h"] - width * height
        return (width > 0) & (height > 0) & (width * height > p.overlap * union * 0.999)  # a little wide; Python decides

    return _grouped(_typed(regions), lambda boxes: merge_overlaps(boxes, p), may_join)


def body_gap(mode: str, p: Layout = LAYOUT) -> float | None:
    return {"newlines": None, "paragraphs": p.gap_paragraph, "default": p.gap_body}[mode]


def adjacent_merged(regions: DataFrame, mode: str = "default", collapse: bool = False, p: Layout = LAYOUT, reset_column: bool = False) -> DataFrame:
    """mode: newlines leaves body as it is, paragraphs joins close body, default joins it widely; other types are always joined.

    collapse then makes one box of all body of a column.
    """
    gap = body_gap(mode, p)

    def run(boxes: list[dict]) -> list[dict]:
        return joined_by_type(boxes, gap, collapse and mode == "default", p, reset_column)

    def may_join(a: Column, b: Column) -> Column:
        same = a["rtype"].eqNullSafe(b["rtype"]) & (a["col_no"] == b["col_no"])
        is_body = a["rtype"].eqNullSafe("body")
        limit = F.when(is_body, -1.0 if gap is None else gap).otherwise(p.gap_other)
        space = b["y"] - (a["y"] + a["h"])
        near = (space >= -1e-9) & (space <= limit + 1e-9) & (_side(a, b, "x", "w") >= p.column_overlap * F.least(a["w"], b["w"]) - 1e-9)
        return same & (near | (is_body if collapse and mode == "default" else F.lit(False)))

    return _grouped(_typed(regions), run, may_join)


def template_blended(regions: DataFrame, expected: DataFrame, p: Layout = LAYOUT) -> DataFrame:
    """expected: (page_id, slot, rtype, confidence, x, y, w, h); pages on either side alone are kept. Added boxes' slots follow the page's own."""

    def page(found: list[dict] | None, due: list[dict] | None) -> list[dict]:
        base = max((b["slot"] for b in found or ()), default=0)
        return blend_template(found or [], [{**e, "slot": e["slot"] + base} for e in due or ()], p)

    both = _pages(_typed(regions), "found").join(_pages(_typed(expected, None), "due"), "page_id", "full")
    return _flat(both.select("page_id", "found", "due"), page)


def laid_out(typed: DataFrame, gutters: DataFrame, expected: DataFrame | None = None, mode: str = "default", collapse: bool = True, p: Layout = LAYOUT) -> DataFrame:
    """Regions in reading order (ord from 0) from typed boxes: every step of a page, from overlaps to order, in one pass over its boxes.

    gutters: (page_id, gutter); expected: as for template_blended(). Pages that are only expected have what is expected.
    """
    gap, collapse = body_gap(mode, p), collapse and mode == "default"
    pages = _pages(_typed(typed), "found").join(gutters.select("page_id", F.col("gutter").cast("double").alias("gutter")), "page_id", "left")
    if expected is None:
        return _flat(pages.select("page_id", "found", "gutter"), lambda found, gutter: lay_out(found, gutter, None, gap, collapse, p), (("ord", pa.int64()),))
    both = pages.join(_pages(_typed(expected, None), "due"), "page_id", "full").select("page_id", "found", "gutter", "due")
    return _flat(both, lambda found, gutter, due: lay_out(found or [], gutter, due or [], gap, collapse, p), (("ord", pa.int64()),))
