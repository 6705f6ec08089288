"""Deeply nested records as flat tables with parent-child links (problem 3).

Method: Dewey labelling. Walking a record in document order gives every element of a collection the
label of its parent plus its own ordinal among all of the parent's children, as "0.3.1". The label of any ancestor is a truncation of it,
so parent links need no bookkeeping, and elements grouped by schema path are the flat tables.

What may differ between records is stated in a Schema: names are compared without case, "_" and "-";
a collection may be a list, a mapping from key to element, one element by itself, JSON text of any of
these, null, or absent; the whole may be wrapped in an envelope or be a JSON string of JSON, with or
without a byte order mark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.session import spread


@dataclass(frozen=True)
class Collection:
    """A collection of elements: its name, the names of the key that tells them apart, its scalar fields, its collections."""

    name: str
    keys: tuple[str, ...]
    fields: tuple[str, ...] = ()
    children: tuple[Collection, ...] = field(default=())
    #: keys that a mapping to elements may have, if these are fixed
    places: tuple[str, ...] = ()


# The saved project document's names.
_BOX = ("type", "x", "y", "w", "h", "confidence", "source", "column", "order")
PROJECT = Collection(
    "project",
    ("id",),
    ("name", "baseDir", "outputDir"),
    (
        Collection(
            "volumes",
            ("id",),
            ("name",),
            (
                Collection(
                    "spreads",
                    ("id",),
                    ("originalPath", "leftPath", "rightPath", "spineX", "splitMethod", "imageW", "imageH", "detectionRun"),
                    (
                        Collection(
                            "pages",
                            ("side",),
                            ("confirmed",),
                            (
                                Collection("segments", ("id",), _BOX),
                                Collection("ocrResults", ("id", "regionId", "segmentId"), ("text", "confidence", "word_count", "skipped", "error")),
                            ),
                            ("left", "right"),
                        ),
                    ),
                ),
            ),
        ),
    ),
)


def plain(name: str) -> str:
    return re.sub(r"[_\-\s]", "", name).lower()


def _loads(text: str) -> object:
    """The value of a JSON text, unwrapped as long as it is a string of JSON; ValueError if it isn't complete."""
    for _ in range(8):
        value = json.loads(text.lstrip("﻿").strip())
        if not isinstance(value, str):
            return value
        text = value
    raise ValueError("a string in a string, too deep")


def _value(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else json.dumps(value, ensure_ascii=False)


def _elements(value: object, of: Collection) -> Iterator[tuple[int, str | None, object]]:
    """(ordinal, key it is kept under, element) of a collection in any of its forms; null elements are counted but left out."""
    if isinstance(value, str):
        try:
            value = _loads(value)
        except ValueError:
            return
    if isinstance(value, list):
        yield from ((n, None, x) for n, x in enumerate(value) if x is not None)
    elif isinstance(value, dict):
        names = {plain(k) for k in value}
        own = {plain(x) for x in (*of.keys, *of.fields, *(c.name for c in of.children))}
        places = {plain(p) for p in of.places}
        single = bool(names & own) and not (places and names <= places) and not all(isinstance(x, dict | None) for x in value.values())
        if single:
            yield 0, None, value
        else:
            yield from ((n, k, x) for n, (k, x) in enumerate(value.items()) if x is not None)


def _walk(element: object, of: Collection, label: str, path: str, kept: str | None) -> Iterator[tuple[str, str, str | None, dict[str, str | None]]]:
    """(label, schema path, key, scalar fields) of an element and of all below it, in document order."""
    if not isinstance(element, dict):
        if kept is not None and not isinstance(element, list) and of.fields:
            yield label, path, kept, {of.fields[0]: _value(element)}
        return
    named = {plain(k): v for k, v in element.items()}
    key = next((_value(v) for k in of.keys if (v := named.get(plain(k))) is not None), kept)
    yield label, path, key, {f: _value(named[plain(f)]) for f in of.fields if named.get(plain(f)) is not None}
    first = 0  # children are numbered through, one collection after the other
    for child in of.children:
        last = -1
        for last, under, x in _elements(named.get(plain(child.name)), child):
            yield from _walk(x, child, f"{label}.{first + last}", f"{path}/{child.name}", under)
        first += last + 1


def nodes_of(body: str | None, schema: Collection = PROJECT) -> list[tuple[str, str, str | None, dict[str, str | None]]]:
    """All elements of one body; null, blank and incomplete ones have none."""
    if not body or not body.strip("﻿ \t\r\n"):
        return []
    try:
        value = _loads(body)
    except (ValueError, RecursionError):
        return []
    if isinstance(value, dict):
        named = {plain(k): v for k, v in value.items()}
        inner = named.get(plain(schema.name))
        if isinstance(inner, str):
            try:
                inner = _loads(inner)
            except ValueError:
                return []
        if isinstance(inner, dict):
            value = inner
    return list(_walk(value, schema, "0", schema.name, None))


def nodes(records: DataFrame, id_col: str = "record_id", body_col: str = "body", schema: Collection = PROJECT, fields: bool = True) -> DataFrame:
    """(record, label, path, key, fields MAP): one row for each element of each record; fields is left out on request. Narrow, no shuffle.

    Null, blank and incomplete bodies give none. Other columns are left out, so their names can't clash.
    """
    kind = dict(records.dtypes)[id_col]
    map_type = pa.map_(pa.string(), pa.string())
    names = ["record", "label", "path", "key", "fields"][: 5 if fields else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[str, str, str | None, dict]] = []
            for r, body in enumerate(batch.column(1).to_pylist()):
                got = nodes_of(body, schema)
                rows += [r] * len(got)
                out += got
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *(pa.array(columns[c], pa.string()) for c in range(3)),
                    *([pa.array([list(x.items()) for x in columns[3]], map_type)] if fields else []),
                ],
                names=names,
            )

    picked = records.select(F.col(id_col), F.col(body_col).cast("string"))
    return spread(picked).mapInArrow(run, f"record {kind}, label string, path string, key string" + (", fields map<string,string>" if fields else ""))


def ancestor(label: Column, levels: int) -> Column:
    """The label of the ancestor so many levels up: a truncation."""
    return F.regexp_replace(label, rf"(\.\d+){{{levels}}}$", "")


def flat_tables(labelled: DataFrame, schema: Collection = PROJECT) -> dict[str, DataFrame]:
    """One table for each schema path: record, label, parent (label), key, and the scalar fields as columns."""

    def visit(of: Collection, path: str) -> Iterator[tuple[str, DataFrame]]:
        own = labelled.where(F.col("path") == path)
        yield of.name, own.select("record", "label", ancestor(F.col("label"), 1).alias("parent"), "key", *(F.col("fields").getItem(f).alias(f) for f in of.fields if f not in ("label", "parent", "key", "record")))
        for child in of.children:
            yield from visit(child, f"{path}/{child.name}")

    return dict(visit(schema, schema.name))


def children_with_parents(labelled: DataFrame) -> DataFrame:
    """(record_id, volume_id, spread_id, side, kind, child_id) of every segment and OCR result, distinct.

    Ancestors are found by joining on truncated labels; only keys and labels are shuffled.
    """
    base = "project/volumes/spreads/pages"
    leaf = labelled.where(F.col("path").isin(f"{base}/segments", f"{base}/ocrResults")).select(
        "record",
        F.col("label"),
        F.when(F.col("path").endswith("segments"), "segment").otherwise("result").alias("kind"),
        F.col("key").alias("child_id"),
    )
    for up, (path, name) in enumerate(((base, "side"), ("project/volumes/spreads", "spread_id"), ("project/volumes", "volume_id")), 1):
        parents = labelled.where(F.col("path") == path).select(F.col("record"), F.col("label").alias("_p"), F.col("key").alias(name))
        leaf = leaf.withColumn("_p", ancestor(F.col("label"), up)).join(parents, ["record", "_p"], "left").drop("_p")
    return leaf.select(F.col("record").alias("record_id"), "volume_id", "spread_id", "side", "kind", "child_id").distinct()
