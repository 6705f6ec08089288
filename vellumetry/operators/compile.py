"""Pages and volumes as text. Regions: page_id, region_id, rtype, y, text."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions.strings import safe_name
from vellumetry.operators.model import EXPORT_RANK
from vellumetry.operators.regions import compile_rank

# Fixed values of the compiled form.
PAGENUM_INDENT, FOOTNOTE_INDENT, PAGE_BREAK, HEAD_RULE = " " * 50, "  ", "\n" + "─" * 60 + "\n", "═" * 60
UNNAMED_ENGRAVING = "[ENGRAVING]"


def stripped(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def has_text(column: Column) -> Column:
    return column.isNotNull() & (stripped(column) != "")


def formatted(rtype: Column, text: Column) -> Column:
    """A region's text as its type is set."""
    return (
        F.when(rtype == "header", F.concat(text, F.lit("\n")))
        .when(rtype == "pagenum", F.concat(F.lit("\n" + PAGENUM_INDENT), text))
        .when(rtype == "footnote", F.concat(F.lit("\n" + FOOTNOTE_INDENT), text))
        .when(rtype == "engraving", F.concat(F.lit("\n[ENGRAVING — "), F.when(text == UNNAMED_ENGRAVING, "illustration").otherwise(text), F.lit("]\n")))
        .otherwise(text)
    )


def pages(regions: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, text): regions with text by rank, y and id, formatted and joined by line ends. Pages without text give no row.

    What is collected is one page's regions.
    """
    order = F.struct(compile_rank(F.col("rtype")).alias("rank"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("region_id"), formatted(F.col("rtype"), stripped(F.col("text"))).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s.t), "\n")
    return regions.where(has_text(F.col("text"))).groupBy(*by).agg(body.alias("text"))


def labelled(label: Column, text: Column) -> Column:
    """A page's text under its label and a blank line; without text just the label and its line end, without a label just the text."""
    own = F.coalesce(text, F.lit(""))
    under = F.when(own == "", own).otherwise(F.concat(F.lit("\n"), own))
    return F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("["), label, F.lit("]\n"), under)).otherwise(own)


def volume_head(title: Column, n_pages: Column, made_at: Column) -> Column:
    return F.concat(title, F.lit("\nGenerated: "), F.date_format(made_at, "yyyy-MM-dd HH:mm"), F.lit("\nPages: "), n_pages.cast("string"), F.lit(f"\n{HEAD_RULE}\n"))


def volumes(compiled: DataFrame, made_at: Column, title: Column | None = None, by: str = "volume_id") -> DataFrame:
    """(by, text, n_pages, char_count): a head, then each page under its label, a rule after it, in order of pos. compiled: by, pos, label, text.

    A null label becomes the page's number, an empty one is none. Pages with neither label nor text are
    counted in the head but left out. made_at is a parameter, so that the same input gives the same text.
    """
    name = F.coalesce("label", F.concat(F.lit("Page "), (F.col("pos") + 1).cast("string")))
    page = labelled(name, F.col("text"))
    part = F.when(stripped(page) != "", F.struct("pos", F.concat(page, F.lit("\n" + PAGE_BREAK)).alias("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s.t), "\n")
    kept = compiled.groupBy(by).agg(body.alias("body"), F.count("*").alias("n_pages"))
    head = volume_head(F.lit("Compiled Output") if title is None else title, F.col("n_pages"), made_at)
    return kept.select(by, F.concat(head, F.when(F.col("body") != "", F.concat(F.lit("\n"), "body")).otherwise("")).alias("text"), "n_pages").withColumn("char_count", F.length("text").cast("bigint"))


def volume_parts(compiled: DataFrame, made_at: Column, title: Column | None = None, by: str = "volume_id") -> DataFrame:
    """(by, pos, part): what volumes() makes, in parts, the head at pos -1 and then each page; put after each other in order of pos they are the text.

    No volume is gathered anywhere, so it may have any number of pages; write_parts() in sources.projects writes them in order.
    """
    name = F.coalesce("label", F.concat(F.lit("Page "), (F.col("pos") + 1).cast("string")))
    page = labelled(name, F.col("text"))
    parts = compiled.where(stripped(page) != "").select(by, F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("\n"), page, F.lit("\n" + PAGE_BREAK)).alias("part"))
    head = volume_head(F.lit("Compiled Output") if title is None else title, F.col("n"), made_at)
    heads = compiled.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(-1).cast("bigint").alias("pos"), head.alias("part"))
    return heads.unionByName(parts)


def project_text(regions: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, text): headers, body and footnotes of each page in this order, by y within a type, blank lines between; pages in order
    of volume, spread and side. regions: by, volume_pos, spread_pos, side (left, right), rtype, y, region_id, text. Columns don't count.

    A project's text is one value in the result, as the export is one file; export by volume where projects outgrow a row.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in EXPORT_RANK.items() for x in kv)), F.col("rtype"))
    kept = regions.where(F.col("rtype").isin(*EXPORT_RANK) & has_text(F.col("text")))
    part = F.struct("volume_pos", "spread_pos", F.col("side"), rank.alias("rank"), F.coalesce("y", F.lit(0.0)).alias("y"), "region_id", stripped(F.col("text")).alias("t"))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s.t), "\n\n").alias("text"))


class Exporter(Protocol):
    """What an exporter offers: a name, a file name ending, a media type, and rows of (id, file name, content)."""

    name: str
    extension: str
    media_type: str

    def export(self, regions: DataFrame, names: DataFrame) -> DataFrame: ...


class TextExporter:
    """Plain text, one file for each project."""

    name, extension, media_type = "Plain text", "txt", "text/plain"

    def export(self, regions: DataFrame, names: DataFrame, by: str = "project_id") -> DataFrame:
        """names: (by, name). (by, file_name, content, error): projects without text have an error in place of content."""
        text = project_text(regions, by)
        stem = safe_name(F.coalesce("name", F.lit("")))
        return names.join(text, by, "left").select(
            by,
            F.concat(stem, F.lit(f".{self.extension}")).alias("file_name"),
            F.col("text").alias("content"),
            F.when(F.col("text").isNull(), "no text to export").alias("error"),
        )
