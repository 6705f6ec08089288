"""The page tables as DataFrames, and the row sets that several operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Region types whose text is running text (fixed values).
BODY_TYPES = ("body", "footnote")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_type(column: Column) -> Column:
    """Region types come in mixed case and with blanks; they are compared trimmed and in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def is_text(column: Column) -> Column:
    """Neither null nor blank; all Unicode white space counts as blank."""
    return column.isNotNull() & column.rlike(r"[^\s\p{Z}\x{FEFF}\x{200B}]")


def body_results(spark: SparkSession, sf_dir: str, *columns: str, confirmed: bool | None = None) -> DataFrame:
    """Rows of ocr_results whose region is body or footnote and whose text isn't null or blank.

    Regions arrive twice at times, so this is a semi join: no result is repeated. confirmed keeps
    the results of (un)confirmed pages only. A region that is gone, or a page that is, drops out.
    """
    regions = (
        table(spark, sf_dir, "ocr_regions")
        .where(clean_type(F.col("region_type")).isin(*BODY_TYPES))
        .select("region_id")
    )
    results = table(spark, sf_dir, "ocr_results").where(is_text(F.col("text")) & F.col("region_id").isNotNull())
    keep = list(dict.fromkeys(["result_id", *columns]))
    if confirmed is not None:
        pages = table(spark, sf_dir, "scan_pages").where(F.coalesce("confirmed", F.lit(False)) == confirmed).select("page_id")
        results = results.select(*dict.fromkeys([*keep, "region_id", "page_id"])).join(pages.hint("shuffle_hash"), "page_id", "left_semi")
    else:
        results = results.select(*dict.fromkeys([*keep, "region_id"]))
    return results.join(regions.hint("shuffle_hash"), "region_id", "left_semi").select(*keep)
