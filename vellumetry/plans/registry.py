"""The queries over the page tables and the SQL that must give the same rows.

Every query runs over its whole tables. The SQL of merges that depend on the order boxes are taken in is recursive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumetry.functions import strings
from vellumetry.operators import compile as compiling
from vellumetry.operators import edits, merge, regions, split, template, text
from vellumetry.operators.nested import children_with_parents, flat_tables, nodes
from vellumetry.plans import detect, merge_sql, nested_sql
from vellumetry.session import stored
from vellumetry.sources.tables import clean_type, table

# ---------------------------------------------------------------- inputs


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate boxes with density and sharpness, made from lineitem: an order is a page, its lines are boxes."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *keys)
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys)).cast("bigint")
    cents = lambda e: e.cast("double") / 100
    return rows.select(
        F.col("l_orderkey").alias("page_id"),
        slot.alias("slot"),
        cents(F.col("l_partkey") % 80).alias("x"),
        cents(F.col("l_suppkey") % 95).alias("y"),
        cents(5 + F.col("l_partkey") % 45).alias("w"),
        cents(1 + F.col("l_suppkey") % 9).alias("h"),
        (F.col("l_quantity") / 100).alias("td"),
        (F.col("l_extendedprice") / 100).alias("sharp"),
    )


_LAYOUT_SQL = """layout as (select *, case when y<0.20 and h<0.08 and w>0.20 then 'header' when y<0.20 and h<0.08 and w<=0.20 then 'pagenum'
 when y>0.90 and h<0.06 and w<0.30 then 'pagenum' when td>0.03 then 'body' else 'unknown' end rtype from (
 select l_orderkey page_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) as bigint) slot,
 cast(l_partkey%80 as double)/100 x, cast(l_suppkey%95 as double)/100 y, cast(5+l_partkey%45 as double)/100 w, cast(1+l_suppkey%9 as double)/100 h,
 l_quantity/100 td, l_extendedprice/100 sharp from lineitem) k)"""


def _typed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.classified(_layout(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, once each: region_id, page_id, rtype, x, y, w, h, confidence, source, col_no, slot."""
    rows = table(spark, sf_dir, "ocr_regions").distinct()
    rtype = F.coalesce(F.nullif(clean_type(F.col("region_type")), F.lit("")), F.lit("unknown"))
    boxes = (F.col(f"box_{c}").alias(c) for c in "xywh")
    return rows.select("region_id", "page_id", rtype.alias("rtype"), *boxes, "confidence", F.col("region_source").alias("source"), "col_no", F.col("region_id").alias("slot"))


_REGIONS_SQL = r"""reg as (select distinct region_id, page_id, coalesce(nullif(lower(regexp_replace(region_type,'^\s+|\s+$','','g')),''),'unknown') rtype,
 box_x x, box_y y, box_w w, box_h h, confidence, region_source source, col_no from ocr_regions)"""


def _spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_spreads").distinct()


_SPREADS_SQL = "spr as (select distinct * from scan_spreads)"


def _latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each region: by time of recognition, unknown times first, then by id."""
    rows = table(spark, sf_dir, "ocr_results").where("region_id is not null").select("region_id", "result_id", "page_id", "volume_id", "text", "confidence", "word_count", "recognized_at")
    return edits.latest_by(rows.withColumn("at", F.coalesce("recognized_at", F.lit("1900-01-01").cast("timestamp_ntz"))), ["region_id"], ["at", "result_id"]).drop("at")


_LATEST_SQL = """res as (select region_id, result_id, page_id, volume_id, text, confidence, word_count, recognized_at from (select *, row_number() over (partition by region_id
 order by coalesce(recognized_at, timestamp '1900-01-01') desc, result_id desc) rn from ocr_results where region_id is not null) z where rn=1)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their last result, page side, spread and volume."""
    pages = table(spark, sf_dir, "scan_pages").select("page_id", "spread_id", "side", "confirmed")
    spreads = _spreads(spark, sf_dir).select("spread_id", "volume_id", "pos", "right_path", "image_w", "image_h")
    results = _latest_results(spark, sf_dir).select("region_id", "text", F.col("confidence").alias("sure"))
    return _regions(spark, sf_dir).join(results, "region_id", "left").join(pages, "page_id").join(spreads, "spread_id")


_PLACED_SQL = f"""{_REGIONS_SQL}, {_LATEST_SQL}, {_SPREADS_SQL}, placed as (select r.*, p.spread_id, p.side, p.confirmed, s.volume_id, s.pos, s.right_path, s.image_w, s.image_h,
 t.text, t.confidence sure from reg r left join res t using (region_id) join scan_pages p on r.page_id=p.page_id join spr s on p.spread_id=s.spread_id)"""

_STRIP = r"regexp_replace(text,'^[\s\p{Z}]+|[\s\p{Z}]+$','','g')"

# ---------------------------------------------------------------- sources and splitting


def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.route(_spreads(spark, sf_dir)).select("spread_id", "is_single", "spine_x", "right_path")


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("original_path")
    return _spreads(spark, sf_dir).select(
        "spread_id", strings.basename(path).alias("file_name"), strings.suffix(path).alias("suffix"), strings.media_type(path).alias("media_type"), strings.accepted(path).alias("accepted")
    )


def spine_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.profile_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("b", 1.0 + 4.0 * F.col("b"))
    return split.spines(rows).select(F.col("id").alias("vec_id"), "spine_x", "method")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_volumes").select("volume_id", strings.safe_name(F.col("volume_name")).alias("file_stem"))


def project_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "project_files").select("file_name", "record_id", "saved_at")
    return edits.latest_by(rows.where("file_name is not null"), ["file_name"], ["saved_at", "record_id"]).select("file_name", "record_id", "saved_at")


# ---------------------------------------------------------------- detection


def layout_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_layout(spark, sf_dir).select("page_id", "slot", "rtype", "confidence")


def geometry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).where(regions.geometry_ok()).select("page_id", "slot")


def sharpness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sharp_enough(_layout(spark, sf_dir)).select("page_id", "slot")


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlapping_pairs(_layout(spark, sf_dir)).select("page_id", "s1", "s2")


def iou_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _layout(spark, sf_dir)
    return regions.best_overlaps(boxes, boxes).select("page_id", "s1", "s2", F.round("iou", 9).alias("iou"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.without_noise(_typed_layout(spark, sf_dir)).select("page_id", "slot", "rtype")


def demote_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.demoted_headers(_typed_layout(spark, sf_dir)).select("page_id", "slot", "rtype")


def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by the middle between the leftmost and rightmost body centres of each page."""
    boxes = _typed_layout(spark, sf_dir)
    centre = F.col("x") + F.col("w") / 2
    gutters = boxes.where("rtype = 'body'").groupBy("page_id").agg(((F.min(centre) + F.max(centre)) / 2).alias("gutter"))
    return regions.with_columns_assigned(boxes, gutters).select("page_id", "slot", F.col("col_no").cast("bigint").alias("col_no"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.reading_order(_regions(spark, sf_dir), "region_id").select("page_id", "region_id", "ord")


def body_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.collapsed_bodies(_typed_layout(spark, sf_dir))


def adjacent_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.islands(_typed_layout(spark, sf_dir), 0.10).withColumn("g", F.col("g").cast("bigint"))


def _rounded(boxes: DataFrame, *more: str) -> DataFrame:
    """The columns of merged regions; places to nine decimals, as sums of doubles depend on their order."""
    return boxes.select("page_id", "slot", "rtype", F.round("confidence", 6).alias("confidence"), "source", F.col("col_no").cast("bigint").alias("col_no"), *(F.round(c, 9).alias(c) for c in "xywh"), *more)


_ROUNDED = "page_id, cast(slot as bigint) slot, rtype, round(confidence,6) confidence, source, cast(col_no as bigint) col_no, round(x,9) x, round(y,9) y, round(w,9) w, round(h,9) h"
_TYPED_SQL = f"""{_LAYOUT_SQL}, typed as (select page_id, slot, rtype, case when y<0.20 and h<0.08 and w>0.20 then 0.88 when y<0.20 and h<0.08 then 0.82 when y>0.90 and h<0.06 and w<0.30 then 0.85
 when td>0.03 then 0.80 when w*h<0.002 then 0.10 else 0.40 end::double confidence, 'detected' source, 0 col_no, x, y, w, h from layout)"""


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merge.overlaps_merged(_typed_layout(spark, sf_dir)))


def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merge.adjacent_merged(_typed_layout(spark, sf_dir), "default", collapse=True))


def adjacent_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merge.adjacent_merged(_typed_layout(spark, sf_dir), "paragraphs"))


def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(merge.adjacent_merged(_typed_layout(spark, sf_dir), "newlines"))


def detect_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps from candidate boxes to ordered regions, on pages of 1000 pixels made from the layout boxes; a third of the pages have two columns."""
    pixel = lambda c: F.round(F.col(c) * 1000).cast("int").alias(f"b{c}")
    size = [F.lit(v).alias(n) for n, v in (("px", 0), ("py", 0), ("page_w", 1000), ("page_h", 1000), ("crop_w", 1000), ("crop_h", 1000))]
    gutter = F.when(F.col("page_id") % 3 == 0, 0.5).alias("gutter")
    boxes = _layout(spark, sf_dir).select("page_id", "slot", *map(pixel, "xywh"), *size, "sharp", "td", gutter)
    return _rounded(detect.detect(boxes), "ord")


_TWO_COLUMNS = "case when rtype<>'body' or page_id%3<>0 then 0 when x+w/2<0.5 then 1 else 2 end"
_DETECT_SQL = f"""with recursive {_LAYOUT_SQL}, px as (select page_id, slot, sharp, td, round(x*1000)::int/1000 x, round(y*1000)::int/1000 y, round(w*1000)::int/1000 w, round(h*1000)::int/1000 h from layout),
 good as (select * from px where w*h>=0.0005 and w*h<=0.85 and h>=0.010 and not (x<0.12 and w<0.13) and not (x+w>cast(1-0.12 as double) and w<0.13) and not (h>0.60 and w/(h+1e-6)<0.25) and not (x+w/2>0.42 and x+w/2<0.58 and w<0.12)),
 clear as (select g.* from good g join (select page_id, count(*) n, median(sharp) m from good group by page_id) k on g.page_id=k.page_id where sharp >= case when n>=3 then greatest(30.0,0.15*m) else 30.0 end),
 named as (select page_id, slot, case when y<0.20 and h<0.08 and w>0.20 then 'header' when y<0.20 and h<0.08 then 'pagenum' when y>0.90 and h<0.06 and w<0.30 then 'pagenum' when td>0.03 then 'body' else 'unknown' end rtype,
  case when y<0.20 and h<0.08 and w>0.20 then 0.88 when y<0.20 and h<0.08 then 0.82 when y>0.90 and h<0.06 and w<0.30 then 0.85 when td>0.03 then 0.80 when w*h<0.002 then 0.10 else 0.40 end::double confidence, 'detected' source, 0 col_no, x, y, w, h from clear),
 {merge_sql.overlaps('named', 'apart')}, quiet as (select * replace ({_TWO_COLUMNS} as col_no) from apart where not (rtype='unknown' and confidence<0.20)),
 {merge_sql.adjacent('quiet', 'body_', 0.10, "rtype='body'")}, {merge_sql.collapsed('body_', 'one')}, {merge_sql.adjacent('quiet', 'rest', 0.06, "rtype<>'body'")},
 both_ as (select * from one union all by name select * from rest), low as (select *, min(case when rtype='body' then y end) over (partition by page_id) first_y from both_),
 fin as (select * replace (case when rtype='header' and y>=first_y then 'body' else rtype end as rtype) from low), col as (select * replace ({_TWO_COLUMNS} as col_no) from fin),
 two as (select *, coalesce(max(case when rtype='body' and col_no=1 then 1 end) over (partition by page_id)=1 and max(case when rtype='body' and col_no=2 then 1 end) over (partition by page_id)=1, false) t from col)
 select {_ROUNDED}, cast(row_number() over (partition by page_id order by case rtype when 'header' then 0 when 'body' then 1 when 'pagenum' then 3 else 2 end, case when rtype='body' and t then col_no else 0 end, y, slot)-1 as bigint) ord from two"""


# ---------------------------------------------------------------- templates


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "scan_pages").where("confirmed").select("page_id", "spread_id")
    spreads = _spreads(spark, sf_dir).select("spread_id", "volume_id")
    return _regions(spark, sf_dir).join(pages, "page_id").join(spreads, "spread_id")


_BLEND_SQL = """pgs as (select p.page_id, s.volume_id from scan_pages p join spr s on p.spread_id=s.spread_id), pre as (select c.volume_id, rtype, k, mean_x x, mean_y y, mean_w w, mean_h h, confidence from slc c join smp m on c.volume_id=m.volume_id where n>=3 and n_samples>=3),
 due as (select page_id, cast(row_number() over (partition by page_id order by rtype, k) as bigint) slot, rtype, confidence, x, y, w, h from pgs join pre using (volume_id)),
 fnd as (select page_id, cast(row_number() over (partition by page_id order by region_id) as bigint) slot, rtype, coalesce(confidence,0.0) confidence, source, coalesce(col_no,0) col_no, x, y, w, h from reg)"""
_CONFIRMED_SQL = f"""{_REGIONS_SQL}, {_SPREADS_SQL}, conf as (select r.*, s.volume_id from reg r join scan_pages p on r.page_id=p.page_id join spr s on p.spread_id=s.spread_id where p.confirmed),
 sl as (select volume_id, rtype, k, count(*) n, avg(x) mean_x, avg(y) mean_y, avg(w) mean_w, avg(h) mean_h, case when count(*)<2 then 0.1 else var_samp(x) end var_x, case when count(*)<2 then 0.1 else var_samp(y) end var_y
  from (select *, row_number() over (partition by page_id, rtype order by y, region_id) - 1 k from conf where rtype<>'unknown') a group by volume_id, rtype, k),
 slc as (select *, case when n<3 then 0.0 else greatest(0.3, least(0.95, 0.95-4.5*(sqrt(var_x)+sqrt(var_y)))) end confidence from sl),
 smp as (select volume_id, least(count(distinct page_id), 50) n_samples from conf group by volume_id)"""


def _six(column: str) -> Column:
    """Six decimals; exact halves, which means of four-place numbers often are, go up."""
    return F.round(F.col(column) + 1e-10, 6).alias(column)


def template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template.slots(_confirmed(spark, sf_dir))
    return found.select("volume_id", "rtype", "k", "n", *(_six(c) for c in ("mean_x", "mean_y", "var_x", "confidence")))


def template_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.samples(_confirmed(spark, sf_dir)).select("volume_id", F.col("n_samples").cast("bigint").alias("n_samples"), "active", F.col("needed").cast("bigint").alias("needed"))


def template_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confirmed(spark, sf_dir)
    found = template.predicted(template.slots(rows), template.samples(rows))
    return found.select("volume_id", "rtype", "k", *(_six(c) for c in ("x", "y", "w", "h", "confidence")), "source")


def template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confirmed(spark, sf_dir)
    found = template.summary(template.slots(rows), template.samples(rows))
    return found.select("volume_id", F.col("n_samples").cast("bigint").alias("n_samples"), F.coalesce(F.element_at("slots", "body"), F.lit(0)).cast("bigint").alias("body_slots"), F.coalesce(F.size("slots"), F.lit(0)).cast("bigint").alias("types"))


def template_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots as they are after they were saved as documents and read again."""
    rows = _confirmed(spark, sf_dir)
    found, _ = template.from_documents(template.documents(template.slots(rows), template.samples(rows)))
    return found.select("volume_id", "rtype", "k", "n", *(_six(c) for c in ("mean_x", "mean_y", "var_x", "confidence")))


def volume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled volumes in parts, as they are written."""
    return compiling.volume_parts(_numbered(spark, sf_dir), F.lit(_MADE).cast("timestamp")).select("volume_id", "pos", "part")


def template_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's regions with its volume's template put in."""
    pages = table(spark, sf_dir, "scan_pages").select("page_id", "spread_id").join(_spreads(spark, sf_dir).select("spread_id", "volume_id"), "spread_id")
    rows = _confirmed(spark, sf_dir)
    due = pages.join(template.predicted(template.slots(rows), template.samples(rows)), "volume_id")
    order = Window.partitionBy("page_id").orderBy("rtype", "k")
    expected = due.withColumn("slot", F.row_number().over(order).cast("bigint"))
    number = Window.partitionBy("page_id").orderBy("region_id")
    found = _regions(spark, sf_dir).withColumn("slot", F.row_number().over(number).cast("bigint"))
    return _rounded(merge.template_blended(found, expected))


# ---------------------------------------------------------------- recognition and text


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.crop_boxes(_placed(spark, sf_dir)).select("region_id", *(F.col(c).cast("bigint").alias(c) for c in ("crop_x1", "crop_y1", "crop_x2", "crop_y2")), "skip", "scale")


def recogniser_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "ocr_results").select("result_id", "region_id", "ocr_language")
    rows = results.join(_regions(spark, sf_dir).select("region_id", "rtype"), "region_id")
    return rows.select("result_id", text.recogniser_options(F.col("rtype"), F.coalesce(F.nullif(F.trim("ocr_language"), F.lit("")), F.lit("eng"))).alias("options"))


def lines_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result cut into words and put together again line by line, with its confidence in whole percent."""
    rows = table(spark, sf_dir, "ocr_results").select(F.col("result_id").alias("region_id"), "text", "confidence").where("text is not null")
    sure = F.coalesce("confidence", F.lit(0.0))
    words = text.words_of_texts(rows).join(rows.select("region_id", F.when(sure > 1, sure).otherwise(sure * 100).alias("conf")), "region_id")
    return text.assembled(words, newlines=True).withColumnRenamed("region_id", "result_id")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.word_count(F.col("text")).alias("n"))


def words_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result cut into words and put together again, with its own confidence on each word."""
    rows = table(spark, sf_dir, "ocr_results").select(F.col("result_id").alias("region_id"), "text", "confidence").where("text is not null")
    words = text.words_of_texts(rows).join(rows.select("region_id", F.coalesce("confidence", F.lit(0.0)).alias("conf")), "region_id")
    return text.assembled(words, newlines=False).select(F.col("region_id").alias("result_id"), "text", "word_count")


def page_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir).join(_latest_results(spark, sf_dir).select("region_id", "text"), "region_id")
    return compiling.pages(rows).withColumn("char_count", F.length("text").cast("bigint"))


#: Fixed, so that the same input gives the same text.
_MADE = "2024-01-01 00:00:00"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled pages of each volume, numbered from 0; a volume's pages are numbered without their text."""
    compiled = compiling.pages(_placed(spark, sf_dir), ("page_id",))
    order = Window.partitionBy("volume_id").orderBy("spread_pos", "side", "page_id")
    pages = table(spark, sf_dir, "scan_pages").select("page_id", "spread_id", "side").join(_spreads(spark, sf_dir).select("spread_id", "volume_id", F.col("pos").alias("spread_pos")), "spread_id")
    return pages.withColumn("pos", F.row_number().over(order) - 1).join(compiled, "page_id", "left").withColumn("label", F.lit(None).cast("string"))


def volume_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiling.volumes(_numbered(spark, sf_dir), F.lit(_MADE).cast("timestamp")).select("volume_id", "text", F.col("n_pages").cast("bigint").alias("n_pages"), "char_count")


def volume_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir).where("side = 'left' or right_path is not null")
    return compiling.project_text(placed.withColumn("volume_pos", F.lit(0)).withColumn("spread_pos", F.col("pos")), "volume_id")


def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each volume as an exported file, or an error where it has no text."""
    placed = _placed(spark, sf_dir).where("side = 'left' or right_path is not null").withColumn("volume_pos", F.lit(0)).withColumn("spread_pos", F.col("pos"))
    names = table(spark, sf_dir, "scan_volumes").select("volume_id", F.col("volume_name").alias("name"))
    return compiling.TextExporter().export(placed, names, "volume_id")


# ---------------------------------------------------------------- edits and views


def _edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits made from events: an event's number is that of the result whose region it edits."""
    results = table(spark, sf_dir, "ocr_results").where("region_id is not null").select("result_id", "region_id", "page_id")
    return table(spark, sf_dir, "events").join(results, F.col("event_id") == F.col("result_id")).select("region_id", "page_id", "event_id", F.col("ts").alias("at"), "event_type", "value")


_LOG_SQL = "log as (select r.region_id, r.page_id, e.event_id, e.ts as tm, e.event_type, e.value from events e join ocr_results r on e.event_id=r.result_id where r.region_id is not null)"
_NEW_TYPES = {"click": "header", "view": "body", "purchase": "pagenum", "signup": "footnote", "error": "table"}


def regions_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in _NEW_TYPES.items() for x in kv))
    log = _edit_log(spark, sf_dir).select("region_id", "at", F.element_at(kinds, F.col("event_type")).alias("new_type"))
    return edits.retyped(_regions(spark, sf_dir), log).select("region_id", "rtype", "confidence")


def regions_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    log = _edit_log(spark, sf_dir).select("region_id", "at", (v / 500 - 0.1).alias("x"), (v / 1000 - 0.05).alias("y"), (v / 2).alias("w_px"), (v / 4).alias("h_px"), F.lit(1000.0).alias("page_w"), F.lit(1500.0).alias("page_h"))
    return edits.moved(_regions(spark, sf_dir), log).select("region_id", *(F.round(c, 9).alias(c) for c in "xywh"))


def regions_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    log = _edit_log(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("region_id"), "page_id", F.lit("body").alias("rtype"),
        F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), (v / 1000).alias("w"), (v / 2000).alias("h"), v.alias("w_px"), (v / 2).alias("h_px"),
    )
    return edits.drawn(_regions(spark, sf_dir), log).select("region_id", "page_id", "rtype", "confidence", "source", F.round("w", 9).alias("w"))


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = _edit_log(spark, sf_dir).where("event_type = 'error'").select("region_id")
    return edits.deleted(_regions(spark, sf_dir), table(spark, sf_dir, "ocr_results").select("result_id", "region_id"), log)


def regions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[0].select("region_id", "rtype")


def results_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[1]


def results_retexted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _edit_log(spark, sf_dir).where("event_type = 'click'").select("region_id", "at", F.concat(F.lit("edit "), F.col("event_id").cast("string")).alias("new_text"))
    return edits.retexted(table(spark, sf_dir, "ocr_results").select("result_id", "region_id", "text", "word_count"), log).select("result_id", "text", "word_count")


def pages_redetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _edit_log(spark, sf_dir).where("event_type = 'purchase' and page_id is not null").select("page_id").distinct()
    found = pages.select(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("region_id"), "page_id", F.lit("body").alias("rtype"))
    return edits.replaced(_regions(spark, sf_dir), found).select("region_id", "page_id", "rtype")


def spreads_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "scan_volumes").where("n_spreads > 2").select("volume_id", (F.col("n_spreads") % 3).alias("from_pos"), (F.col("n_spreads") - 1 - F.col("n_spreads") % 2).alias("to_pos"))
    return edits.reordered(_spreads(spark, sf_dir), moves).select("spread_id", "volume_id", F.col("pos").cast("bigint").alias("pos"))


def results_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without a time of recognition, and over them those that have one."""
    rows = table(spark, sf_dir, "ocr_results").where("region_id is not null").select("region_id", "result_id", "text", "word_count", "recognized_at")
    old, new = rows.where("recognized_at is null").drop("recognized_at"), rows.where("recognized_at is not null").drop("recognized_at")
    return edits.upserted(old, new, ["region_id"])


def region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of regions: type and side, the box and the confidence in whole percent."""
    rows = _placed(spark, sf_dir).where("confidence is not null")
    return rows.select(
        "region_id", F.concat(F.initcap("rtype"), F.lit(" ("), F.col("side"), F.lit(")")).alias("label"), strings.percent_box(*(F.col(c) for c in "xywh")).alias("box"), strings.percent(F.col("confidence")).alias("percent")
    )


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's regions in reading order, as one list."""
    ordered = regions.ordered_arrays(regions.reading_order(_regions(spark, sf_dir), "region_id"), "region_id")
    return ordered.select("page_id", F.array_join(F.transform("segments", lambda x: x.region_id), ",").alias("regions"))


def result_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_results(spark, sf_dir).select("region_id", "result_id", "text")


def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spreads = _spreads(spark, sf_dir)
    return edits.unprocessed(spreads, spreads.where("detection_run"), "spread_id").select("spread_id", "volume_id")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.orphans(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "ocr_regions")).select("result_id", "region_id")


def shown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.shown_types(_regions(spark, sf_dir), ["header", "pagenum"]).select("region_id", "rtype")


def spread_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _spreads(spark, sf_dir).where("split_method <> 'centre' or split_method is null")
    return edits.renumbered(kept).select("volume_id", "spread_id", F.col("pos").cast("bigint").alias("pos"))


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("sure") > 1, F.col("sure") / 100).otherwise(F.col("sure"))
    results = _placed(spark, sf_dir).where("text is not null").select("spread_id", share.alias("confidence"))
    mean = edits.mean_confidence(_spreads(spark, sf_dir), results).withColumn("confidence", F.round("confidence", 6))
    return mean.select("spread_id", "confidence", strings.confidence_band(F.col("confidence")).alias("band"), strings.percent(F.col("confidence")).alias("percent"))


def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return _placed(spark, sf_dir).groupBy("spread_id").agg(n.alias("n"), F.concat(n.cast("string"), F.when(n == 1, " region").otherwise(" regions")).alias("label"))


def ocr_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("y", "region_id")
    rows = _placed(spark, sf_dir).where("text is not null and confidence is not null")
    return rows.select(
        "page_id", "region_id", (F.row_number().over(order) - 1).cast("bigint").alias("n"), F.initcap("rtype").alias("label"), "side", strings.percent(F.col("confidence")).alias("percent"),
        F.when(F.col("confidence") > 0.75, "high").otherwise("low").alias("band"),
    )


def compiled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where(compiling.has_text(F.col("text"))).select("region_id", strings.escaped(F.col("text")).alias("html"))


def centre_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spreads(spark, sf_dir).select("spread_id", F.coalesce(F.col("split_method") == "centre", F.lit(False)).alias("warn"))


def _p3_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_tables(nodes(table(spark, sf_dir, "project_files")))[name]

    query.__name__ = f"p3_{name.lower()}"
    query.__doc__ = f"The flat table of {name}: record, own and parent's label, key, and the scalar fields."
    return query


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = stored(nodes(table(spark, sf_dir, "project_files"), fields=False), "p3-labels")
    found = children_with_parents(labelled)
    return found.withColumn("record_id", found.record_id.cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (
        page_compile, split_route, media_types, spine_detect, safe_names, project_latest, layout_classify, geometry_filter, sharpness_filter, iou_pairs, iou_best, noise_filter,
        demote_headers, column_assign, reading_order, body_union, adjacent_islands, overlap_merge, adjacent_merge, detect_layout, template_slots, template_samples, template_predict,
        template_summary, template_blend, crop_boxes, recogniser_options, word_count, words_rebuilt, volume_compile, volume_export, result_latest, unprocessed, orphans, shown_regions,
        spread_renumber, confidence_bands, region_counts, ocr_panel, compiled_panel, centre_warning, adjacent_paragraphs, adjacent_lines, lines_rebuilt, volume_files, regions_retyped, template_restored, volume_pages,
        regions_moved, regions_drawn, regions_kept, results_kept, results_retexted, pages_redetected, spreads_reordered, results_upserted, region_list, page_order, p3_found,
        *(_p3_table(name) for name in ("volumes", "spreads", "pages", "segments", "ocrResults")),
    )
}

_IOU = "greatest(0.0,least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0.0,least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))"
_FORMAT = f"""case rtype when 'header' then {_STRIP}||chr(10) when 'pagenum' then chr(10)||repeat(' ',50)||{_STRIP} when 'footnote' then chr(10)||'  '||{_STRIP}
 when 'engraving' then chr(10)||'[ENGRAVING — '||case when {_STRIP}='[ENGRAVING]' then 'illustration' else {_STRIP} end||']'||chr(10) else {_STRIP} end"""
_RANK = "case rtype when 'header' then 0 when 'body' then 1 when 'unknown' then 2 when 'engraving' then 3 when 'footnote' then 4 when 'pagenum' then 5 else 99 end"
_COMPILED = f"select page_id, string_agg({_FORMAT}, chr(10) order by {_RANK}, coalesce(y,0.0), region_id) text from TABLE_ where text is not null and {_STRIP}<>'' group by page_id"

_N_WORDS = r"coalesce(len(list_filter(regexp_split_to_array(text,'[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+'), lambda x: x<>'')),0)::bigint"

SQL: dict[str, str] = {
    "p3_found": nested_sql.found(),
    **{f"p3_{name.lower()}": nested_sql.flat(name) for name in ("volumes", "spreads", "pages", "segments", "ocrResults")},
    "split_route": f"with {_SPREADS_SQL} select spread_id, case when image_h>0 then image_w/image_h<1.1 end is_single, case when image_h>0 and image_w/image_h<1.1 then image_w else spine_x end spine_x, case when image_h>0 and image_w/image_h<1.1 then null else right_path end right_path from spr",
    "media_types": rf"with {_SPREADS_SQL}, s as (select spread_id, regexp_extract(original_path,'([^/\\]*)$',1) file_name, lower(regexp_extract(original_path,'\.([A-Za-z0-9]+)$',1)) suffix from spr) select *, case when file_name is null then null when suffix='png' then 'image/png' when suffix in ('tif','tiff') then 'image/tiff' else 'image/jpeg' end media_type, coalesce(suffix in ('jpg','jpeg','png','tif','tiff'),false) accepted from s",
    "spine_detect": """with px as (select vec_id, pos as x, 1.0 + 4.0*cast(v as double) as b from (select vec_id, cast(unnest(range(64)) as int) as pos, unnest(embedding) v from embeddings)),
 sm as (select vec_id,x, sum(b) over (partition by vec_id order by x rows between 10 preceding and 9 following)/20 s from px),
 g as (select vec_id, avg(s) gm, min(case when x>=22 and x<41 then s end) bm from sm group by 1),
 a as (select vec_id,x from (select vec_id,x,row_number() over (partition by vec_id order by round(s,9),x) rn from sm where x>=22 and x<41) z where rn=1)
 select g.vec_id, cast(greatest(9,least(54,case when (gm-bm)/(gm+1e-6)>=0.08 then a.x else 32 end)) as bigint) spine_x, case when (gm-bm)/(gm+1e-6)>=0.08 then 'detected' else 'centre' end method from g join a on g.vec_id=a.vec_id""",
    "safe_names": r"select volume_id, regexp_replace(regexp_replace(volume_name,'\s+','_','g'),'[^a-zA-Z0-9_-]','','g') file_stem from scan_volumes",
    "project_latest": "select file_name, record_id, saved_at from (select *, row_number() over (partition by file_name order by saved_at desc nulls last, record_id desc) rn from project_files where file_name is not null) z where rn=1",
    "layout_classify": f"with {_TYPED_SQL} select page_id, slot, rtype, confidence from typed",
    "geometry_filter": f"with {_LAYOUT_SQL} select page_id, slot from layout where w*h>=0.0005 and w*h<=0.85 and h>=0.010 and not (x<0.12 and w<0.13) and not (x+w>cast(1-0.12 as double) and w<0.13) and not (h>0.60 and w/(h+1e-6)<0.25) and not (x+w/2>0.42 and x+w/2<0.58 and w<0.12)",
    "sharpness_filter": f"with {_LAYOUT_SQL} select l.page_id,l.slot from layout l join (select page_id,count(*) n,median(sharp) m from layout group by page_id) g on l.page_id=g.page_id where l.sharp >= case when n>=3 then greatest(30.0,0.15*m) else 30.0 end",
    "iou_pairs": f"with {_LAYOUT_SQL} select a.page_id,a.slot s1,b.slot s2 from layout a join layout b on a.page_id=b.page_id and a.slot<b.slot where {_IOU}/(a.w*a.h+b.w*b.h-{_IOU}) > 0.3",
    "iou_best": f"with {_LAYOUT_SQL} select page_id,s1,s2,round(iou,9) iou from (select *, row_number() over (partition by page_id,s1 order by round(iou,9) desc, s2) rn from (select a.page_id,a.slot s1,b.slot s2, {_IOU}/(a.w*a.h+b.w*b.h-{_IOU}) iou from layout a join layout b on a.page_id=b.page_id and a.slot<>b.slot where {_IOU}>0) p) r where rn=1",
    "noise_filter": f"with {_LAYOUT_SQL} select page_id, slot, rtype from layout where not (rtype='unknown' and w*h<0.002)",
    "demote_headers": f"with {_LAYOUT_SQL} select page_id,slot,case when rtype='header' and y>=min(case when rtype='body' then y end) over (partition by page_id) then 'body' else rtype end rtype from layout",
    "column_assign": f"with {_LAYOUT_SQL}, g as (select page_id, (min(x+w/2)+max(x+w/2))/2 gutter from layout where rtype='body' group by page_id) select l.page_id, slot, cast(case when rtype<>'body' or gutter is null then 0 when x+w/2<gutter then 1 else 2 end as bigint) col_no from layout l left join g on l.page_id=g.page_id",
    "reading_order": f"with {_REGIONS_SQL}, t as (select *, max(case when rtype='body' and col_no=1 then 1 end) over (partition by page_id)=1 and max(case when rtype='body' and col_no=2 then 1 end) over (partition by page_id)=1 two from reg) select page_id, region_id, cast(row_number() over (partition by page_id order by case rtype when 'header' then 0 when 'body' then 1 when 'pagenum' then 3 else 2 end, case when rtype='body' and coalesce(two,false) then coalesce(col_no,0) else 0 end, y, region_id)-1 as bigint) ord from t",
    "body_union": f"with {_LAYOUT_SQL} select page_id,min(x) x1,min(y) y1,max(x+w) x2,max(y+h) y2,max(0.80::double) confidence from layout where rtype='body' group by page_id",
    "adjacent_islands": f"with {_LAYOUT_SQL} select page_id,rtype,cast(g as bigint) g,min(y) y1,max(y+h) y2,count(*) n from (select *,sum(case when y-pm<=0.10 then 0 else 1 end) over (partition by page_id,rtype order by y,slot rows between unbounded preceding and current row) g from (select *,max(y+h) over (partition by page_id,rtype order by y,slot rows between unbounded preceding and 1 preceding) pm from layout) a) b group by page_id,rtype,g",
    "template_slots": f"with {_CONFIRMED_SQL} select volume_id, rtype, k, n, round(mean_x+1e-10,6) mean_x, round(mean_y+1e-10,6) mean_y, round(var_x+1e-10,6) var_x, round(confidence+1e-10,6) confidence from slc",
    "template_samples": f"with {_CONFIRMED_SQL} select volume_id, n_samples, n_samples>=3 active, greatest(0, 3-n_samples) needed from smp",
    "template_predict": f"with {_CONFIRMED_SQL} select c.volume_id, rtype, k, round(mean_x+1e-10,6) x, round(mean_y+1e-10,6) y, round(mean_w+1e-10,6) w, round(mean_h+1e-10,6) h, round(confidence+1e-10,6) confidence, 'template' source from slc c join smp s on c.volume_id=s.volume_id where n>=3 and n_samples>=3",
    "template_summary": f"with {_CONFIRMED_SQL} select s.volume_id, n_samples, coalesce(sum(case when rtype='body' then 1 else 0 end),0)::bigint body_slots, count(distinct rtype) types from smp s left join slc c on s.volume_id=c.volume_id group by s.volume_id, n_samples",
    "crop_boxes": f"""with {_PLACED_SQL}, c as (select *, case when rtype in ('header','pagenum') then 8 else 4 end m, case when rtype in ('header','pagenum') then 10 else 8 end v from placed),
 p as (select *, greatest(0, trunc(x*image_w)::bigint-m) x1, greatest(0, trunc(y*image_h)::bigint-m) y1 from c), q as (select *, least(image_w-x1, trunc(w*image_w)::bigint+2*m) cw, least(image_h-y1, trunc(h*image_h)::bigint+v) ch from p)
 select region_id, x1 crop_x1, y1 crop_y1, x1+cw crop_x2, y1+ch crop_y2, cw<20 or ch<10 skip, case when rtype in ('header','pagenum') then 3.0::double when ch<200 then 2.0::double else 1.5::double end scale from q""",
    "recogniser_options": f"with {_REGIONS_SQL} select result_id, (case when rtype in ('body','header','pagenum','footnote') then '--oem 1 --psm 6 -l ' else '--oem 1 --psm 3 -l ' end)||lang||(case when rtype='pagenum' and lang in ('eng','fra','deu','spa','ita','por','lat') then ' -c tessedit_char_whitelist=0123456789IVXivxLCDlcd.,- ' else '' end) options from (select result_id, region_id, coalesce(nullif(trim(ocr_language),''),'eng') lang from ocr_results) o join reg using (region_id)",
    "word_count": f"select doc_id, {_N_WORDS} n from documents",
    "words_rebuilt": rf"select result_id, text, {_N_WORDS} word_count from (select result_id, array_to_string(w,' ') as text from (select result_id, list_filter(regexp_split_to_array(text,'[ \t\r\n]+'), lambda x: x<>'') w from ocr_results where text is not null) z where len(w)>0) y",
    "lines_rebuilt": rf"""with l as (select result_id, confidence, generate_subscripts(string_split(text,chr(10)),1) i, unnest(string_split(text,chr(10))) t from ocr_results where text is not null),
 p as (select *, trim(t,' '||chr(9)||chr(13)||chr(10))='' blank, sum(case when trim(t,' '||chr(9)||chr(13)||chr(10))='' then 1 else 0 end) over (partition by result_id order by i) par from l),
 k as (select result_id, confidence, i, par, array_to_string(list_filter(regexp_split_to_array(t,'[ \t\r]+'), lambda x: x<>''),' ') t from p where not blank),
 j as (select *, case when par<>lag(par) over (partition by result_id order by i) then chr(10)||t else t end u from k),
 a as (select result_id, any_value(confidence) c, string_agg(u, chr(10) order by i) as text from j group by result_id)
 select result_id, text, round(trunc(case when coalesce(c,0.0)>1 then c else coalesce(c,0.0)*100 end)/100,3) confidence, {_N_WORDS} word_count from a""",
    "overlap_merge": f"with recursive {_TYPED_SQL}, {merge_sql.overlaps('typed', 'apart')} select {_ROUNDED} from apart",
    "adjacent_merge": f"with recursive {_TYPED_SQL}, {merge_sql.adjacent('typed', 'body_', 0.10, "rtype='body'")}, {merge_sql.collapsed('body_', 'one')}, {merge_sql.adjacent('typed', 'rest', 0.06, "rtype<>'body'")} select {_ROUNDED} from (select * from one union all by name select * from rest) z",
    "adjacent_paragraphs": f"with recursive {_TYPED_SQL}, {merge_sql.adjacent('typed', 'body_', 0.025, "rtype='body'")}, {merge_sql.adjacent('typed', 'rest', 0.06, "rtype<>'body'")} select {_ROUNDED} from (select * from body_ union all by name select * from rest) z",
    "adjacent_lines": f"with recursive {_TYPED_SQL}, {merge_sql.adjacent('typed', 'rest', 0.06, "rtype<>'body'")} select {_ROUNDED} from (select * from typed where rtype='body' union all by name select * from rest) z",
    "detect_layout": _DETECT_SQL,
    "template_blend": f"with {_CONFIRMED_SQL}, {_BLEND_SQL}, {merge_sql.blended('fnd', 'due', 'bl')} select {_ROUNDED} from bl",
    "regions_retyped": f"with {_REGIONS_SQL}, {_LOG_SQL}, n as (select region_id, tm, case event_type when 'click' then 'header' when 'view' then 'body' when 'purchase' then 'pagenum' when 'signup' then 'footnote' end t from log), m as (select region_id, t from n where t is not null qualify row_number() over (partition by region_id order by tm desc, t desc)=1) select region_id, coalesce(t, rtype) rtype, case when t is null then confidence else 1.0 end confidence from reg left join m using (region_id)",
    "regions_moved": f"with {_REGIONS_SQL}, {_LOG_SQL}, m as (select region_id, value v from log qualify row_number() over (partition by region_id order by tm desc, value desc)=1) select region_id, round(case when v is null then x else greatest(0.0::double, v/500-0.1::double) end,9) x, round(case when v is null then y else greatest(0.0::double, v/1000-0.05::double) end,9) y, round(case when v is null then w else greatest(20.0::double, v/2)/1000 end,9) w, round(case when v is null then h else greatest(16.0::double, v/4)/1500 end,9) h from reg left join m using (region_id)",
    "regions_drawn": f"with {_REGIONS_SQL}, {_LOG_SQL} select region_id, page_id, rtype, confidence, source, round(w,9) w from reg union all select 'e'||event_id, page_id, 'body', 1.0, 'manual', round(value/1000,9) from log where value>=10 and value/2>=10",
    "regions_kept": f"with {_REGIONS_SQL}, {_LOG_SQL} select region_id, rtype from reg where region_id not in (select region_id from log where event_type='error')",
    "results_kept": f"with {_LOG_SQL} select result_id, region_id from ocr_results r where not exists (select 1 from log l where l.event_type='error' and l.region_id=r.region_id)",
    "results_retexted": f"with {_LOG_SQL}, m as (select region_id, 'edit '||event_id nt from log where event_type='click' qualify row_number() over (partition by region_id order by tm desc, 'edit '||event_id desc)=1) select result_id, coalesce(nt, text) as text, word_count from ocr_results left join m using (region_id)",
    "pages_redetected": f"with {_REGIONS_SQL}, {_LOG_SQL}, n as (select distinct page_id from log where event_type='purchase' and page_id is not null) select region_id, page_id, rtype from reg where page_id is null or page_id not in (select page_id from n) union all select 'n'||page_id, page_id, 'body' from n",
    "spreads_reordered": f"with {_SPREADS_SQL}, mv as (select volume_id, n_spreads%3 a, n_spreads-1-n_spreads%2 b from scan_volumes where n_spreads>2) select spread_id, volume_id, cast(case when a is null then pos when pos=a then b when pos>a and pos<=b then pos-1 when pos<a and pos>=b then pos+1 else pos end as bigint) pos from spr left join mv using (volume_id)",
    "results_upserted": "select region_id, result_id, text, word_count from ocr_results where region_id is not null qualify row_number() over (partition by region_id order by recognized_at is not null desc, result_id desc)=1",
    "region_list": f"with {_PLACED_SQL} select region_id, upper(rtype[1])||rtype[2:]||' ('||side||')' label, cast(floor(x*100+0.5) as bigint)||'%,'||cast(floor(y*100+0.5) as bigint)||'% '||cast(floor(w*100+0.5) as bigint)||'%×'||cast(floor(h*100+0.5) as bigint)||'%' box, cast(floor(confidence*100+0.5) as bigint) percent from placed where confidence is not null",
    "page_order": f"with {_REGIONS_SQL}, t as (select *, coalesce(max(case when rtype='body' and col_no=1 then 1 end) over (partition by page_id)=1 and max(case when rtype='body' and col_no=2 then 1 end) over (partition by page_id)=1,false) two from reg) select page_id, string_agg(region_id, ',' order by case rtype when 'header' then 0 when 'body' then 1 when 'pagenum' then 3 else 2 end, case when rtype='body' and two then coalesce(col_no,0) else 0 end, y, region_id) regions from t group by page_id",
    "volume_files": rf"with {_PLACED_SQL}, t as (select volume_id, string_agg({_STRIP}, chr(10)||chr(10) order by pos, side, case rtype when 'header' then 0 when 'body' then 1 else 2 end, coalesce(y,0.0), region_id) body from placed where rtype in ('header','body','footnote') and text is not null and {_STRIP}<>'' and (side='left' or right_path is not null) group by volume_id) select volume_id, regexp_replace(regexp_replace(coalesce(volume_name,''),'\s+','_','g'),'[^a-zA-Z0-9_-]','','g')||'.txt' file_name, body content, case when body is null then 'no text to export' end error from scan_volumes left join t using (volume_id)",
    "page_compile": f"with {_REGIONS_SQL}, {_LATEST_SQL}, j as (select r.*, t.text from reg r join res t using (region_id)) select page_id, text, length(text) char_count from ({_COMPILED.replace('TABLE_', 'j')}) z",
    "volume_compile": f"""with {_PLACED_SQL}, c as ({_COMPILED.replace('TABLE_', 'placed')}), pg as (select p.page_id, s.volume_id, row_number() over (partition by s.volume_id order by s.pos, p.side, p.page_id) pos from scan_pages p join spr s on p.spread_id=s.spread_id),
 v as (select volume_id, string_agg('[Page '||pos||']'||chr(10)||case when text is null then '' else chr(10)||text end||chr(10)||chr(10)||repeat('─',60)||chr(10), chr(10) order by pos) body, count(*) n_pages from pg left join c on pg.page_id=c.page_id group by volume_id)
 select volume_id, 'Compiled Output'||chr(10)||'Generated: 2024-01-01 00:00'||chr(10)||'Pages: '||n_pages||chr(10)||repeat('═',60)||chr(10)||chr(10)||body text, n_pages, length('Compiled Output'||chr(10)||'Generated: 2024-01-01 00:00'||chr(10)||'Pages: '||n_pages||chr(10)||repeat('═',60)||chr(10)||chr(10)||body) char_count from v""",
    "template_restored": f"with {_CONFIRMED_SQL} select volume_id, rtype, k, n, round(mean_x+1e-10,6) mean_x, round(mean_y+1e-10,6) mean_y, round(var_x+1e-10,6) var_x, round(confidence+1e-10,6) confidence from slc",
    "volume_pages": f"""with {_PLACED_SQL}, c as ({_COMPILED.replace('TABLE_', 'placed')}), pg as (select p.page_id, s.volume_id, row_number() over (partition by s.volume_id order by s.pos, p.side, p.page_id) pos from scan_pages p join spr s on p.spread_id=s.spread_id)
 select volume_id, cast(pos-1 as bigint) pos, chr(10)||'[Page '||pos||']'||chr(10)||case when text is null then '' else chr(10)||text end||chr(10)||chr(10)||repeat('─',60)||chr(10) part from pg left join c on pg.page_id=c.page_id
 union all select volume_id, -1, 'Compiled Output'||chr(10)||'Generated: 2024-01-01 00:00'||chr(10)||'Pages: '||count(*)||chr(10)||repeat('═',60)||chr(10) from pg group by volume_id""",
    "volume_export": f"with {_PLACED_SQL} select volume_id, string_agg({_STRIP}, chr(10)||chr(10) order by pos, side, case rtype when 'header' then 0 when 'body' then 1 else 2 end, coalesce(y,0.0), region_id) text from placed where rtype in ('header','body','footnote') and text is not null and {_STRIP}<>'' and (side='left' or right_path is not null) group by volume_id",
    "result_latest": f"with {_LATEST_SQL} select region_id, result_id, text from res",
    "unprocessed": f"with {_SPREADS_SQL} select spread_id, volume_id from spr s where not exists (select 1 from spr d where d.detection_run and d.spread_id=s.spread_id)",
    "orphans": "select result_id, region_id from ocr_results r where not exists (select 1 from ocr_regions g where g.region_id=r.region_id)",
    "shown_regions": f"with {_REGIONS_SQL} select region_id, rtype from reg where rtype not in ('header','pagenum')",
    "spread_renumber": f"with {_SPREADS_SQL} select volume_id, spread_id, cast(row_number() over (partition by volume_id order by pos, spread_id)-1 as bigint) pos from spr where split_method<>'centre' or split_method is null",
    "confidence_bands": f"with {_PLACED_SQL}, m as (select spread_id, avg(coalesce(case when sure>1 then sure/100 else sure end,0)) m from placed where text is not null group by 1), c as (select s.spread_id, round(coalesce(m,0),6) confidence from (select distinct spread_id from spr) s left join m on s.spread_id=m.spread_id) select spread_id, confidence, case when confidence>0.8 then 'high' when confidence>0.6 then 'mid' else 'low' end band, cast(floor(confidence*100+0.5) as bigint) percent from c",
    "region_counts": f"with {_PLACED_SQL} select spread_id, count(*) n, count(*)||case when count(*)=1 then ' region' else ' regions' end label from placed group by spread_id",
    "ocr_panel": f"with {_PLACED_SQL} select page_id, region_id, cast(row_number() over (partition by page_id order by y, region_id)-1 as bigint) n, upper(rtype[1])||rtype[2:] label, side, cast(floor(confidence*100+0.5) as bigint) percent, case when confidence>0.75 then 'high' else 'low' end band from placed where text is not null and confidence is not null",
    "compiled_panel": f"with {_PLACED_SQL} select region_id, replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;') html from placed where text is not null and {_STRIP}<>''",
    "centre_warning": f"with {_SPREADS_SQL} select spread_id, coalesce(split_method='centre',false) warn from spr",
}
