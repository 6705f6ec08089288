"""From recognised words to text, and what is asked of the recogniser. Word tables: region_id, idx, word, conf, block, par, line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.functions.strings import word_count
from vellumetry.operators.model import LATIN_MODELS

#: White space that is trimmed off words; other spaces and joiners stay in them (fixed value).
ASCII_SPACE = " \t\r\n"
#: What limits a page number's signs (fixed value).
PAGE_NUMBER_SIGNS = " -c tessedit_char_whitelist=0123456789IVXivxLCDlcd.,- "


def crop_boxes(regions: DataFrame) -> DataFrame:
    """Adds crop_x1, crop_y1, crop_x2, crop_y2, scale and skip. regions: x, y, w, h as shares, rtype, image_w, image_h.

    Headers and page numbers are cropped more widely. A crop is as large as its box and the margins, whether
    its corner had to move into the image or not; those under 20 x 10 pixels are skipped.
    """
    small = F.col("rtype").isin("header", "pagenum")
    side = F.when(small, 8).otherwise(4)
    below = F.when(small, 2).otherwise(4)
    pixels = lambda share, size: (F.col(share) * F.col(size)).cast("int")
    x1, y1 = F.greatest(F.lit(0), pixels("x", "image_w") - side), F.greatest(F.lit(0), pixels("y", "image_h") - side)
    width, height = F.least(F.col("image_w") - x1, pixels("w", "image_w") + 2 * side), F.least(F.col("image_h") - y1, pixels("h", "image_h") + side + below)
    return (
        regions.withColumn("crop_x1", x1)
        .withColumn("crop_y1", y1)
        .withColumn("crop_x2", x1 + width)
        .withColumn("crop_y2", y1 + height)
        .withColumn("skip", (width < 20) | (height < 10))
        .withColumn("scale", F.when(small, 3.0).when(height < 200, 2.0).otherwise(1.5))
    )


def recogniser_options(rtype: Column, language: Column) -> Column:
    """The recogniser's options for a region: layout mode and language, and for page numbers in one Latin language the signs they may have."""
    known = F.when(rtype.isin("body", "header", "pagenum", "footnote"), "--oem 1 --psm 6 -l ").otherwise("--oem 1 --psm 3 -l ")
    signs = F.when((rtype == "pagenum") & language.isin(*LATIN_MODELS), PAGE_NUMBER_SIGNS).otherwise("")
    return F.concat(known, language, signs)


def usable_words(words: DataFrame) -> DataFrame:
    """Words with a confidence of 0 or more that aren't blank, trimmed of ASCII white space only."""
    return words.withColumn("word", F.trim("word", F.lit(ASCII_SPACE))).where((F.col("conf") >= 0) & (F.col("word") != ""))


def assembled(words: DataFrame, newlines: bool = False) -> DataFrame:
    """(region_id, text, confidence, word_count) of each region with usable words.

    Words stand in lines in the order the lines first appear in. Without newlines all are joined by a
    space; with them each line is a line, and a blank line stands where block or paragraph changes.
    Confidence is the mean of whole percentages; word_count counts what white space of any kind parts.
    """
    good = usable_words(words)
    lines = good.groupBy("region_id", "block", "par", "line").agg(
        F.min("idx").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s.word), " ").alias("text"),
        F.sum(F.col("conf").cast("int")).alias("conf"),
        F.count("*").alias("n"),
    )
    whole = lines.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("at", "text", "block", "par"))).alias("l"), F.round(F.sum("conf") / F.sum("n") / 100, 3).alias("confidence"))
    spaced = F.transform(
        "l",
        lambda s, i: F.when((i > 0) & ~(F.col("l")[i - 1].block.eqNullSafe(s.block) & F.col("l")[i - 1].par.eqNullSafe(s.par)), F.concat(F.lit("\n"), s.text)).otherwise(s.text),
    )
    text = F.array_join(spaced, "\n") if newlines else F.array_join(F.transform("l", lambda s: s.text), " ")
    return whole.select("region_id", text.alias("text"), "confidence").withColumn("word_count", word_count(F.col("text")))


def words_of_texts(texts: DataFrame, id_col: str = "region_id", text_col: str = "text") -> DataFrame:
    """A word table made from laid-out texts: lines at line ends, paragraphs at blank lines. Null texts give none."""
    lines = texts.select(F.col(id_col).alias("region_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    order = Window.partitionBy("region_id").orderBy("line")
    blank = F.trim("t", F.lit(ASCII_SPACE)) == ""
    numbered = lines.withColumn("par", F.sum(F.when(blank, 1).otherwise(0)).over(order)).where(~blank)
    words = numbered.select("region_id", "line", "par", F.posexplode(F.filter(F.split("t", "[ \t\r]+"), lambda w: w != "")).alias("i", "word"))
    return words.select("region_id", (F.col("line") * 100000 + F.col("i")).alias("idx"), "word", F.lit(0).alias("block"), "par", "line")
