"""Saved project documents, templates and word tables on storage."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.functions.strings import basename, safe_name

#: A saved document in its own shape; read with an explicit schema, as inference would make a column of every region id.
SCHEMA = """id string, name string, baseDir string, outputDir string,
volumes array<struct<id:string, name:string, spreads:array<struct<id:string, originalPath:string, leftPath:string, rightPath:string,
spineX:int, splitMethod:string, imageW:int, imageH:int, detectionRun:boolean, pages:map<string,struct<
segments:array<struct<id:string, type:string, x:double, y:double, w:double, h:double, confidence:double, source:string, `column`:int, `order`:int>>,
ocrResults:map<string,struct<text:string, confidence:double, word_count:int, skipped:boolean, error:string>>, confirmed:boolean>>>>>>"""


def new_projects(projects: DataFrame, name: str, made_at: str) -> DataFrame:
    """projects with one more, empty: its id is made from its name and the time it is made at, so it doesn't depend on the projects there are."""
    made = projects.sparkSession.createDataFrame([(hashlib.sha256(f"{name}:{made_at}".encode()).hexdigest()[:8], name)], "id string, name string")
    return projects.unionByName(made, allowMissingColumns=True)


def output_dir(spark: SparkSession, base: str, name: str = "output") -> str:
    """A folder for results under base, made if it isn't there; any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return path.toString()


def load_projects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Documents with active_volume, the last one, or null without volumes. Documents of other shapes go through operators.nested."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
    return docs.withColumn("active_volume", F.when(F.size("volumes") > 0, F.element_at("volumes", -1)))


def save_projects(projects: DataFrame, path: str) -> None:
    """One folder for each project name (blank: untitled) with JSON in it; letters of all scripts are kept as they are."""
    name = F.coalesce(F.nullif(safe_name(F.trim("name")), F.lit("")), F.lit("untitled"))
    columns = [c for c in projects.columns if c != "active_volume"]
    projects.select(name.alias("project"), F.to_json(F.struct(*columns)).alias("value")).write.partitionBy("project").mode("append").text(path)


def list_projects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(name, path, modified), newest first, without reading any content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", "").alias("name"), "path", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """(language) of the recogniser's model files, without those that only find layout."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.traineddata").load(path).select("path")
    return files.select(F.regexp_replace(basename(F.col("path")), r"\.traineddata$", "").alias("language")).where(~F.col("language").isin("osd", "equ")).distinct()


def word_table(results: DataFrame) -> DataFrame:
    """The recogniser's column-wise answers (region_id, text[], conf[], block_num[], par_num[], line_num[]) as one row for each word."""
    zipped = F.posexplode(F.arrays_zip("text", "conf", "block_num", "par_num", "line_num")).alias("idx", "w")
    rows = results.select("region_id", zipped)
    return rows.select("region_id", "idx", F.col("w.text").alias("word"), F.col("w.conf").cast("double").alias("conf"), F.col("w.block_num").alias("block"), F.col("w.par_num").alias("par"), F.col("w.line_num").alias("line"))


def save_templates(slots: DataFrame, path: str) -> None:
    """Slots with their variances, so that nothing is lost when they are read again; at least one slot must be there."""
    if slots.isEmpty():
        raise ValueError("no template to save")
    slots.write.mode("overwrite").partitionBy("volume_id").parquet(path)


def load_templates(spark: SparkSession, path: str, volume_id: str | None = None) -> DataFrame:
    """The saved slots of all volumes, or of one, of which only its own folder is read; a volume that isn't there has none."""
    rows = spark.read.parquet(path).withColumn("volume_id", F.col("volume_id").cast("string"))
    return rows if volume_id is None else rows.where(F.col("volume_id") == volume_id)


def write_texts(texts: DataFrame, path: str, by: str) -> DataFrame:
    """Writes (by, text) as text files, a folder for each key, and gives (by, char_count)."""
    texts.select(by, F.col("text").alias("value")).write.partitionBy(by).mode("overwrite").text(path)
    return texts.select(by, F.length("text").cast("bigint").alias("char_count"))


def write_parts(parts: DataFrame, path: str, by: str) -> DataFrame:
    """Writes (by, pos, part) as text files, in a folder for each key, in order of pos within and across its files; gives (by, char_count).

    Rows are ranged by key and place, so a long volume is written by several tasks, each a stretch of it.
    """
    ranged = parts.repartitionByRange(by, "pos").sortWithinPartitions(by, "pos")
    # a part ends with a line end, and so does a row of a text file
    ranged.select(by, F.regexp_replace("part", r"\n$", "").alias("value")).write.partitionBy(by).mode("overwrite").text(path)
    return parts.groupBy(by).agg(F.sum(F.length("part")).cast("bigint").alias("char_count"))
