"""Queries of the text operators, run over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm.bpe import encode
from vellumetry.llm.canonical import same_look_pairs
from vellumetry.llm.language import identify, labels_of, train
from vellumetry.llm.leaks import leaks
from vellumetry.llm.oracles import SQL as SQL
from vellumetry.llm.repeated_lines import repeated_lines, repeated_sequences, without_lines
from vellumetry.llm.repair import damage, repaired, titles
from vellumetry.llm.sentences import split_sentences
from vellumetry.llm.subjects import assign_subjects
from vellumetry.sources.tables import body_results, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(body_results(spark, sf_dir, "text", confirmed=True))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = body_results(spark, sf_dir, "text", "site_id", "volume_id")
    return repeated_lines(texts, table(spark, sf_dir, "scan_volumes"))


def p2_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of repeated lines, each with its support, in every body result."""
    texts = body_results(spark, sf_dir, "text", "site_id", "volume_id")
    return repeated_sequences(texts, table(spark, sf_dir, "scan_volumes"))


def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body result with its languages: all stretches, with confidence and the label it came with."""
    texts = body_results(spark, sf_dir, "text", "site_id", "volume_id", "ocr_language")
    # a site's notices are in its own language, whatever the text's
    clean = without_lines(texts, repeated_lines(texts, table(spark, sf_dir, "scan_volumes")))
    return identify(clean, train(table(spark, sf_dir, "ocr_results")), "result_id", "text", "ocr_language")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p4_stretches(spark, sf_dir).where("lang is not null")
    named = labels_of(F.col("ocr_language"))
    case = (F.col("n_segs") > 1) | (F.size(named) == 0) | ~F.array_contains(named, F.col("lang"))
    return found.where(case).select("result_id", "seg_no", "lang")


def _pages_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body results with whether their page is confirmed and their volume's titles. Keys are joined first, so texts are shuffled once."""
    pages = table(spark, sf_dir, "scan_pages").select("page_id", "confirmed")
    heads = titles(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "ocr_regions"), table(spark, sf_dir, "scan_volumes"))
    keys = body_results(spark, sf_dir, "page_id", "volume_id").join(pages.hint("shuffle_hash"), "page_id").join(heads.hint("shuffle_hash"), "volume_id", "left")
    texts = table(spark, sf_dir, "ocr_results").select("result_id", "text", "confidence")
    return texts.join(keys.select("result_id", "confirmed", "title").hint("shuffle_hash"), "result_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage(_pages_with_titles(spark, sf_dir)).select("result_id", "line_no", "kind").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_pages_with_titles(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(body_results(spark, sf_dir, "text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half an item or more, in pieces and in any order, too; with what they hold."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_covered=0.5)
    return found.select("doc_id", "item_id", "longest", F.round("covered", 6).alias("covered"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, "text", "lang", "doc_id")
    found = assign_subjects(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"), model)
    return found.select("doc_id", "subject").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_sequences": p2_sequences, "p4_found": p4_found, "p4_stretches": p4_stretches, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_covered": p8_covered, "p9_found": p9_found}
