"""From raw documents to packed training sequences: five stages, each written and read again before the next.

All stages but the last return the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.lang_id import identify, train
from lineweave.llm.line_dedup import drop_lines, later_copies
from lineweave.llm.mixing import mix
from lineweave.llm.ngram_join import ngram_classes
from lineweave.llm.packing import pack_documents
from lineweave.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language reaches this posterior.
LANGUAGE_SCORE = 0.5

#: Language models, n-gram similarity and token ids are not SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a recognised language; the model learns from the rows that name one."""
    found = identify(docs.select(*COLUMNS), train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; n_chars counts what is left. Documents stay, even when emptied."""
    docs = docs.select(*COLUMNS)
    return drop_lines(docs, later_copies(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least doc_id. Emptied ones are one group."""
    docs = docs.select(*COLUMNS)
    classes = ngram_classes(docs)
    stay = classes.where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_th"))
    return docs.withColumn("_h", F.xxhash64("text")).join(stay, same, "left_semi").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into mix order: the files and the rows in them follow the schedule. All documents stay."""
    docs = docs.select(*COLUMNS)
    places = mix(docs).groupBy("doc_id", "th").agg(F.min("position").alias("_place"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_place")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th"))
    return docs.withColumn("_h", F.xxhash64("text")).join(places, same).orderBy("_place").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents; sequences, and pieces of equal length, are numbered in the order of the files, which is the mix."""
    try:
        ordered = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", "part-(\\d+)", 1).alias("_part"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files
        return pack_documents(docs)
    return pack_documents(ordered.withColumn("_part", F.expr("coalesce(try_cast(_part as long), 0)")), ["_part", "_row"], keep_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
