"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents`` (and any more that the table has).

Cases, by stage: a null text is rejected by the quality rules; rows are told apart by their place in the
table, so repeated and null ids are kept or dropped row by row; a text that the third stage
empties stays, empty (its byte runs are cut at whole characters); an empty table gives an empty
result of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentflow.llm import decontam, ngram_join, packing, quality, suffix_dedup
from incidentflow.llm.common import ROW, Scratch, with_row_key

ORACLE_SQL = None      # word-piece ids and suffix spans are not SQL-expressible; tests/llm has the brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the method's rules."""
    return quality.quality_rules(docs, into="_quality").filter("_quality.kept").drop("_quality")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    found = ngram_join.similar_components(docs)
    first = found.select("first").distinct().withColumnRenamed("first", ROW)
    return with_row_key(docs).join(first, ROW, "left_semi").drop(ROW)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages."""
    out = suffix_dedup.suffix_dedup(docs, into="_dedup", as_text=True)
    return out.withColumn("text", F.col("_dedup.kept")).drop("_dedup")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    out = decontam.find_benchmark(docs, bench, into="_leak")
    return out.filter(F.size("_leak.spans") == 0).drop("_leak")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                     "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("ngram_jaccard", near_duplicate_stage),
          ("suffix_dedup", repeated_text_stage), ("decontamination", decontamination_stage),
          ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
