"""The subpackage's queries: each operator over its whole table, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontam, html_extract, langid, licenses, ngram_join, oracles, packing, phrase_dedup, quality, suffix_dedup,
               token_alignment, token_counts, vector_codes)
from .common import Scratch
from .token_files import read_tokens, write_tokens

QUERIES: dict = {}
ORACLE: dict[str, str] = oracles.ORACLE


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op3_quality_rules(spark, sf_dir):
    q = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{c}" for c in (*quality.BASE, "base_failed", "kept")])


@query
def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark, sf_dir):
    d = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"),
                    F.sha2("dedup.kept", 256).alias("kept_sha256"))


@query
def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("places")


@query
def op7_decontaminate(spark, sf_dir):
    d = decontam.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    n_hit = decontam.n_hit(c)
    return d.select("doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"),
                    F.size(c["items"]).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", F.array_sort(c["items"])).cast("binary"), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"))


@query
def op8_token_files(spark, sf_dir):
    path = f"{Scratch(spark, 'tokens').base}/files"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op11_token_alignment(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


@query
def op12_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op13_phrase_dedup(spark, sf_dir):
    d = phrase_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("phrases.spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return d.select("doc_id", "phrases.n_words", gone.alias("n_removed"), F.sha2("phrases.kept", 256).alias("kept_sha256"))
