"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, decontaminate, html_text, jaccard, licenses, lines, oracles, quality, token_files, urls, warc
from ._store import new_folder

TOKENIZERS = os.environ.get("THREADLOOM_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the folder is a parameter of the environment."""
    import public_tokenizers

    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"), "doc_id")
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    doubt = F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    files = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"))
    return token_files.read(files, folder)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", path=tokenizer("byte_bpe_multi_50k.tiktoken"), pattern=pattern())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.with_kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"), "page_id", "url")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), "page_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    files = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(files, folder)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_decontamination, op4_token_files, op5_byte_bpe, op6_line_dedup, op7_html_text, op8_jaccard_join, op9_url_filter, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
