"""The corpus pipeline, part of subpackage llm: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet in the shared folder and read again as the next one's docs.
All but the last return the columns of ``documents``; where a text changes, ``n_chars``
follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontaminate, jaccard, lines, quality
from threadloom.llm._store import stored
from threadloom.llm.queries import pattern, tokenizer
from threadloom.session import ship
from threadloom.sources.tables import table


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; so do documents that lose all their words."""
    ship(spark)
    return _recounted(lines.deduplicated(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest doc_id stays."""
    ship(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, hit words are cut."""
    return _recounted(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, little-endian 32-bit integers, with the digest of what they decode to."""
    ship(spark)
    path, split = tokenizer("byte_bpe_multi_50k.tiktoken"), pattern()
    return bpe.round_trip(docs, "doc_id", "lang", "source", path=path, pattern=split)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: EM, components and BPE are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
