"""Inventory analytics over classified members (see ``functions.classify.classified``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def files(members: DataFrame) -> DataFrame:
    return members.where(~F.col("is_directory"))


def by_group(rows: DataFrame, *keys: str, **sums: str) -> DataFrame:
    """Count, and sums by name, of each group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), *(F.sum(c).alias(name) for name, c in sums.items()))


def by_extension(members: DataFrame) -> DataFrame:
    return by_group(files(members), "extension", uncompressed_bytes="uncompressed_bytes", compressed_bytes="compressed_bytes")


def duplicate_groups(rows: DataFrame, signature: list[str], ident: str, order: str, size: str | None = None) -> DataFrame:
    """Groups of more than one row with one signature (and a size above 0): count, and the first id in order. No group is gathered."""
    counted = rows.where(F.col(size) > 0) if size else rows
    return counted.groupBy(*signature).agg(F.count("*").alias("count"), F.min(F.struct(F.col(order).alias("at"), F.col(ident).alias("id")))["id"].alias("first_id")).where("count > 1")


def group_members(rows: DataFrame, groups: DataFrame, signature: list[str], ident: str) -> DataFrame:
    """(first_id, id): a row for each member of the groups."""
    return rows.join(groups.select(*signature, "first_id"), signature).select("first_id", F.col(ident).alias("id"))


def duplicate_candidates(members: DataFrame) -> DataFrame:
    return duplicate_groups(files(members), ["uncompressed_bytes", "crc32"], "entry_id", "zip_directory_index", "uncompressed_bytes")


def duplicate_names(members: DataFrame) -> DataFrame:
    return duplicate_groups(members, ["path_sha256"], "entry_id", "zip_directory_index")


def duplicate_savings(groups: DataFrame, size: str = "uncompressed_bytes") -> DataFrame:
    """One row: groups, members covered, and bytes beyond one of each."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count("*").alias("groups"), whole(F.col("count")).alias("members"), whole((F.col("count") - 1) * F.col(size)).alias("extra_bytes"))


def _sum_where(on: Column, what: Column) -> Column:
    return F.coalesce(F.sum(F.when(on, what)), F.lit(0)).cast("long")


def totals(members: DataFrame) -> DataFrame:
    """One row: counts and sizes, of all and by flag, and the range of packaging times."""
    size, one = F.col("uncompressed_bytes"), F.lit(1)
    return members.agg(
        F.count("*").alias("member_count"),
        _sum_where(~F.col("is_directory"), one).alias("file_count"),
        _sum_where(F.lit(True), size).alias("uncompressed_total_bytes"),
        _sum_where(F.lit(True), F.col("compressed_bytes")).alias("compressed_members_total_bytes"),
        _sum_where(F.col("is_media"), one).alias("extension_only_media_count"),
        _sum_where(F.col("is_media"), size).alias("extension_only_media_uncompressed_bytes"),
        _sum_where(F.col("is_other_attachment_candidate"), one).alias("extension_only_other_attachment_candidate_count"),
        _sum_where(F.col("is_other_attachment_candidate"), size).alias("extension_only_other_attachment_candidate_bytes"),
        F.min("zip_timestamp").alias("zip_date_min"),
        F.max("zip_timestamp").alias("zip_date_max"),
    )


def largest(rows: DataFrame, size: str, order: str, n: int = 15) -> DataFrame:
    """The n largest rows; of equal sizes the first."""
    return rows.orderBy(F.desc(size), F.asc(order)).limit(n)


def header_census(members: DataFrame) -> DataFrame:
    known = members.where(F.col("header_format").isNotNull() & (F.col("header_format") != "encrypted-not-read"))
    return known.groupBy("header_format").agg(F.count("*").alias("count"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"), F.sum(F.octet_length("prefix")).alias("header_bytes_read"))


def families(census: DataFrame) -> DataFrame:
    """Formats by family; what no family lists is ``other``."""
    fmt = F.col("header_format")
    family = F.when(fmt.isin(*K.MEDIA_FAMILY), "media").when(fmt.isin(*K.DOCUMENT_FAMILY), "document").when(fmt == "unidentified", "unidentified").otherwise("other")
    return census.groupBy(family.alias("family")).agg(F.sum("count").alias("count"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))


def positional_samples(rows: DataFrame, order: str, *group: str) -> DataFrame:
    """Of each group's rows, in order: the first, second, fourth and last.

    The first four and the last of each group are found by top-k windows, whose group limit
    runs before the shuffle, and a count with map-side combining; no window holds a group.
    """
    keys = list(group) or ["_all"]
    every = rows if group else rows.withColumn("_all", F.lit(0))
    n = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    first = every.withColumn("_k", F.row_number().over(up)).where("_k <= 4").join(n, keys).withColumn("position", F.col("_k") - 1)
    last = every.withColumn("_k", F.row_number().over(down)).where("_k <= 1").join(n, keys).where("_n > 4").withColumn("position", (F.col("_n") - 1).cast("int"))
    first = first.where(F.col("position").isin(0, 1, 3) | (F.col("position") == F.col("_n") - 1))
    return first.unionByName(last).drop("_n", "_k", "_all")


def naming_shape(names: list[str]) -> str:
    import re

    if names and all(re.fullmatch(r"conversations[-_]\d+\.json", x, re.I) for x in names):
        return "numbered"
    return "single" if names == ["conversations.json"] else "mixed"
