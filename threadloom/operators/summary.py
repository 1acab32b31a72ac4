"""Summary aggregates over the index tables, and censuses over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import METRICS
from ..functions.digests import iso_utc


def metric_sums(conversations: DataFrame) -> DataFrame:
    """One row: conversations, and the sum of each metric."""
    return conversations.agg(F.count("*").alias("conversations"), *(F.coalesce(F.sum(f"metrics.{m}"), F.lit(0)).cast("long").alias(m) for m in METRICS.split()))


def anomaly_census(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.explode("anomalies").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n"))


def census(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def message_census(nodes: DataFrame, column: str) -> DataFrame:
    return census(nodes.where("is_message"), column)


def bounds(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each column: least, greatest, how many there are and are missing. One pass."""
    parts = [F.struct(F.lit(c).alias("field"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("present"), (F.count("*") - F.count(c)).alias("missing")) for c in columns]
    return rows.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def date_bounds(rows: DataFrame, *columns: str) -> DataFrame:
    return bounds(rows, *columns).withColumns({"min": iso_utc(F.col("min")), "max": iso_utc(F.col("max"))})


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many groups of equal values have more than one row."""
    return rows.groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("groups"))


def distinct(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many values there are, exactly."""
    return rows.agg(F.countDistinct(column).alias("distinct"))


def linked(links: DataFrame, chosen: DataFrame, keys: list[str], member: str) -> DataFrame:
    """One row: links that a chosen row has, and distinct members among them."""
    return links.join(chosen, keys).agg(F.count("*").alias("links"), F.countDistinct(member).alias("members"))


def resolved_payload(refs: DataFrame, links: DataFrame) -> DataFrame:
    """One row: members that a resolved reference leads to."""
    keys = ["shard", "conversation_ordinal", "node_digest", "reference_ordinal"]
    return linked(links, refs.where("resolution = 'resolved'"), keys, "entry_ordinal").select("members")


def branched(conversations: DataFrame) -> DataFrame:
    return conversations.where("metrics.branch_points > 0").agg(F.count("*").alias("conversations"))


def per_shard(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(shard, conversations, nodes, messages)."""
    n = nodes.groupBy("shard").agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.col("is_message").cast("long")), F.lit(0)).alias("messages"))
    c = conversations.groupBy("shard").agg(F.count("*").alias("conversations"))
    zero: Column = F.lit(0).cast("long")
    return c.join(n, "shard", "left").select("shard", "conversations", F.coalesce("nodes", zero).alias("nodes"), F.coalesce("messages", zero).alias("messages"))


def summary(t: dict[str, DataFrame]) -> dict:
    """The whole summary of an index as plain values: a few rows for each aggregate."""
    dicts = lambda df, k, v="n": {r[k]: r[v] for r in df.collect()}
    dates = {}
    for name in ("conversations", "nodes"):
        for r in date_bounds(t[name], "create_time", "update_time").collect():
            dates[f"{name}_{r['field']}"] = {k: r[k] for k in ("min", "max", "present", "missing")}
    refs = t["attachment_refs"]
    return {
        "counts": metric_sums(t["conversations"]).first().asDict(),
        "anomalies": dicts(anomaly_census(t["conversations"]), "code"),
        "date_bounds_utc": dates,
        "roles": dicts(message_census(t["nodes"], "role"), "role"),
        "content_types": dicts(message_census(t["nodes"], "content_type"), "content_type"),
        "attachments": dicts(census(refs, "resolution"), "resolution"),
        "unique_reference_digests": distinct(refs, "reference_digest").first()[0],
        "resolved_payload_members": resolved_payload(refs, t["attachment_links"]).first()[0],
        "duplicate_id_groups": repeated(t["conversations"], "identity_digest").first()[0],
        "duplicate_structural_groups": repeated(t["conversations"], "structural_digest").first()[0],
        "conversations_with_branches": branched(t["conversations"]).first()[0],
    }
