"""Gates: each is a count that has to be 0, or an equality, with a fixed code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.errors import need
from . import summary as S

DIGESTS = {
    "conversations": ["identity_digest", "structural_digest", "current_digest"],
    "nodes": ["node_digest", "parent_digest", "message_digest"],
    "attachment_refs": ["node_digest", "reference_digest", "field_path_digest"],
    "attachment_links": ["node_digest"],
}


def is_digest(c: Column) -> Column:
    return c.rlike(r"^[a-f0-9]{64}\z")


def bad_digests(df: DataFrame, *columns: str) -> DataFrame:
    """One row: cells looked at, and cells that are neither a digest nor null."""
    bad = sum((F.when(F.col(c).isNotNull() & ~is_digest(F.col(c)), 1).otherwise(0) for c in columns), F.lit(0))
    return df.agg((F.count("*") * len(columns)).alias("cells"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("bad"))


def bad_enums(df: DataFrame, column: str, allowed: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values that are neither allowed nor the digest of an unknown one."""
    c = F.col(column)
    fine = c.isin(*allowed.split(), *extra) | c.rlike(r"^unknown:[a-f0-9]{64}\z")
    return df.select(column).distinct().where(~F.coalesce(fine, F.lit(False)))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``child`` without a row in ``parent``."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def privacy_audit(t: dict[str, DataFrame]) -> dict:
    """Every text cell is a digest or from a fixed list; the number of digest cells looked at."""
    cells = 0
    for name, columns in DIGESTS.items():
        row = bad_digests(t[name], *columns).first()
        need(row["bad"] == 0, "PRIVACY_DIGEST")
        cells += row["cells"]
    for column, allowed in (("role", K.ROLES), ("content_type", K.CONTENT_TYPES)):
        need(bad_enums(t["nodes"], column, allowed, ("null", "missing")).isEmpty(), "PRIVACY_ENUM")
    names = t["conversations"].select(F.explode(F.map_keys("anomalies")).alias("code")).distinct()
    need(names.where(~F.col("code").rlike(r"^[a-z_]+\z")).isEmpty(), "PRIVACY_ANOMALY")
    listed = lambda name, column, allowed: t[name].select(column).distinct().where(~F.col(column).isin(*allowed)).isEmpty()
    need(listed("attachment_refs", "kind", [*K.REFERENCE_KEYS.split(), "attachment_field"]), "PRIVACY_REF_KIND")
    need(listed("attachment_refs", "resolution", K.RESOLUTIONS.split()), "PRIVACY_RESOLUTION")
    parts = t["attachment_links"].select("method").distinct().select(F.explode(F.split("method", r"\+")).alias("method"))
    need(parts.where(~F.col("method").isin(*K.METHODS.split())).isEmpty(), "PRIVACY_METHOD")
    return {"pass": True, "digest_cells_checked": cells}


def keys_hold(t: dict[str, DataFrame]) -> None:
    """Primary and foreign keys, which Parquet doesn't enforce."""
    conv, node = ["shard", "conversation_ordinal"], ["shard", "conversation_ordinal", "node_digest"]
    ref = [*node, "reference_ordinal"]
    talks = t["conversations"].withColumnRenamed("ordinal", "conversation_ordinal")
    for df, keys in ((talks, conv), (t["nodes"], node), (t["attachment_refs"], ref), (t["attachment_links"], [*ref, "entry_ordinal"])):
        need(repeated_keys(df, keys).isEmpty(), "INDEX_INTEGRITY")
    for child, parent, keys in ((t["nodes"], talks, conv), (t["attachment_refs"], t["nodes"], node), (t["attachment_links"], t["attachment_refs"], ref)):
        need(orphans(child, parent, keys).isEmpty(), "INDEX_FOREIGN_KEYS")


def recount(raw: DataFrame) -> DataFrame:
    """(shard, conversations, nodes, messages) from conversations read again, not from the index."""
    from ..sources.strict_json import load

    @F.pandas_udf("struct<nodes: long, messages: long>")
    def sizes(payload):
        import pandas as pd

        talks = [load(p.encode())["mapping"] for p in payload]
        return pd.DataFrame({"nodes": [len(m) for m in talks], "messages": [sum(n.get("message") is not None for n in m.values()) for m in talks]})

    return raw.withColumn("s", sizes("payload")).groupBy("shard").agg(F.count("*").alias("conversations"), F.sum("s.nodes").alias("nodes"), F.sum("s.messages").alias("messages"))


def reconcile(t: dict[str, DataFrame], found: dict, again: DataFrame) -> list[dict]:
    """Rows per shard; index, summary and a second reading have to agree. An empty shard counts as zeros."""
    columns = ["shard", "conversations", "nodes", "messages"]
    mine, again = S.per_shard(t["nodes"], t["conversations"]).select(columns).persist(), again.select(columns).persist()
    try:
        need(same_rows(mine, again), "SHARD_RECONCILIATION")
        rows = [r.asDict() for r in mine.orderBy("shard").collect()]  # a row for each shard
    finally:
        mine.unpersist()
        again.unpersist()
    counts = found["counts"]
    need(all(counts[k] == sum(r[k] for r in rows) for k in columns[1:]), "TOTAL_RECONCILIATION")
    need(sum(found["roles"].values()) == sum(found["content_types"].values()) == counts["messages"], "ENUM_RECONCILIATION")
    need(counts["messages"] + counts["null_nodes"] == counts["nodes"], "NULL_RECONCILIATION")
    return rows
