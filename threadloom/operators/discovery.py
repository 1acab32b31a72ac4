"""Which members are staged where, which files hold shards, and what a finished run promises."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.constants import INDEX_VERSION, METRICS, SHARD_NAME
from ..functions.errors import DiscoveryError, need


def _need(ok: object, code: str) -> None:
    need(ok, f"DISCOVERY_{code}", DiscoveryError)


def _count(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


def shard_of(name) -> int | None:
    m = re.fullmatch(SHARD_NAME, name) if isinstance(name, str) else None
    return None if m is None else int(m[1] or 0)


def staging_plan(members: DataFrame) -> DataFrame:
    """(entry_id, zip_directory_index, safe_name, path_sha256, uncompressed_bytes, shard, destination) of conversations, then other JSON.

    Checked by aggregates before anything is staged: there are conversations, each with a
    shard of its own, and ids and destinations are distinct.
    """
    json_ = members.where(~F.col("is_directory"))
    talks = json_.where("is_conversation_json").withColumn("shard", C.shard_id(F.col("safe_name"))).withColumn("destination", F.concat(F.lit("conversations/"), "safe_name"))
    rest = json_.where((F.col("extension") == ".json") & ~F.col("is_conversation_json")).withColumn("shard", F.lit(None).cast("long")).withColumn("destination", F.concat(F.lit("metadata/"), "entry_id", F.lit(".json")))
    columns = ["entry_id", "zip_directory_index", "safe_name", "path_sha256", "uncompressed_bytes", "crc32", "shard", "destination"]
    plan = talks.select(columns).unionByName(rest.select(columns))
    is_talk = F.col("destination").startswith("conversations/")
    flaw = plan.agg(
        F.count(F.when(is_talk, 1)).alias("talks"),
        F.count(F.when(is_talk & F.col("shard").isNull(), 1)).alias("unnamed"),
        (F.count("shard") - F.countDistinct("shard")).alias("shards"),
        (F.count("*") - F.countDistinct("entry_id")).alias("ids"),
        (F.count("*") - F.countDistinct("destination")).alias("places"),
        F.count(F.when(F.col("zip_directory_index").isNull() | F.col("uncompressed_bytes").isNull() | (F.col("uncompressed_bytes") < 0), 1)).alias("odd"),
    ).first()
    _need(flaw["talks"], "NO_CONVERSATIONS")
    for name, code in (("unnamed", "CONVERSATION_NAME"), ("shards", "SHARD_DUPLICATE"), ("ids", "PLAN_ENTRY_DUPLICATE"), ("places", "PLAN_DESTINATION_DUPLICATE"), ("odd", "PLAN_ENTRY")):
        _need(not flaw[name], code)
    return plan


def remaining(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Plan rows that the ledger has not verified."""
    return plan.join(ledger.where("status = 'verified'").select("entry_id"), "entry_id", "left_anti")


def selected(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """Entries that the plan asks for."""
    return entries.join(plan.select("entry_id"), "entry_id", "left_semi")


#: What makes a directory entry the same one.
IDENTITY = ["path_sha256", "uncompressed_bytes", "compressed_bytes", "crc32", "compression_method", "zip_timestamp"]


def directory_differences(now: DataFrame, then: DataFrame) -> DataFrame:
    """(zip_directory_index, column) where two directories differ; ``[entry]`` where only one of them has the place."""
    a, b = (x.select("zip_directory_index", *(F.col(c).alias(f"{side}_{c}") for c in IDENTITY), F.lit(True).alias(f"{side}_there")) for side, x in (("a", now), ("b", then)))
    both = a.join(b, "zip_directory_index", "full")
    lone = F.when(F.col("a_there").isNull() | F.col("b_there").isNull(), F.array(F.lit("[entry]")))
    odd = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in IDENTITY)))
    return both.select("zip_directory_index", F.explode(F.coalesce(lone, odd)).alias("column"))


def shard_files(ledger: dict) -> dict[int, tuple[str, str, str]]:
    """{shard: (file name, destination, entry id)} of a ledger whose files are all verified."""
    files = ledger.get("files") if isinstance(ledger, dict) else None
    _need(isinstance(files, dict) and files, "LEDGER")
    out: dict[int, tuple[str, str, str]] = {}
    for ident, record in sorted(files.items()):
        place = record.get("destination") if isinstance(record, dict) and record.get("status") == "verified" else None
        _need(isinstance(place, str) and place and ident, "LEDGER_ENTRY")
        folder, _, name = place.rpartition("/")
        if not place.startswith("conversations/"):
            continue
        shard = shard_of(name)
        _need(shard is not None, "SHARD_NAME")
        _need(shard not in out, "SHARD_DUPLICATE")
        out[shard] = (name, place, ident)
    _need(out, "NO_SHARDS")
    return dict(sorted(out.items()))


def expectations(manifest: dict) -> tuple[dict[str, int], tuple[tuple[int, int, int, int], ...]]:
    """Totals and rows (shard, conversations, nodes, messages) that a finished run's manifest promises, if it agrees with itself."""
    _need(isinstance(manifest, dict), "MANIFEST")
    _need(manifest.get("status") == "verified_complete", "MANIFEST_STATE")
    _need(manifest.get("version") == INDEX_VERSION, "MANIFEST_VERSION")
    summary = manifest.get("summary")
    counts = summary.get("counts") if isinstance(summary, dict) else None
    _need(isinstance(counts, dict), "SUMMARY")
    total = {k: counts.get(k) for k in ["conversations", *METRICS.split()]}
    _need(all(map(_count, total.values())), "COUNTS")
    total["conversations_with_branches"] = summary.get("conversations_with_branches")
    _need(_count(total["conversations_with_branches"]), "BRANCH_COUNT")
    rows = manifest.get("per_shard")
    _need(isinstance(rows, list) and rows and all(isinstance(r, dict) for r in rows), "PER_SHARD")
    keys = ("shard", "conversations", "nodes", "messages")
    shards = tuple(tuple(r.get(k) for k in keys) for r in rows)
    _need(all(_count(v) for r in shards for v in r), "PER_SHARD")
    _need(all(a[0] < b[0] for a, b in zip(shards, shards[1:])), "PER_SHARD_ORDER")
    sums: Counter = Counter()
    for r in shards:
        sums.update(dict(zip(keys[1:], r[1:])))
    _need(all(sums[k] == total[k] for k in keys[1:]), "SHARD_TOTAL_MISMATCH")
    status = manifest.get("shards")
    _need(isinstance(status, list) and all(isinstance(r, (list, tuple)) and len(r) == 3 for r in status), "SHARDS_ROWS")
    _need([list(r) for r in status] == [[r[0], r[1], "complete"] for r in shards], "SHARDS_ROWS")
    return total, shards
