"""Intake: one archive to its inventory document."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.errors import need
from ..operators import members as M
from ..operators import sample as P
from ..sources.zip_members import read_members
from .workspace import Workspace, atomic_write

NAME = "ARCHIVE_INVENTORY.json"
MEMBER = ["entry_id", "zip_directory_index", "safe_name", "path_sha256", "extension", "is_directory", "uncompressed_bytes", "compressed_bytes", "zip_timestamp", "crc32", "compression_method", "is_conversation_json", "is_media", "is_other_attachment_candidate", "risk_flags", "header_format"]
LIMITS = [
    "The archive's size and modification time are compared; its payloads are not tested.",
    "Members of equal size and CRC are candidates for duplicates, not proven ones.",
    "Packaging times are not the times of conversations.",
    "Header formats are read from first bytes, without decoding.",
    "No bodies, titles, author names, node ids or paths are kept.",
    "Only prefixes of JSON members are looked at; what is not seen may still be there.",
]


def members_of(spark: SparkSession, archive: str) -> DataFrame:
    """Classified members with prefix and ``is_sampled``; prefixes are dropped by whoever writes."""
    raw = read_members(spark, archive)
    flags = raw.select("ordinal", "is_sampled").withColumnRenamed("ordinal", "zip_directory_index")
    return C.classified(raw).join(flags, "zip_directory_index")


def samples_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of conversation members, and of other JSON members."""
    ready = members.where(F.col("prefix").isNotNull())
    talks = P.sampled(ready.where("is_conversation_json and is_sampled")).select("zip_directory_index", "entry_id", "safe_name", "sample")
    rest = P.sampled(ready.where((F.col("extension") == ".json") & ~F.col("is_conversation_json"))).select("zip_directory_index", "entry_id", "safe_name", "sample")
    return talks, rest


def _plain(rows) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows]


def inventory(spark: SparkSession, ws: Workspace, archive: Path | None = None) -> dict:
    """Reads the archive's directory and bounded prefixes, and writes the inventory."""
    archive = archive or ws.only_zip()
    before = archive.stat()
    rows = members_of(spark, str(archive)).persist()
    try:
        talks, rest = samples_of(rows)
        # one archive's directory: what the inventory lists is what the driver writes
        entries = _plain(rows.orderBy("zip_directory_index").select(*MEMBER).collect())
        total = M.totals(rows).first().asDict()
        need(total["member_count"] > 0, "ARCHIVE_EMPTY")
        census = _plain(M.header_census(rows).collect())

        def ids(of, groups, signature: list[str]) -> list[list[str]]:
            out: dict[str, list[str]] = {}
            for r in M.group_members(of, groups, signature, "entry_id").orderBy("first_id", "id").collect():
                out.setdefault(r["first_id"], []).append(r["id"])
            return sorted(out.values())

        out = {
            "phase": 1,
            "inspected_at_utc": datetime.now(timezone.utc).isoformat(),
            "source_path": str(archive),
            "source_type": "ZIP archive",
            "source_container_count": 1,
            "source_archive_bytes": before.st_size,
            "source_mtime_ns": before.st_mtime_ns,
            "source_unchanged_size_and_mtime": True,
            **total,
            "by_extension": {r.pop("extension"): r for r in _plain(M.by_extension(rows).collect())},
            "conversation_files": [e for e in entries if e["is_conversation_json"]],
            "largest_files": _plain(M.largest(M.files(rows), "uncompressed_bytes", "zip_directory_index").select(*MEMBER).collect()),
            "opaque_payload_header_scan": {"limit_bytes_per_entry": 64, "total_bytes_read": sum(r["header_bytes_read"] or 0 for r in census), "formats": {r["header_format"]: {"count": r["count"], "uncompressed_bytes": r["uncompressed_bytes"]} for r in census}},
            "duplicate_member_name_groups": ids(rows, M.duplicate_names(rows), ["path_sha256"]),
            "possible_duplicate_member_groups": ids(M.files(rows), M.duplicate_candidates(rows), ["uncompressed_bytes", "crc32"]),
            "schema_samples": [{"entry_id": r["entry_id"], "safe_name": r["safe_name"], **r["sample"]} for r in _plain(talks.orderBy("zip_directory_index").collect())],
            "ancillary_schema_samples": [{"entry_id": r["entry_id"], "safe_name": r["safe_name"], **{k: r["sample"][k] for k in ("bytes_read", "root_type", "paths")}} for r in _plain(rest.orderBy("zip_directory_index").collect())],
            "entries": entries,
            "limitations": LIMITS,
        }
    finally:
        rows.unpersist()
    after = archive.stat()
    need((before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns), "SOURCE_CHANGED")
    atomic_write(ws, ws.folder("outputs") / NAME, json.dumps(out, ensure_ascii=False, indent=2))
    return out


def brief(inventory_: dict) -> dict:
    """What may be printed: no entries, paths or times of conversations."""
    out = {k: v for k, v in inventory_.items() if k not in ("entries", "largest_files", "possible_duplicate_member_groups", "ancillary_schema_samples", "source_path")}
    short = ("entry_id", "safe_name", "uncompressed_bytes", "compressed_bytes")
    out["conversation_files"] = [{k: e[k] for k in short} for e in inventory_["conversation_files"]]
    out["largest_files"] = [{k: e[k] for k in short[:3]} for e in inventory_["largest_files"]]
    out["schema_samples"] = [{k: v for k, v in s.items() if k not in ("paths", "sampled_timestamps")} for s in inventory_["schema_samples"]]
    out["duplicate_candidate_group_count"] = len(inventory_["possible_duplicate_member_groups"])
    return out


def load(ws: Workspace) -> dict:
    path = ws.folder("outputs") / NAME
    need(path.is_file(), "INVENTORY_MISSING")
    return json.loads(path.read_text(encoding="utf-8"))
