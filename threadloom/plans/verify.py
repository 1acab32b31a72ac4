"""Verification of an intake: its numbers add up, its source is as it was, and samples leak nothing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.constants import ANCILLARY_BYTES, RISK_ENCRYPTED, RISK_PATH, SAMPLE_BYTES
from ..operators import discovery, sample
from ..sources.zip_members import sample_positions
from . import inventory as I
from .workspace import Workspace, atomic_write

CANARY = "CANARY_THAT_NO_OUTPUT_MAY_HOLD"


def synthetic_checks(spark: SparkSession) -> list[tuple[str, bool]]:
    """The sampler and the aliases on a made conversation."""
    message = {"id": "n1", "author": {"role": "user", "name": CANARY}, "content": {"content_type": "text", "parts": [CANARY]}, "metadata": {"attachments": [{"file_id": CANARY, "file_name": CANARY}]}}
    talk = {"id": CANARY, "title": CANARY, "current_node": "n1", "mapping": {CANARY: {"id": CANARY, "parent": None, "message": None}, "n1": {"id": "n1", "parent": CANARY, "message": message}}}
    s = sample.schema_sample(json.dumps([talk]).encode(), 1 << 20)
    graph = s["bounded_graph_check"] or {}
    alias = spark.range(1).select(C.safe_name(F.lit(f"{CANARY}.pdf"), F.lit(3))).first()[0]
    return [
        ("no value in a sample", CANARY not in json.dumps(s)),
        ("roles and attachment paths are seen", s["observed_roles"] == ["user"] and "$[].mapping.*.message.metadata.attachments[].file_id" in s["paths"]),
        ("the sampled graph resolves", bool(graph.get("current_node_resolves") and graph.get("parent_links_resolve"))),
        ("an unknown name is masked", CANARY not in alias),
        ("a cut-off sample is handled", sample.schema_sample(b'[{"title":"unfin', 100)["root_type"] == "array"),
    ]


def checks(spark: SparkSession, ws: Workspace) -> list[tuple[str, bool]]:
    inv = I.load(ws)
    entries, talks, out = inv["entries"], inv["conversation_files"], ws.folder("outputs")
    total = lambda key: sum(e[key] for e in entries)
    payload = [e for e in entries if e["extension"] in (".dat", ".bundle") and not e["is_directory"] and RISK_ENCRYPTED not in e["risk_flags"]]
    source = Path(inv["source_path"])
    now = source.stat() if source.exists() else None
    plan = (None, None)
    if now:
        members = I.members_of(spark, str(source))
        plan = discovery.selected(members, discovery.staging_plan(members)).agg(F.count("*"), F.sum("uncompressed_bytes")).first()
    by_hand = [e for e in entries if e["extension"] == ".json" and not e["is_directory"]]
    found = [
        ("members reconcile", len(entries) == inv["member_count"]),
        ("sizes reconcile", total("uncompressed_bytes") == inv["uncompressed_total_bytes"]),
        ("extensions reconcile", sum(x["count"] for x in inv["by_extension"].values()) == inv["file_count"]),
        ("there are conversations", bool(talks)),
        ("conversation shards differ", len({(e["uncompressed_bytes"], e["crc32"]) for e in talks}) == len(talks)),
        ("conversation samples are bounded", len(inv["schema_samples"]) == len(sample_positions(len(talks))) and all(s["bytes_read"] <= SAMPLE_BYTES for s in inv["schema_samples"])),
        ("other samples are bounded", all(s["bytes_read"] <= ANCILLARY_BYTES for s in inv["ancillary_schema_samples"])),
        ("payload headers reconcile", sum(x["count"] for x in inv["opaque_payload_header_scan"]["formats"].values()) == len(payload)),
        ("no change of the source was seen", inv["source_unchanged_size_and_mtime"]),
        ("the source is as it was", now is not None and (now.st_size, now.st_mtime_ns) == (inv["source_archive_bytes"], inv["source_mtime_ns"])),
        ("no unsafe path", not any(RISK_PATH in e["risk_flags"] for e in entries)),
        ("no encrypted member", not any(RISK_ENCRYPTED in e["risk_flags"] for e in entries)),
    ]
    for name in ("ARCHIVE_MANIFEST.md", I.NAME, "PRIVACY_RISK_REPORT.md", "PROCESSING_PLAN.md"):
        found.append((f"{name} is there", (out / name).is_file() and (out / name).stat().st_size > 0))
    found += [
        ("STATUS.md is there", (ws.root / "STATUS.md").is_file()),
        ("nothing is staged or indexed yet", not ws.folder("staging").exists() and not ws.folder("phase2").exists()),
        ("the staging plan reconciles", tuple(plan) == (len(by_hand), sum(e["uncompressed_bytes"] for e in by_hand))),
    ]
    return found + synthetic_checks(spark)


def verify(spark: SparkSession, ws: Workspace) -> list[tuple[str, bool]]:
    """All checks; the first that fails stops, under its name, and nothing is written."""
    found = checks(spark, ws)
    for name, ok in found:
        if not ok:
            raise AssertionError(name)
    atomic_write(ws, ws.folder("outputs") / "PHASE1_VALIDATION.json", {"status": "PASS", "checks": [{"check": n, "passed": ok} for n, ok in found]})
    return found
