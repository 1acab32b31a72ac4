"""Indexing: staged JSON to the structural index, its summary, gates and reports."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import INDEX_VERSION, SCHEMA_VERSION
from ..functions.digests import digest
from ..functions.errors import need, safe_code
from ..operators import checks, discovery, summary
from ..operators.index import TABLES, Index
from ..operators.linkage import build_aliases
from ..sources import strict_json
from ..sources.zip_members import opened, read_arrays
from . import selftest
from . import staging as S
from .workspace import RunLock, Workspace, atomic_write

LIMITS = [
    "Attachment counts cover structured reference fields, not links in prose.",
    "Joins by file name alone stay unverified candidates; several targets are not counted as resolved.",
    "Duplicates are compared by identity and structural digest, not by content.",
    "Missing timestamps are reported and not inferred.",
]


def code_digest() -> str:
    """Digest of the package's own modules that rows depend on."""
    here = Path(__file__).resolve().parents[1]
    names = ["functions/constants.py", "functions/digests.py", "operators/conversations.py", "operators/index.py", "operators/linkage.py", "sources/strict_json.py"]
    return digest({n: hashlib.sha256((here / n).read_bytes()).hexdigest() for n in names})


def _names(archive: Path) -> list[str]:
    import zipfile

    with opened(str(archive)) as f, zipfile.ZipFile(f) as z:
        return [x.filename for x in z.infolist()]


def _source_same(archive: Path, ledger: dict, code: str) -> None:
    now = S.source_identity(archive)
    need(all(ledger["source"][k] == v for k, v in now.items()), code)


def _staged_same(folder: Path, ledger: dict, code: str) -> None:
    for r in ledger["files"].values():
        path = folder / r["destination"]
        need(r["status"] == "verified" and path.is_file() and path.stat().st_size == r["bytes"] and S.file_sha256(path) == r["sha256"], code)


def _only_staged(folder: Path, ledger: dict) -> None:
    there = {p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file()}
    need(there == {r["destination"] for r in ledger["files"].values()} | {S.LEDGER}, "UNEXPECTED_STAGED_FILE")


def located(folder: Path) -> str:
    """A folder as Spark takes it: under ``spark.checkpoint.dir`` or a mount that all executors share, as the workspace itself has to be."""
    return folder.resolve().as_uri()


def tables(index: Index) -> dict[str, DataFrame]:
    return {name: index.table(name) for name in TABLES}


def build(spark: SparkSession, ws: Workspace, interrupt_after: int | None = None) -> dict:
    """The index in ``phase2/structural_index``; the run's manifest. Complete shards are not done again.

    All shards that are left are read at once, and committed batch by batch; the manifest tells
    how far each is. ``interrupt_after``: stop before the commit of the shard after so many, as a
    crash would.
    """
    ws.preflight()
    out = ws.folder("phase2")
    with RunLock(out / "run.lock"):
        tests = selftest.required(ws)
        pointer = json.loads((out / "staging_pointer.json").read_text(encoding="utf-8"))
        folder = ws.inside(pointer["relative_root"])
        ledger, archive = S.read_ledger(folder), ws.source_zip()
        _source_same(archive, ledger, "SOURCE_RESUME_CHANGED")
        _staged_same(folder, ledger, "STAGING_RESUME_CHANGED")
        _only_staged(folder, ledger)
        need(S.directory_digest(archive) == ledger["source"]["central_directory_sha256"], "DIRECTORY_CHANGED")
        files = {shard: str(folder / place) for shard, (_, place, _) in discovery.shard_files(ledger).items()}
        metadata = [folder / r["destination"] for _, r in sorted(ledger["files"].items()) if r["destination"].startswith("metadata/")]
        aliases = build_aliases(_names(archive), [strict_json.load(p.read_bytes()) for p in metadata])
        index = Index(spark, f"{located(out)}/structural_index")
        fingerprint = digest([SCHEMA_VERSION, INDEX_VERSION, ledger["source"], code_digest()])
        index.bind(fingerprint)
        read = lambda shards: read_arrays(spark, {s: files[s] for s in shards})

        def progress() -> None:
            rows = [[r["shard"], r["committed"], r["status"]] for r in index.shards().orderBy("shard").collect()]
            atomic_write(ws, out / "run_manifest.json", {"version": INDEX_VERSION, "schema": SCHEMA_VERSION, "fingerprint": fingerprint, "source": ledger["source"], "status": "indexing", "shards": rows})

        progress()
        if interrupt_after is not None and interrupt_after < len(files):
            first, then = list(files)[:interrupt_after], [list(files)[interrupt_after]]
            index.add(first, read(first), aliases)
            progress()
            index.add(then, read(then), aliases, interrupt=True)
        complete = index.complete()
        left = [s for s in files if s not in complete]
        index.add(left, read(left), aliases, committed=lambda: (progress(), ws.room()))
        index.sweep()
        t = tables(index)
        found = summary.summary(t)
        per_shard = checks.reconcile(t, found, checks.recount(read(files)))
        checks.keys_hold(t)
        privacy = checks.privacy_audit(t)
        _staged_same(folder, ledger, "STAGED_FINAL_HASH")
        _source_same(archive, ledger, "SOURCE_FINAL_CHANGED")
        _only_staged(folder, ledger)
        need(all(p.resolve().is_relative_to(ws.root) for p in ws.root.rglob("*")), "GENERATED_PATH_ESCAPE")
        shards = [[r["shard"], r["committed"], r["status"]] for r in index.shards().orderBy("shard").collect()]
        validation = {"pass": True, "per_shard": per_shard, "counts": found["counts"], "staged_hashes_revalidated": len(ledger["files"]), "privacy": privacy, "parser_tests": tests, "graph_anomalies": found["anomalies"], "limitations": LIMITS}
        validation["structural_validity"] = "index_valid_with_source_graph_anomalies" if found["anomalies"] else "valid"
        manifest = {"version": INDEX_VERSION, "schema": SCHEMA_VERSION, "fingerprint": fingerprint, "source": ledger["source"], "status": "verified_complete", "shards": shards, "per_shard": per_shard, "metadata_mapping_stats": aliases.stats, "summary": found, "completed_at_utc": datetime.now(timezone.utc).isoformat()}
        discovery.expectations(manifest)
        atomic_write(ws, out / "VALIDATION.json", validation)
        atomic_write(ws, out / "run_manifest.json", manifest)
        from . import reports

        reports.index_reports(ws, found, aliases.stats, len(shards))
    return manifest


def guarded(ws: Workspace, run, *args, **kw):
    """``run``; on failure only a fixed code or a type's name is written and raised."""
    try:
        return run(*args, **kw)
    except Exception as e:
        code = safe_code(e)
        atomic_write(ws, ws.folder("phase2") / "safe_error.json", {"code": code})
        raise SystemExit(f"FAILED {code}") from None
