"""Staging: the JSON members of an archive, copied out with checksums and a ledger that can be resumed."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.constants import INDEX_VERSION
from ..functions.digests import digest
from ..functions.errors import need
from ..operators import discovery
from ..sources.zip_members import opened, read_members
from . import inventory as I
from .workspace import RunLock, Workspace, atomic_write

LEDGER, DONE = "extraction_manifest.json", "extraction_done"


def file_sha256(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def source_identity(archive: Path) -> dict:
    need(archive.is_file(), "SOURCE_MISSING")
    s = archive.stat()
    return {"bytes": s.st_size, "mtime_ns": s.st_mtime_ns, "sha256": file_sha256(archive)}


def directory_digest(archive: Path) -> str:
    """Digest of the whole central directory, in order."""
    with opened(str(archive)) as f, zipfile.ZipFile(f) as z:
        rows = [[i, hashlib.sha256(x.filename.encode()).hexdigest(), x.file_size, x.compress_size, x.CRC, x.compress_type, list(x.date_time), x.header_offset, x.flag_bits] for i, x in enumerate(z.infolist())]
    return digest(rows)


def directory_matches(spark: SparkSession, archive: Path, entries: list[dict]) -> None:
    """The archive's directory and an inventory's entries agree row by row: nothing is on one side only."""
    now = I.members_of(spark, str(archive))
    columns = ["zip_directory_index", *discovery.IDENTITY]
    then = spark.createDataFrame([tuple(e[c] for c in columns) for e in entries], "zip_directory_index int, path_sha256 string, uncompressed_bytes long, compressed_bytes long, crc32 string, compression_method int, zip_timestamp array<int>")
    need(now.count() == len(entries), "DIRECTORY_COUNT")
    need(discovery.directory_differences(now, then).isEmpty(), "DIRECTORY_IDENTITY")


def _copied(z: zipfile.ZipFile, info: zipfile.ZipInfo, target: Path, size: int, crc32: str) -> tuple[int, str, str]:
    """Streams a member to ``target``; an existing file is adopted if a fresh reading of the source agrees."""
    sha, n, crc = hashlib.sha256(), 0, 0
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(f"{target.name}.partial-{os.getpid()}")
    out = None if target.exists() else open(partial, "wb")
    try:
        with z.open(info) as member:
            while piece := member.read(1 << 20):
                sha.update(piece)
                crc, n = zlib.crc32(piece, crc), n + len(piece)
                if out:
                    out.write(piece)
        if out:
            out.flush()
            os.fsync(out.fileno())
    finally:
        if out:
            out.close()
    need(n == size and f"{crc:08x}" == crc32, "MEMBER_CHECKSUM")
    need(file_sha256(partial if out else target) == sha.hexdigest(), "DEST_CHECKSUM")
    if out:
        os.replace(partial, target)
    return n, f"{crc:08x}", sha.hexdigest()


def _noted(base: Path, entry: str, done: tuple[int, str, str]) -> None:
    """Leaves a member's record as soon as it is verified, so a crash forgets nothing."""
    at = base / DONE / f"{entry}.json"
    at.parent.mkdir(parents=True, exist_ok=True)
    partial = at.with_name(f"{at.name}.partial-{os.getpid()}")
    partial.write_text(json.dumps(dict(zip(("bytes", "crc32", "sha256"), done))))
    os.replace(partial, at)


def _adopt(base: Path, ledger: dict) -> None:
    """Takes the records that tasks left into the ledger."""
    for at in sorted((base / DONE).glob("*.json")) if (base / DONE).is_dir() else ():
        ledger["files"].setdefault(at.stem, {}).update({"status": "verified", **json.loads(at.read_text())})


def _forget(base: Path) -> None:
    if (base / DONE).is_dir():
        for at in (base / DONE).iterdir():
            at.unlink()
        (base / DONE).rmdir()


def read_ledger(folder: Path) -> dict | None:
    path = folder / LEDGER
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def stage(spark: SparkSession, ws: Workspace) -> dict:
    """Copies what the plan asks for and the ledger lacks; gives the ledger.

    Members go out in parallel, each verified by CRC and SHA-256 before it gets its name; the
    task that verified one leaves its record at once, and the next run adopts such records.
    The folder has to be one that executors share, as for any Spark output.
    """
    ws.preflight()
    archive, found = ws.source_zip(), I.load(ws)
    with RunLock(ws.folder("phase2") / "run.lock"):
        need(str(archive) == found["source_path"], "SOURCE_PATH")
        s = archive.stat()
        need((s.st_size, s.st_mtime_ns) == (found["source_archive_bytes"], found["source_mtime_ns"]), "SOURCE_STAT")
        identity = source_identity(archive)
        directory_matches(spark, archive, found["entries"])
        identity["central_directory_sha256"] = directory_digest(archive)
        folder = ws.inside(ws.folder("staging") / identity["sha256"])
        ledger = read_ledger(folder) or {"version": INDEX_VERSION, "source": identity, "files": {}}
        need(ledger["source"] == identity and ledger["version"] == INDEX_VERSION, "RESUME_IDENTITY")
        atomic_write(ws, ws.folder("phase2") / "preflight.json", {"source": identity, "inventory_entries_verified": len(found["entries"])})
        plan = discovery.staging_plan(I.members_of(spark, str(archive)))
        rows = [r.asDict() for r in plan.orderBy("zip_directory_index").collect()]  # one archive's JSON members
        for r in rows:
            need(ws.inside(folder / r["destination"]).is_relative_to(folder), "STAGE_PATH")
        _adopt(folder, ledger)
        for ident, record in ledger["files"].items():
            if record["status"] == "verified":
                path = folder / record["destination"]
                need(path.is_file() and path.stat().st_size == record["bytes"] and file_sha256(path) == record["sha256"], "STAGED_HASH")
        todo = [r for r in rows if ledger["files"].get(r["entry_id"], {}).get("status") != "verified"]
        for r in todo:
            ledger["files"][r["entry_id"]] = {"status": "extracting", "destination": r["destination"], "entry_ordinal": r["zip_directory_index"], "path_sha256": r["path_sha256"], "expected_bytes": r["uncompressed_bytes"], "expected_crc32": r["crc32"]}
        atomic_write(ws, folder / LEDGER, ledger)
        _forget(folder)
        if todo:
            source, base = str(archive), str(folder)

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                with opened(source) as f, zipfile.ZipFile(f) as z:
                    members = z.infolist()
                    for x in parts:
                        for entry, o, d, n, c in zip(x["entry_id"], x["ordinal"], x["destination"], x["size"], x["crc32"]):
                            _noted(Path(base), entry, _copied(z, members[o], Path(base) / d, n, c))
                        yield x[["entry_id"]]

            work = spark.createDataFrame([(r["entry_id"], r["zip_directory_index"], r["destination"], r["uncompressed_bytes"], r["crc32"]) for r in todo], "entry_id string, ordinal int, destination string, size long, crc32 string")
            copied = work.repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism), "entry_id").mapInPandas(run, "entry_id string").count()
            need(copied == len(todo), "STAGING_PLAN_CHANGED")
            _adopt(folder, ledger)
            atomic_write(ws, folder / LEDGER, ledger)
            _forget(folder)
        need(set(ledger["files"]) == {r["entry_id"] for r in rows}, "STAGING_PLAN_CHANGED")
        need(sum(f["bytes"] for f in ledger["files"].values()) == sum(r["uncompressed_bytes"] for r in rows), "STAGING_TOTAL")
        atomic_write(ws, ws.folder("phase2") / "staging_pointer.json", {"relative_root": str(folder.relative_to(ws.root))})
    return ledger


__all__ = ["LEDGER", "directory_digest", "directory_matches", "file_sha256", "read_ledger", "read_members", "source_identity", "stage"]
