"""Queries of archives: directory rows made from pages, ZIP files, staging plans, and a whole run in a workspace."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import constants as K
from ..functions import digests as D
from ..functions.errors import CodeError, need
from ..operators import discovery
from ..operators import members as M
from ..sources.stored import new_folder, stored
from ..sources.tables import table
from ..sources.zip_members import read_members, sample_positions
from . import indexing, inventory, made, reports, selftest, staging, verify, workspace
from .registry import query

_SET = lambda names: ", ".join(f"'.{x}'" for x in names.split())
_STEMS = "|".join(["conversations?([-_]?[0-9]+)?", *K.SAFE_STEMS.split()])
#: Directory rows as they are made, and what names and first bytes say about them.
MEMBERS = rf"""raw AS (SELECT page_id AS i, {made.NAME} AS name, {made.SIZE} AS size, {made.PACKED} AS packed, {made.CRC} AS crc, {made.FLAGS} AS flags, {made.HEAD} AS head, [2026, 1 + page_id % 12, 1 + page_id % 28, page_id % 24, 0, 0] AS stamp FROM pages),
  based AS (SELECT *, regexp_extract(name, '([^/\\]*)$', 1) AS b, lower(regexp_extract(regexp_extract(name, '([^/\\]*)$', 1), '^.+(\.[^.]+)$', 1)) AS x FROM raw),
  m AS (SELECT *, name LIKE '%/' AS dir, printf('entry-%06d', i) AS entry, CASE WHEN regexp_full_match(x, '\.[a-z0-9]{{1,10}}') THEN x ELSE '[other]' END AS ext, printf('%08x', crc) AS crc32,
    regexp_full_match(b, '(?i){K.CONVERSATION_NAME}') AS talk,
    CASE WHEN starts_with(head, '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(head, 'FFD8FF') THEN 'JPEG' WHEN head IN ('474946383761', '474946383961') THEN 'GIF' WHEN starts_with(head, '52494646') AND substr(head, 17, 8) = '57454250' THEN 'WebP' WHEN starts_with(head, '52494646') AND substr(head, 17, 8) = '57415645' THEN 'WAV'
      WHEN starts_with(head, '52494646') AND substr(head, 17, 8) = '41564920' THEN 'AVI' WHEN starts_with(head, '4F676753') THEN 'Ogg container' WHEN starts_with(head, '664C6143') THEN 'FLAC' WHEN starts_with(head, '494433') THEN 'ID3 audio candidate' WHEN regexp_matches(head, '^FF[EF]') THEN 'MPEG audio candidate' WHEN substr(head, 9, 8) = '66747970' THEN 'ISO-BMFF media container'
      WHEN starts_with(head, '1A45DFA3') THEN 'Matroska/WebM container' WHEN starts_with(head, '255044462D') THEN 'PDF' WHEN starts_with(head, '504B0304') THEN 'ZIP-family container' WHEN starts_with(head, '53514C69746520666F726D6174203300') THEN 'SQLite' WHEN starts_with(head, 'D0CF11E0') THEN 'OLE compound document' WHEN starts_with(head, '1F8B') THEN 'gzip container' ELSE 'unidentified' END AS format FROM based),
  k AS (SELECT *, CASE WHEN regexp_full_match(b, '(?i)({_STEMS})\.(json|html)') THEN b ELSE entry || ext END AS safe, ext IN ({_SET(K.MEDIA_EXTENSIONS)}) AS media, ext IN ({_SET(K.ATTACHMENT_EXTENSIONS)}) AS other,
    concat_ws(',', CASE WHEN ext IN ({_SET(K.RISK_EXTENSIONS)}) THEN '{K.RISK_CONTAINER}' END, CASE WHEN regexp_matches(name, '(?i){K.SENSITIVE_NAME}') THEN '{K.RISK_NAME}' END, CASE WHEN regexp_matches(name, '^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:') THEN '{K.RISK_PATH}' END, CASE WHEN flags = 1 THEN '{K.RISK_ENCRYPTED}' END) AS risks,
    CASE WHEN ext IN ({_SET(K.PAYLOAD_EXTENSIONS)}) AND NOT dir THEN CASE WHEN flags = 1 THEN 'encrypted-not-read' ELSE format END END AS header FROM m)"""


def _with(sql: str) -> str:
    return f"WITH {MEMBERS} {sql}"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return C.classified(made.members(spark, d))


@query(_with("SELECT entry AS entry_id, i::INT AS zip_directory_index, safe AS safe_name, sha256(name) AS path_sha256, ext AS extension, dir AS is_directory, crc32, talk AS is_conversation_json, media AS is_media, other AS is_other_attachment_candidate, risks AS risk_flags, header AS header_format, CASE WHEN regexp_full_match(safe, 'conversations([_-][0-9]+)?\\.json') THEN coalesce(try_cast(regexp_extract(safe, '([0-9]+)', 1) AS BIGINT), 0) END AS shard FROM k"))
def member_classes(spark, d):
    """Names, flags, formats, checksums and shard numbers of all members."""
    return _members(spark, d).select("entry_id", "zip_directory_index", "safe_name", "path_sha256", "extension", "is_directory", "crc32", "is_conversation_json", "is_media", "is_other_attachment_candidate", F.array_join("risk_flags", ",").alias("risk_flags"), "header_format", C.shard_id(F.col("safe_name")).alias("shard"))


@query(_with("SELECT format AS header_format, count(*) AS n FROM m GROUP BY ALL"))
def header_formats(spark, d):
    """First bytes of all 18 outcomes."""
    return made.members(spark, d).groupBy(C.header_format(F.col("prefix")).alias("header_format")).agg(F.count("*").alias("n"))


@query(_with("SELECT ext AS extension, count(*) AS \"count\", sum(size)::BIGINT AS uncompressed_bytes, sum(packed)::BIGINT AS compressed_bytes FROM k WHERE NOT dir GROUP BY ext"))
def members_by_extension(spark, d):
    return M.by_extension(_members(spark, d))


@query(_with("SELECT count(*) AS member_count, sum((NOT dir)::INT)::BIGINT AS file_count, sum(size)::BIGINT AS uncompressed_total_bytes, sum(packed)::BIGINT AS compressed_members_total_bytes, sum(media::INT)::BIGINT AS extension_only_media_count, sum(CASE WHEN media THEN size ELSE 0 END)::BIGINT AS extension_only_media_uncompressed_bytes, sum(other::INT)::BIGINT AS extension_only_other_attachment_candidate_count, sum(CASE WHEN other THEN size ELSE 0 END)::BIGINT AS extension_only_other_attachment_candidate_bytes, array_to_string(min(stamp), ',') AS zip_date_min, array_to_string(max(stamp), ',') AS zip_date_max FROM k"))
def member_totals(spark, d):
    out = M.totals(_members(spark, d))
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("zip_date_min", "zip_date_max")})


@query(_with("SELECT header AS header_format, count(*) AS \"count\", sum(size)::BIGINT AS uncompressed_bytes, sum(length(head) // 2)::BIGINT AS header_bytes_read FROM k WHERE header <> 'encrypted-not-read' GROUP BY header"))
def header_census(spark, d):
    return M.header_census(_members(spark, d))


@query(_with(f"SELECT CASE WHEN header IN ({', '.join(repr(x) for x in K.MEDIA_FAMILY)}) THEN 'media' WHEN header IN ({', '.join(repr(x) for x in K.DOCUMENT_FAMILY)}) THEN 'document' WHEN header = 'unidentified' THEN 'unidentified' ELSE 'other' END AS family, count(*) AS \"count\", sum(size)::BIGINT AS uncompressed_bytes FROM k WHERE header <> 'encrypted-not-read' GROUP BY 1"))
def header_families(spark, d):
    return M.families(M.header_census(_members(spark, d)))


_GROUPS = "SELECT '{}' AS kind, first AS first_id, entry AS id FROM (SELECT entry, min(entry) OVER (PARTITION BY {}) AS first, count(*) OVER (PARTITION BY {}) AS n FROM k WHERE {}) WHERE n > 1"


@query(_with(" UNION ALL ".join([_GROUPS.format("size and crc", "size, crc32", "size, crc32", "NOT dir AND size > 0"), _GROUPS.format("name", "name", "name", "true")])))
def duplicate_members(spark, d):
    """Members of groups of one size and CRC, and of one name."""
    rows = stored(_members(spark, d).drop("prefix"), "members")
    same = M.group_members(M.files(rows), M.duplicate_candidates(rows), ["uncompressed_bytes", "crc32"], "entry_id").withColumn("kind", F.lit("size and crc"))
    return same.unionByName(M.group_members(rows, M.duplicate_names(rows), ["path_sha256"], "entry_id").withColumn("kind", F.lit("name")))


@query(_with("SELECT entry AS entry_id, size AS uncompressed_bytes FROM k WHERE NOT dir ORDER BY size DESC, i LIMIT 15"))
def largest_files(spark, d):
    return M.largest(M.files(_members(spark, d)), "uncompressed_bytes", "zip_directory_index").select("entry_id", "uncompressed_bytes")


# --- ZIP files -------------------------------------------------------------------------------

_ZIP = f"""z AS (SELECT archive, i, name, b, ext, dir, talk, flags, row_number() OVER (PARTITION BY archive ORDER BY i) - 1 AS place, CASE WHEN talk THEN row_number() OVER (PARTITION BY archive, talk ORDER BY i) - 1 END AS nth, sum(talk::INT) OVER (PARTITION BY archive) AS talks, CASE WHEN dir THEN '' ELSE coalesce(html, '') END AS body
    FROM k JOIN (SELECT page_id, html, floor(page_id / {made.PER_ARCHIVE})::BIGINT AS archive FROM pages) h ON h.page_id = k.i),
  limits AS (SELECT *, talk AND (nth IN (0, 1, 3) OR nth = talks - 1) AS sampled, CASE WHEN flags = 1 OR dir THEN 0 WHEN talk THEN CASE WHEN nth IN (0, 1, 3) OR nth = talks - 1 THEN {K.SAMPLE_BYTES} ELSE 0 END WHEN ext = '.json' THEN {K.ANCILLARY_BYTES} WHEN ext IN ('.dat', '.bundle') THEN {K.HEADER_BYTES} ELSE 0 END AS most FROM z)"""


@query(_with(f", {_ZIP} SELECT archive, place::INT AS ordinal, sha256(name) AS path_sha256, strlen(body)::BIGINT AS uncompressed_bytes, sampled AS is_sampled, flags = 1 AS is_encrypted, CASE WHEN most > 0 THEN least(most, strlen(body)) END::INT AS prefix_bytes, true AS crc_holds FROM limits"))
def zip_directory(spark, d):
    """ZIP files with all pages, read as an archive's directory with bounded prefixes; CRCs against the pages' own."""
    paths = made.archives(spark, d)
    found = read_members(spark, *paths) if paths else read_members(spark).limit(0)
    names = spark.createDataFrame([(k, int(Path(p).stem)) for k, p in enumerate(paths)], "archive int, number long")
    pages = table(spark, d, "pages").selectExpr(f"{made.NAME} AS name", f"CAST(floor(page_id / {made.PER_ARCHIVE}) AS BIGINT) AS number", "page_id", "html")
    own = pages.select("number", "name", "page_id", F.crc32(F.encode(F.when(F.col("name").endswith("/"), "").otherwise(F.coalesce("html", F.lit(""))), "UTF-8")).alias("own"))
    order = F.row_number().over(made.Window.partitionBy("number").orderBy("page_id")) - 1
    own = own.select("number", order.alias("ordinal"), "own")
    both = found.join(F.broadcast(names), "archive").join(own, ["number", "ordinal"])
    return both.select(F.col("number").alias("archive"), "ordinal", F.sha2("name", 256).alias("path_sha256"), "uncompressed_bytes", "is_sampled", (F.col("flag_bits").bitwiseAND(F.lit(1)) == 1).alias("is_encrypted"), F.octet_length("prefix").alias("prefix_bytes"), (F.col("crc") == F.col("own")).alias("crc_holds"))


# --- plans -----------------------------------------------------------------------------------

_PLAN = "plan AS (SELECT entry, i, CASE WHEN talk THEN i END AS shard, CASE WHEN talk THEN 'conversations/' || safe ELSE 'metadata/' || entry || '.json' END AS destination, size FROM k WHERE NOT dir AND ext = '.json' AND name <> 'Conversation.JSON')"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    known = made.members(spark, d).where("name <> 'Conversation.JSON'")  # which discovery rejects by its name
    return discovery.staging_plan(C.classified(known))


@query(_with(f", {_PLAN} SELECT entry AS entry_id, i::INT AS zip_directory_index, shard, destination, size AS uncompressed_bytes FROM plan"))
def staging_plan(spark, d):
    return _plan(spark, d).select("entry_id", "zip_directory_index", "shard", "destination", "uncompressed_bytes")


@query(_with(f", {_PLAN} SELECT entry AS entry_id, destination FROM plan WHERE i % 3 <> 0"))
def staging_remaining(spark, d):
    """The plan against a ledger that has verified each third member and begun each fifth."""
    plan = _plan(spark, d)
    status = F.when(F.col("zip_directory_index") % 3 == 0, "verified").when(F.col("zip_directory_index") % 5 == 0, "extracting")
    ledger = plan.select("entry_id", status.alias("status")).where("status IS NOT NULL")
    return discovery.remaining(plan, ledger).select("entry_id", "destination")


@query(_with(f", {_PLAN} SELECT count(*) AS members, sum(p.size)::BIGINT AS bytes, max(p.size) + sum(p.size)::BIGINT AS peak FROM k JOIN plan p ON p.entry = k.entry"))
def staging_sizes(spark, d):
    """Members that the plan asks for, their bytes, and the most that staging holds with one partial file."""
    chosen = discovery.selected(_members(spark, d), _plan(spark, d))
    return chosen.agg(F.count("*").alias("members"), F.sum("uncompressed_bytes").alias("bytes"), (F.sum("uncompressed_bytes") + F.max("uncompressed_bytes")).alias("peak"))


@query("SELECT * FROM (VALUES ('none', 'DISCOVERY_NO_CONVERSATIONS'), ('singular', 'DISCOVERY_CONVERSATION_NAME'), ('twice', 'DISCOVERY_SHARD_DUPLICATE'), ('number', 'DISCOVERY_PLAN_ENTRY'), ('good', 'none')) v(\"case\", code)")
def plan_codes(spark, d):
    """What a flawed directory is rejected with."""
    cases = {"none": ["a.json"], "singular": ["conversation.json"], "twice": ["conversations.json", "conversations-0.json"], "number": ["conversations.json"], "good": ["conversations-1.json", "conversations_2.json"]}
    rows = []
    for name, names in cases.items():
        size = F.lit(-1 if name == "number" else 1)
        raw = spark.createDataFrame(list(enumerate(names)), "ordinal int, name string").select("*", size.alias("uncompressed_bytes"), F.lit(1).alias("compressed_bytes"), F.array(F.lit(2026)).alias("zip_timestamp"), F.lit(0).alias("crc"), F.lit(0).alias("compression_method"), F.lit(0).alias("flag_bits"), F.lit(b"").alias("prefix"))
        rows.append((name, _code(discovery.staging_plan, C.classified(raw))))
    return spark.createDataFrame(rows, "case string, code string")


def _code(f, *args, **kw) -> str:
    try:
        f(*args, **kw)
    except CodeError as e:
        return str(e)
    return "none"


@query(_with("SELECT i::INT AS zip_directory_index, c AS \"column\" FROM (SELECT i, unnest(CASE WHEN i % 11 = 4 THEN ['[entry]'] ELSE list_filter([CASE WHEN i % 7 = 3 THEN 'crc32' END, CASE WHEN i % 13 = 5 THEN 'path_sha256' END, CASE WHEN i % 17 = 6 THEN 'zip_timestamp' END], lambda x: x IS NOT NULL) END) AS c FROM k)"))
def directory_changes(spark, d):
    """A directory against one that lost entries and changed checksums, names and times."""
    now = stored(_members(spark, d).drop("prefix"), "members")
    i = F.col("zip_directory_index")
    then = now.where(i % 11 != 4).withColumn("crc32", F.when(i % 7 == 3, "00").otherwise(F.col("crc32"))).withColumn("path_sha256", F.when(i % 13 == 5, "00").otherwise(F.col("path_sha256"))).withColumn("zip_timestamp", F.when(i % 17 == 6, F.array(F.lit(1))).otherwise(F.col("zip_timestamp")))
    return discovery.directory_differences(now, then)


def _ledger(spark: SparkSession, d: str) -> dict:
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 rows
    place = lambda k: f"conversations/conversations-{k:03d}.json" if k % 3 else f"metadata/entry-{k:06d}.json"
    return {"files": {f"entry-{k:06d}": {"status": "verified", "destination": place(k)} for k in keys}}


@query("SELECT n_nationkey::BIGINT AS shard, printf('conversations-%03d.json', n_nationkey) AS name, printf('entry-%06d', n_nationkey) AS entry_id, 'none' AS code FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT * FROM (VALUES (-1, 'empty', '', 'DISCOVERY_LEDGER'), (-1, 'begun', '', 'DISCOVERY_LEDGER_ENTRY'), (-1, 'twice', '', 'DISCOVERY_SHARD_DUPLICATE'), (-1, 'named', '', 'DISCOVERY_SHARD_NAME'), (-1, 'metadata', '', 'DISCOVERY_NO_SHARDS')) v(a, b, c, e)")
def ledger_shards(spark, d):
    """Shards of a ledger with a member for each nation, and what flawed ledgers are rejected with."""
    ledger = _ledger(spark, d)
    rows = [(shard, name, ident, "none") for shard, (name, _, ident) in discovery.shard_files(ledger).items()]
    talk = {"status": "verified", "destination": "conversations/conversations-001.json"}
    flawed = {"empty": {}, "begun": {"x": talk | {"status": "extracting"}}, "twice": ledger["files"] | {"x": talk}, "named": {"x": talk | {"destination": "conversations/talk.json"}}, "metadata": {"x": {"status": "verified", "destination": "metadata/x.json"}}}
    rows += [(-1, name, "", _code(discovery.shard_files, {"files": files})) for name, files in flawed.items()]
    return spark.createDataFrame(rows, "shard long, name string, entry_id string, code string")


@query("WITH s AS (SELECT n_regionkey AS shard, count(*) AS n FROM nation GROUP BY ALL) SELECT 'good' AS \"case\", 'none' AS code, sum(n)::BIGINT AS conversations, count(*) AS shards FROM s UNION ALL SELECT * FROM (VALUES ('state', 'DISCOVERY_MANIFEST_STATE', 0, 0), ('version', 'DISCOVERY_MANIFEST_VERSION', 0, 0), ('total', 'DISCOVERY_SHARD_TOTAL_MISMATCH', 0, 0), ('order', 'DISCOVERY_PER_SHARD_ORDER', 0, 0), ('rows', 'DISCOVERY_SHARDS_ROWS', 0, 0), ('counts', 'DISCOVERY_COUNTS', 0, 0)) v(a, b, c, e)")
def manifest_expectations(spark, d):
    """What a finished run's manifest promises, a shard for each region, and what flawed ones are rejected with."""
    rows = [(r[0], r[1]) for r in table(spark, d, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").collect()]  # 5 rows
    per_shard = [{"shard": s, "conversations": n, "nodes": 2 * n, "messages": n} for s, n in rows]
    total = sum(n for _, n in rows)
    counts = dict.fromkeys(K.METRICS.split(), 0) | {"conversations": total, "nodes": 2 * total, "messages": total}
    good = {"status": "verified_complete", "version": K.INDEX_VERSION, "summary": {"counts": counts, "conversations_with_branches": 0}, "per_shard": per_shard, "shards": [[s, n, "complete"] for s, n in rows]}
    totals, shards = discovery.expectations(good)
    flawed = {"state": good | {"status": "indexing"}, "version": good | {"version": "0"}, "total": good | {"per_shard": [*per_shard[:-1], per_shard[-1] | {"nodes": 0}]}, "order": good | {"per_shard": per_shard[::-1]}, "rows": good | {"shards": good["shards"][1:]}, "counts": good | {"summary": good["summary"] | {"counts": {}}}}
    out = [("good", "none", totals["conversations"], len(shards))] + [(name, _code(discovery.expectations, m), 0, 0) for name, m in flawed.items()]
    return spark.createDataFrame(out, "case string, code string, conversations long, shards long")


# --- small values ----------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) / 1000000 END AS checked, CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' END AS utc FROM events")
def timestamps(spark, d):
    """Checked seconds and their text; null passes."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    seconds = F.when(F.col("event_id") % 4 != 3, micros / 1_000_000)
    rows = table(spark, d, "events").select("event_id", D.checked_timestamp(seconds).alias("checked"))
    return rows.withColumn("utc", D.iso_utc(F.col("checked")))


@query("WITH s AS (SELECT n_regionkey AS k, sum(n_nationkey * 1234567)::BIGINT AS n, count(*) AS c FROM nation GROUP BY ALL) SELECT '| Region | Count | Size | Whole |' AS line UNION ALL SELECT '| --- | --- | --- | --- |' UNION ALL SELECT printf('| %d | %d | %s MB | %s GB |', k, c, format('{:.2f}', n / 1e6), format('{:.3f}', n / 1e9)) FROM s UNION ALL SELECT '2026-01-02 03:04:05'")
def report_lines(spark, d):
    """Sizes, a table and a stamp as reports show them."""
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("c"), F.sum(F.col("n_nationkey") * 1234567).alias("n")).orderBy("n_regionkey").collect()  # 5 rows
    lines = reports.table(["Region", "Count", "Size", "Whole"], [(r["n_regionkey"], r["c"], reports.megabytes(r["n"]), reports.gigabytes(r["n"])) for r in rows]).split("\n")
    return spark.createDataFrame([(x,) for x in [*lines, reports.stamp([2026, 1, 2, 3, 4, 5])]], "line string")


@query("SELECT * FROM (VALUES ('numbered', 'conversations-000.json,conversations_1.json'), ('single', 'conversations.json'), ('mixed', 'conversations.json,conversations-1.json'), ('mixed', '')) v(shape, names)")
def naming_shapes(spark, d):
    cases = ["conversations-000.json,conversations_1.json", "conversations.json", "conversations.json,conversations-1.json", ""]
    return spark.createDataFrame([(M.naming_shape([n for n in x.split(",") if n]), x) for x in cases], "shape string, names string")


_GATES = {
    "unknown key": "CONFIG_VALUE_INVALID", "no object": "CONFIG_NOT_OBJECT", "no JSON": "CONFIG_JSON_INVALID", "no file": "CONFIG_FILE_MISSING", "outside": "CONFIG_PATH_OUTSIDE_WORKSPACE", "no folder": "SOURCE_DIR_NOT_CONFIGURED", "no archive": "SOURCE_ZIP_MISSING", "write": "WRITE_OUTSIDE_WORKSPACE",
    "python": "PYTHON_VERSION_UNSUPPORTED", "python rule": "PYTHON_REQUIREMENTS_INVALID", "disk": "DISK_BUDGET", "pinned root": "WRONG_PROJECT", "lock": "RUN_LOCKED", "two sources": "SOURCE_AMBIGUOUS", "no workspace": "WORKSPACE_MISSING", "redacted": "none", "layers": "none",
}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _GATES.items())}) v(\"case\", code)")
def workspace_gates(spark, d):
    """What a workspace rejects flawed configurations, places and runtimes with."""
    root = _local_folder(spark, "gates")
    put = lambda name, x: (root / name).write_text(x if isinstance(x, str) else json.dumps(x))
    opened = lambda x: (put("more.json", x), workspace.open_workspace(root, str(root / "more.json"), {}))[1]
    (root / "two").mkdir()
    (root / "two/a.zip").touch()
    (root / "two/b.zip").touch()
    plain = opened({})
    shown = json.dumps(plain.summary())
    put("engine_config.json", {"paths": {"outputs": "a"}})
    put("engine_config.local.json", {"paths": {"outputs": "b"}})
    layered = workspace.open_workspace(root, env={}).folder("outputs").name == "b"
    (root / "engine_config.json").unlink()
    (root / "engine_config.local.json").unlink()
    with workspace.RunLock(root / "lock"):
        locked = _code(workspace.RunLock(root / "lock").__enter__)
    found = {
        "unknown key": _code(opened, {"x": 1}), "no object": _code(opened, []), "no JSON": _code(opened, "{"), "no file": _code(workspace.open_workspace, root, str(root / "none.json"), {}), "outside": _code(opened({"paths": {"outputs": "../x"}}).folder, "outputs"),
        "no folder": _code(plain.source_dir), "no archive": _code(opened({"source": {"export_zip": "none.zip"}}).source_zip), "write": _code(plain.inside, "/etc/x"), "python": _code(plain.preflight, (3, 9, 0)), "python rule": _code(workspace.python_satisfies, (3, 12), "~3"), "disk": _code(plain.preflight, free=5),
        "pinned root": _code(opened({"expectations": {"expected_root": "elsewhere"}}).preflight), "lock": locked, "two sources": _code(opened({"source": {"export_dir": "two"}}).only_zip), "no workspace": _code(workspace.open_workspace, root / "no"), "redacted": "none" if str(root) not in shown and str(root) in json.dumps(plain.summary(True)) else "SHOWN", "layers": "none" if layered else "LAYERS",
    }
    return spark.createDataFrame(list(found.items()), "case string, code string")


# --- a whole run -----------------------------------------------------------------------------


def _local_folder(spark: SparkSession, kind: str) -> Path:
    """A workspace's folder: in the shared folder, which has to be a mounted one for that."""
    at = urlparse(new_folder(spark, kind))
    need(at.scheme in ("", "file"), "WORKSPACE_NOT_MOUNTED")
    root = Path(at.path)
    root.mkdir(parents=True)
    return root.resolve()


_SHARDS = f"(SELECT count(DISTINCT floor(conv_id / {made.PER_SHARD})) FROM conversations)"
_REPORTS = "outputs/ARCHIVE_MANIFEST.md outputs/PRIVACY_RISK_REPORT.md outputs/PROCESSING_PLAN.md outputs/ARCHIVE_INVENTORY.json outputs/PHASE1_VALIDATION.json STATUS.md outputs/phase2/preflight.json outputs/phase2/staging_pointer.json outputs/phase2/VALIDATION.json outputs/phase2/run_manifest.json outputs/phase2/STRUCTURAL_SUMMARY.md outputs/phase2/ATTACHMENT_LINKAGE_SUMMARY.md outputs/phase2/DUPLICATE_ASSESSMENT.md outputs/phase2/PARSER_TESTS.json".split()


@query(f"""SELECT 'members' AS item, (SELECT count(*) FROM nation) + 3 + {_SHARDS} AS n UNION ALL SELECT 'conversation files', {_SHARDS} UNION ALL SELECT 'json', 3 + {_SHARDS} UNION ALL SELECT 'samples', len(list_distinct([0, least(1, {_SHARDS} - 1), least(3, {_SHARDS} - 1), {_SHARDS} - 1])) UNION ALL SELECT 'payload headers', (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0)
  UNION ALL SELECT 'brief keeps private', 1 UNION ALL SELECT 'checks passed', 24 UNION ALL SELECT 'staged', 3 + {_SHARDS} UNION ALL SELECT 'staged again', 0 UNION ALL SELECT 'adopted', 1 UNION ALL SELECT 'interrupted', 1 UNION ALL SELECT 'shards when interrupted', 1 UNION ALL SELECT 'shards', {_SHARDS} UNION ALL SELECT 'indexed again', 0
  UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'nodes', count(*) FROM conversations UNION ALL SELECT 'past the end', 1 UNION ALL SELECT 'changed archive', 1 UNION ALL SELECT 'changed staged file', 1 UNION ALL SELECT 'changed code', 1 UNION ALL SELECT 'stray file', 1 UNION ALL SELECT 'safe error', 1 UNION ALL SELECT 'files', {len(_REPORTS)}""")
def whole_run(spark, d):
    """An export archive made from the tables, through inventory, reports, verification, staging and indexing with a crash and a resume, then with tampered files."""
    root = _local_folder(spark, "run")
    (root / "input").mkdir()
    made.export(spark, d, str(root / "input/export.zip"))
    (root / "engine_config.json").write_text(json.dumps({"source": {"export_dir": "input", "export_zip": "input/export.zip"}}))
    ws = workspace.open_workspace(root, env={})
    inv = inventory.inventory(spark, ws)
    facts = reports.phase1_reports(ws, inv)
    need(facts["location"] == hashlib.sha256(inv["source_path"].encode()).hexdigest(), "LOCATION")
    shown = json.dumps(inventory.brief(inv))
    out = {"members": inv["member_count"], "conversation files": len(inv["conversation_files"]), "json": inv["by_extension"][".json"]["count"], "samples": len(inv["schema_samples"]), "payload headers": sum(x["count"] for x in inv["opaque_payload_header_scan"]["formats"].values()), "brief keeps private": int(str(root) not in shown and "sampled_timestamps" not in shown)}
    need(len(sample_positions(len(inv["conversation_files"]))) == out["samples"], "SAMPLES")
    out["checks passed"] = sum(ok for _, ok in verify.verify(spark, ws))
    ledger = staging.stage(spark, ws)
    out["staged"] = sum(r["status"] == "verified" for r in ledger["files"].values())
    times = lambda: {p: p.stat().st_mtime_ns for p in root.glob("staging/*/*/*") if p.is_file()}
    before = times()
    staging.stage(spark, ws)
    out["staged again"] = sum(before[p] != t for p, t in times().items())
    folder = next(root.glob("staging/*"))
    record = json.loads((folder / staging.LEDGER).read_text())
    lost = sorted(record["files"])[0]
    (folder / staging.LEDGER).write_text(json.dumps(record | {"files": {k: v | ({"status": "extracting"} if k == lost else {}) for k, v in record["files"].items()}}))
    out["adopted"] = int(staging.stage(spark, ws)["files"][lost]["status"] == "verified" and times() == before)
    need(_code(indexing.build, spark, ws) == "PARSER_TESTS_REQUIRED", "GATE")
    selftest.record(ws)
    out["interrupted"] = int(_code(indexing.build, spark, ws, interrupt_after=1) == "SYNTHETIC_INTERRUPT")
    progress = json.loads((ws.folder("phase2") / "run_manifest.json").read_text())
    out["shards when interrupted"] = len(progress["shards"]) if progress["status"] == "indexing" else -1
    manifest = indexing.build(spark, ws)
    totals, shards = discovery.expectations(manifest)
    index = indexing.Index(spark, f"{indexing.located(ws.folder('phase2'))}/structural_index")
    out |= {"shards": len(shards), "conversations": totals["conversations"], "nodes": totals["nodes"], "indexed again": len(index.add([s[0] for s in shards], made.conversations(spark, d), made.aliases(spark, d)))}
    out["files"] = sum((root / x).is_file() for x in _REPORTS)
    short = indexing.Index(spark, f"{indexing.located(ws.folder('phase2'))}/short_index")
    rows = made.conversations(spark, d)
    first = sorted(s[0] for s in shards)[0]
    _code(short.add, [first], rows.where("ordinal < 4"), made.aliases(spark, d), batch=2, committed=_Once())
    out["past the end"] = int(_code(short.add, [first], rows.where("ordinal < 1"), made.aliases(spark, d), batch=2) == "CHECKPOINT_PAST_EOF")
    staged = folder / record["files"][lost]["destination"]
    body = staged.read_bytes()
    staged.write_bytes(body + b" ")
    out["changed staged file"] = int(_code(indexing.build, spark, ws) == "STAGING_RESUME_CHANGED")
    try:
        indexing.guarded(ws, staging.stage, spark, ws)
    except SystemExit:
        out["safe error"] = int(json.loads((ws.folder("phase2") / "safe_error.json").read_text()) == {"code": "STAGED_HASH"})
    staged.write_bytes(body)
    (folder / "stray.txt").write_text("x")
    out["stray file"] = int(_code(indexing.build, spark, ws) == "UNEXPECTED_STAGED_FILE")
    (folder / "stray.txt").unlink()
    tests = ws.folder("phase2") / selftest.NAME
    kept = tests.read_text()
    tests.write_text(json.dumps(json.loads(kept) | {"parser_sha256": "0" * 64}))
    out["changed code"] = int(_code(indexing.build, spark, ws) == "PARSER_TESTS_PARSER_HASH")
    tests.write_text(kept)
    with open(root / "input/export.zip", "ab") as f:
        f.write(b"x")
    out["changed archive"] = int(_code(staging.stage, spark, ws) == "SOURCE_STAT")
    return spark.createDataFrame([(k, int(v)) for k, v in out.items()], "item string, n long")


class _Once:
    """Stops a run after its first commit."""

    def __call__(self) -> None:
        raise CodeError("SYNTHETIC_INTERRUPT")
