"""Whole runs over a made archive."""

import json
import os
import zipfile

import pytest

from threadloom.functions.errors import CodeError
from threadloom.operators import discovery
from threadloom.operators.index import Index
from threadloom.operators.linkage import build_aliases
from threadloom.plans import indexing, inventory, reports, selftest, staging, verify, workspace
from threadloom.streaming import shards as stream

from .made import CANARY, node, talk, talks, workspace as made_workspace


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    return workspace.open_workspace(made_workspace(tmp_path_factory.mktemp("ws") / "w"), env={})


@pytest.fixture(scope="module")
def found(spark, ws):
    return inventory.inventory(spark, ws)


@pytest.fixture(scope="module")
def verified(spark, ws, found):
    reports.phase1_reports(ws, found)
    return verify.verify(spark, ws)


@pytest.fixture(scope="module")
def manifest(spark, ws, verified):
    staging.stage(spark, ws)
    with pytest.raises(CodeError, match="PARSER_TESTS_REQUIRED"):
        indexing.build(spark, ws)
    assert all(selftest.record(ws)["gates"].values())
    with pytest.raises(CodeError, match="SYNTHETIC_INTERRUPT"):
        indexing.build(spark, ws, interrupt_after=1)
    return indexing.build(spark, ws)


def test_inventory(found):
    assert found["member_count"] == 13 and found["by_extension"][".json"]["count"] == 9
    assert sorted(map(len, found["possible_duplicate_member_groups"])) == [3] and found["duplicate_member_name_groups"] == []
    assert found["opaque_payload_header_scan"]["formats"] == {"PNG": {"count": 1, "uncompressed_bytes": 64}, "unidentified": {"count": 1, "uncompressed_bytes": 64}}
    assert found["entries"][7]["safe_name"] == "entry-000007.png" and found["zip_date_min"] == [2026, 1, 1, 0, 0, 0]
    assert len(found["schema_samples"]) == 2 and found["schema_samples"][0]["bounded_graph_check"]["node_count"] == 3
    assert CANARY not in json.dumps(found) and CANARY not in json.dumps(inventory.brief(found))


def test_verification(verified):
    assert len(verified) == 24 and all(ok for _, ok in verified)


def test_index(spark, ws, manifest):
    s = manifest["summary"]
    assert s["counts"]["conversations"] == 5 and s["counts"]["nodes"] == 14 and s["counts"]["messages"] == 9 and s["counts"]["branch_points"] == 1
    assert s["roles"]["user"] == 4 and s["roles"]["assistant"] == 3 and s["roles"]["tool"] == 1 and sum(s["roles"].values()) == 9
    assert s["duplicate_id_groups"] == 1 and s["duplicate_structural_groups"] == 0 and s["conversations_with_branches"] == 1
    assert s["attachments"] == {"resolved": 2, "unresolved": 1, "candidate_filename_join": 1} and s["resolved_payload_members"] == 1
    assert s["date_bounds_utc"]["conversations_update_time"]["max"] == "2023-11-14T22:13:20.500000+00:00" and s["anomalies"] == {}
    assert [r["nodes"] for r in manifest["per_shard"]] == [10, 4]
    total, rows = discovery.expectations(manifest)
    assert total["conversations"] == 5 and len(rows) == 2
    with pytest.raises(CodeError, match="DISCOVERY_SHARD_TOTAL_MISMATCH"):
        discovery.expectations(manifest | {"summary": s | {"counts": s["counts"] | {"nodes": 99}}})
    for p in [*ws.folder("outputs").rglob("*.json"), *ws.folder("outputs").rglob("*.md")]:
        assert CANARY not in p.read_text() and "private-draft" not in p.read_text()
    assert indexing.build(spark, ws)["summary"] == s


def test_tampering(spark, ws, manifest):
    record = ws.folder("phase2") / selftest.NAME
    kept = record.read_text()
    for key, code in (("parser_sha256", "PARSER_TESTS_PARSER_HASH"), ("index_sha256", "PARSER_TESTS_INDEX_HASH")):
        record.write_text(json.dumps(json.loads(kept) | {key: "0" * 64}))
        with pytest.raises(CodeError, match=code):
            indexing.build(spark, ws)
    record.write_text(kept)
    pointer = json.loads((ws.folder("phase2") / "staging_pointer.json").read_text())["relative_root"]
    target = next((ws.root / pointer / "metadata").iterdir())
    body = target.read_bytes()
    target.write_bytes(body + b" ")
    with pytest.raises(CodeError, match="STAGING_RESUME_CHANGED"):
        indexing.build(spark, ws)
    with pytest.raises(SystemExit, match="STAGED_HASH"):
        indexing.guarded(ws, staging.stage, spark, ws)
    assert json.loads((ws.folder("phase2") / "safe_error.json").read_text()) == {"code": "STAGED_HASH"}
    target.write_bytes(body)
    with pytest.raises(AssertionError, match="nothing is staged"):
        verify.verify(spark, ws)


@pytest.mark.parametrize(("names", "code"), [([], "NO_CONVERSATIONS"), (["conversation.json"], "CONVERSATION_NAME"), (["conversations.json", "conversations-0.json"], "SHARD_DUPLICATE")])
def test_plans(spark, tmp_path, names, code):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for n in [*names, "other.json"]:
            z.writestr(n, "[]")
    with pytest.raises(CodeError, match=code):
        discovery.staging_plan(inventory.members_of(spark, str(tmp_path / "x.zip")))


def test_empty_shard_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/conversations-000.json").write_text("[]")
    (tmp_path / "in/conversations-001.json").write_text(json.dumps(talks()[0]))
    index = Index(spark, f"file://{tmp_path}/index")
    for _ in range(2):  # a second run finds nothing new
        q = stream.follow(spark, str(tmp_path / "in"), index, build_aliases([], []), str(tmp_path / "checkpoint"))
        q.awaitTermination()
    assert index.complete() == {0, 1} and index.table("conversations").count() == 3 and index.table("nodes").count() == 10


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    q = stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").groupBy().sum("n").first()[0] == events.count()


def test_source_changes(spark, tmp_path):
    ws = workspace.open_workspace(made_workspace(tmp_path / "w", [[talk("t", [node("a", None)], "a")]]), env={})
    inventory.inventory(spark, ws)
    os.utime(ws.root / "input/export.zip", (1, 1))
    with pytest.raises(CodeError, match="SOURCE_STAT"):
        staging.stage(spark, ws)
    (ws.root / "input/other.txt").write_text("x")
    with pytest.raises(CodeError, match="SOURCE_AMBIGUOUS"):
        inventory.inventory(spark, ws)


def code(f, *args, **kw):
    with pytest.raises(CodeError) as e:
        f(*args, **kw)
    return str(e.value)


def test_configuration(tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("engine_config.json", {"paths": {"outputs": "a"}, "expectations": {"min_free_bytes": 1}})
    put("engine_config.local.json", {"paths": {"outputs": "b"}})
    put("more.json", {"paths": {"outputs": "c"}, "$comment": "x", "profile": None})
    ws = workspace.open_workspace(tmp_path, env={})
    assert ws.folder("outputs").name == "b" and ws.folder("phase2") == ws.root / "b/phase2" and ws.folder("staging").name == "staging"
    assert workspace.open_workspace(tmp_path, env={"ENGINE_CONFIG": str(tmp_path / "more.json")}).folder("outputs").name == "c"
    assert code(workspace.open_workspace, tmp_path, str(tmp_path / "none.json"), {}) == "CONFIG_FILE_MISSING"
    for bad, expected in [("{", "CONFIG_JSON_INVALID"), ([], "CONFIG_NOT_OBJECT"), ({"x": 1}, "CONFIG_VALUE_INVALID"), ({"paths": {"outputs": " "}}, "CONFIG_VALUE_INVALID"), ({"expectations": {"min_free_bytes": True}}, "CONFIG_VALUE_INVALID"), ({"source": {"y": "z"}}, "CONFIG_VALUE_INVALID"), ({"runtime": 1}, "CONFIG_VALUE_INVALID")]:
        put("bad.json", bad)
        assert code(workspace.load_config, tmp_path, str(tmp_path / "bad.json"), {}) == expected
    (tmp_path / "bad.json").write_bytes(b"\xff")
    assert code(workspace.load_config, tmp_path, str(tmp_path / "bad.json"), {}) == "CONFIG_LAYER_UNREADABLE"
    put("engine_config.local.json", {"paths": {"outputs": "../out"}})
    assert code(workspace.open_workspace(tmp_path, env={}).folder, "outputs") == "CONFIG_PATH_OUTSIDE_WORKSPACE"
    assert code(ws.inside, "/etc/x") == "WRITE_OUTSIDE_WORKSPACE" and code(ws.source_dir) == "SOURCE_DIR_NOT_CONFIGURED" and code(ws.source_zip) == "SOURCE_ZIP_NOT_CONFIGURED"
    assert code(workspace.open_workspace, tmp_path / "no") == "WORKSPACE_MISSING" and code(workspace.open_workspace, tmp_path / "more.json") == "WORKSPACE_NOT_DIRECTORY"
    assert "paths" not in ws.summary() and ws.summary(True)["paths"]["root"] == str(ws.root) and str(tmp_path) not in json.dumps(ws.summary())


def test_preflight(tmp_path):
    ws = workspace.open_workspace(tmp_path, env={})
    ws.preflight()
    assert code(ws.preflight, (3, 9, 0)) == "PYTHON_VERSION_UNSUPPORTED" and code(ws.preflight, free=5) == "DISK_BUDGET"
    (tmp_path / "engine_config.json").write_text(json.dumps({"expectations": {"expected_root": "elsewhere"}}))
    assert code(workspace.open_workspace(tmp_path, env={}).preflight) == "WRONG_PROJECT"
    ok = workspace.python_satisfies
    assert ok((3, 12, 1), ">=3.12,<3.15") and not ok((3, 15, 0), "<3.15") and ok((3, 12, 0), "==3.12") and ok((3, 12, 1), "!=3.12, >3")
    assert code(ok, (3, 12), "~3") == code(ok, (3, 12), " , ") == "PYTHON_REQUIREMENTS_INVALID"
    with workspace.RunLock(tmp_path / "lock"):
        assert code(workspace.RunLock(tmp_path / "lock").__enter__) == "RUN_LOCKED"


def test_command_line(capsys):
    from threadloom.__main__ import main

    assert main([]) == 0 and main(["nonsense"]) == 2 and "threadloom" in capsys.readouterr().out
