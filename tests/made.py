"""A made archive: conversations of many shapes among metadata and payloads."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

CANARY = "canary-of-a-private-text"


def node(name, parent, role="user", text=CANARY, kind="text", children=None, **more):
    message = None if role is None else {"id": f"m-{name}", "author": {"role": role, "metadata": {}}, "create_time": 1.7e9, "update_time": None, "content": {"content_type": kind, "parts": [text]}, "metadata": {}} | more
    out = {"id": name, "parent": parent, "message": message}
    return out if children is None else out | {"children": children}


def talk(ident, nodes, current, **more):
    return {"id": ident, "title": CANARY, "create_time": 1.7e9, "update_time": 1.7e9 + 0.5, "current_node": current, "mapping": {n["id"]: n for n in nodes}} | more


def talks():
    chain = talk("t0", [node("r", None, None, children=["a"]), node("a", "r", children=["b"]), node("b", "a", "assistant", children=[])], "b")
    fork = talk("t1", [node("r", None, None), node("a", "r"), node("b", "a", "assistant"), node("c", "a", "assistant")], "c")
    odd = talk("t2", [node("r", None, None), node("a", "r", "moderator", kind="widget"), node("b", "a", "tool", metadata={"attachments": [{"id": "asset-name", "name": "x"}, {"id": "no-such"}], "other": {"file_id": "file-1"}})], "b")
    pointer = talk("t3", [node("r", None, None), node("a", "r", content={"content_type": "multimodal_text", "parts": [{"asset_pointer": "sediment://payload.dat"}, CANARY]})], "a")
    return [[chain, fork, odd], [pointer, talk("t0", [node("r", None, None), node("x", "r")], "x")]]


def build(path: Path, shards=None) -> Path:
    """Every member stored, one time stamp for all."""
    members: list[tuple[str, bytes]] = [("chat.html", b"<html></html>"), ("user.json", b'{"id": null}')]
    for k, shard in enumerate(talks() if shards is None else shards):
        members.append((f"conversations-{k:03d}.json", json.dumps(shard).encode()))
    members += [(f"{n}.json", b"[]\n") for n in ("settings", "files", "shopping")]
    members.append(("private-draft.png", b"\x89PNG\r\n\x1a\n" + bytes(20)))
    members.append(("names.json", json.dumps({"payload.dat": "asset-name", "payload.bundle": "other-name"}).encode()))
    members.append(("records.json", json.dumps([{"file_id": "file-1", "file_name": "payload.bundle"}]).encode()))
    members.append(("maps.json", json.dumps({"all": {"both": {"files": ["payload.dat", "payload.bundle", 3]}}}).encode()))
    members += [("payload.dat", b"\x89PNG\r\n\x1a\n" + bytes(56)), ("payload.bundle", b"plain" + bytes(59))]
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), body)
    return path


def workspace(root: Path, shards=None) -> Path:
    (root / "input").mkdir(parents=True)
    build(root / "input" / "export.zip", shards)
    (root / "engine_config.json").write_text(json.dumps({"source": {"export_dir": "input", "export_zip": "input/export.zip"}}))
    return root
