"""Provenance of the decoder and the index: their own gates are tried, and their code's digests recorded.

Indexing asks for a record that passed and was made by the code that runs now.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from ..functions.errors import CodeError, need
from ..operators.conversations import forest, index_rows, timestamp
from ..sources import strict_json
from .workspace import Workspace, atomic_write

NAME = "PARSER_TESTS.json"
PARSER, INDEX = ("sources/strict_json.py", "operators/conversations.py"), ("operators/index.py", "operators/linkage.py", "operators/summary.py", "operators/checks.py", "functions/digests.py", "functions/constants.py")


def code_sha256(names: tuple[str, ...]) -> str:
    here = Path(__file__).resolve().parents[1]
    return hashlib.sha256(b"".join(hashlib.sha256((here / n).read_bytes()).digest() for n in names)).hexdigest()


def _code(f, *args) -> str:
    try:
        out = f(*args)
        list(out) if hasattr(out, "__next__") else out
    except CodeError as e:
        return str(e)
    return "none"


def gates() -> dict[str, bool]:
    """What each gate has to say about a small bad input, and a good one."""
    items = lambda raw: _code(strict_json.array_items, [raw])
    expected = {b'[{"a":1,"a":2}]': "JSON_DUPLICATE_KEY", b"[NaN]": "JSON_NONFINITE", b"[1": "JSON_INCOMPLETE", b"{}": "JSON_ARRAY_REQUIRED", b"[] 1": "JSON_TRAILING", b"[1,]": "JSON_TRAILING_COMMA", b"[,]": "JSON_EMPTY_ELEMENT", b"[}]": "JSON_BRACKET", b'["\xff"]': "JSON_INVALID", b"[1, [2], {}]": "none"}
    out = {f"array {code}": items(raw) == code for raw, code in expected.items()}
    out["timestamp"] = _code(timestamp, "1") == "TIMESTAMP_FORMAT" and timestamp(1) == 1.0
    out["conversation"] = _code(forest, {}) == "CONVERSATION_SCHEMA" and _code(forest, {"mapping": {"a": 1}}) == "NODE_SCHEMA"
    ring = forest({"mapping": {"a": {"id": "a", "parent": "b"}, "b": {"id": "b", "parent": "a"}}, "current_node": "a"})
    out["cycle"] = ring["cycles"] == 1 and ring["cycle_nodes"] == 2 and not ring["active_valid"]
    canary = "a value that stays inside"
    rows = index_rows({"id": canary, "mapping": {canary: {"id": canary, "parent": None, "message": {"author": {"role": canary}, "content": {"parts": [canary]}}}}, "current_node": canary}, 0, 0)
    out["no value in rows"] = canary not in json.dumps({k: rows[k] for k in ("conversation", "nodes")})
    return out


def record(ws: Workspace) -> dict:
    found = gates()
    out = {"pass": all(found.values()), "gates": found, "parser_sha256": code_sha256(PARSER), "index_sha256": code_sha256(INDEX)}
    atomic_write(ws, ws.folder("phase2") / NAME, out)
    return out


def required(ws: Workspace) -> dict:
    """The record, if it passed and is of this code."""
    path = ws.folder("phase2") / NAME
    found = json.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}
    need(found.get("pass") is True, "PARSER_TESTS_REQUIRED")
    need(found.get("parser_sha256") == code_sha256(PARSER), "PARSER_TESTS_PARSER_HASH")
    need(found.get("index_sha256") == code_sha256(INDEX), "PARSER_TESTS_INDEX_HASH")
    return found
