"""Codes and counts of single operators."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import classify as C
from threadloom.functions import digests as D
from threadloom.functions.errors import CodeError, safe_code
from threadloom.operators import conversations as V
from threadloom.operators import forest, linkage, sample
from threadloom.sources import strict_json as J

from .made import node, talk


def code(f, *args):
    with pytest.raises(CodeError) as e:
        out = f(*args)
        list(out) if hasattr(out, "__iter__") else out
    return str(e.value)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (b'[{"a":1,"a":2}]', "JSON_DUPLICATE_KEY"), (b"[NaN]", "JSON_NONFINITE"), (b"[1e999]", "JSON_NONFINITE"), (b"[-Infinity]", "JSON_NONFINITE"),
        (b'[{"a":1}', "JSON_INCOMPLETE"), (b"[1", "JSON_INCOMPLETE"), (b"", "JSON_INCOMPLETE"), (b"[", "JSON_INCOMPLETE"), (b'["\xff"]', "JSON_INVALID"), (b'["\x00"]', "JSON_INVALID"), (b"[1 2]", "JSON_INVALID"),
        (b"{}", "JSON_ARRAY_REQUIRED"), (b"\xef\xbb\xbf[]", "JSON_ARRAY_REQUIRED"), (b"[] x", "JSON_TRAILING"), (b"[1] [", "JSON_TRAILING"), (b"[1,]", "JSON_TRAILING_COMMA"), (b"[,1]", "JSON_EMPTY_ELEMENT"), (b"[1,,2]", "JSON_EMPTY_ELEMENT"), (b"[1,  ,2]", "JSON_EMPTY_ELEMENT"),
        (b"[}]", "JSON_BRACKET"), (b"[" + b"[" * 300 + b"]", "JSON_DEPTH_LIMIT"),
    ],
)
@pytest.mark.parametrize("size", [1, 3, 100])
def test_strict_arrays(text, expected, size):
    assert code(J.array_items, [text[i : i + size] for i in range(0, len(text), size)]) == expected


def test_element_limit():
    assert code(J.array_items, [b'["' + b"x" * 50 + b'"]'], J.ArrayFramer(max_bytes=20)) == "JSON_ELEMENT_LIMIT"


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=4), st.integers(1, 7), st.booleans())
def test_arrays_round_trip(values, size, ascii_only):
    raw = json.dumps(values, ensure_ascii=ascii_only, indent=1).encode("utf-8", "surrogatepass")
    if "\\ud" in json.dumps(values) and not ascii_only:
        return
    assert list(J.array_items([raw[i : i + size] for i in range(0, len(raw), size)])) == values


@pytest.mark.parametrize("value", ["1", True, float("inf"), 253402300800, -62135596801, 10**400])
def test_timestamps(value):
    assert code(V.timestamp, value) == "TIMESTAMP_FORMAT"


def test_digests(spark):
    assert D.enum_value("x", {"y"}) == "unknown:" + D.digest("x") and D.enum_value(None, ()) == "missing"
    assert D.canonical({"b": 1.5, "a": ["é", None]}) == '{"a":["\\u00e9",null],"b":1.5}'
    row = spark.createDataFrame([('["é", 1.0, null]', 'a"\\b')], "j string, s string").select(D.digest_json("j"), D.digest_list("k", 3, D.quoted(F.col("s"))), D.open_enum(F.col("s"), ["z"])).first()
    assert tuple(row) == (D.digest(["é", 1.0, None]), D.digest(["k", 3, 'a"\\b']), D.enum_value('a"\\b', ["z"]))
    times = spark.createDataFrame([(0.0,), (1.5,), (253402300799.0,), (None,)], "t double").select(D.iso_utc(D.checked_timestamp(F.col("t")))).collect()
    assert [r[0] for r in times] == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", "9999-12-31T23:59:59+00:00", None]
    with pytest.raises(Exception, match="TIMESTAMP_FORMAT"):
        spark.createDataFrame([(1e18,)], "t double").select(D.checked_timestamp(F.col("t"))).collect()


def test_names(spark):
    rows = [("Conversations-003.JSON", 0), ("a/b\\chat.html", 1), ("../../secret.txt", 2), ("/abs.pem", 3), ("C:x.png", 4), (".env", 5), ("backup-code.json", 6), ("noext", 7), ("x.tar.GZ", 8), ("dir/", 9), ("conversations.json", 10), ("x.averyverylongext", 11)]
    df = spark.createDataFrame(rows, "name string, ordinal int").select(C.safe_name(F.col("name"), F.col("ordinal")), C.extension(F.col("name")), C.risk_flags(F.col("name"), F.lit(1)), C.is_conversation(F.col("name")), C.shard_id(F.col("name")))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["Conversations-003.JSON", "chat.html", "entry-000002.txt", "entry-000003.pem", "entry-000004.png", "entry-000005[other]", "entry-000006.json", "entry-000007[other]", "entry-000008.gz", "entry-000009[other]", "conversations.json", "entry-000011[other]"]
    private, name, path, locked = "potential-private-content-container", "sensitive-name-pattern", "unsafe-extraction-path", "encrypted-entry"
    assert got[2][2] == [private, name, path, locked] and got[3][2] == [private, path, locked] and got[4][2] == [path, locked] and got[5][2] == [name, locked] and got[6][2] == [private, name, locked]
    assert [g[3] for g in got].count(True) == 2 and [g[4] for g in got][0] is None and got[10][4] == 0


HEADERS = [(b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff\xe0", "JPEG"), (b"GIF89a", "GIF"), (b"RIFF1234WEBP", "WebP"), (b"RIFF1234WAVE", "WAV"), (b"RIFF1234AVI ", "AVI"), (b"OggS", "Ogg container"), (b"fLaC", "FLAC"), (b"ID3", "ID3 audio candidate"), (b"\xff\xfb", "MPEG audio candidate"), (b"1234ftyp", "ISO-BMFF media container"), (b"\x1aE\xdf\xa3", "Matroska/WebM container"), (b"%PDF-1", "PDF"), (b"PK\x03\x04", "ZIP-family container"), (b"SQLite format 3\x00", "SQLite"), (b"\xd0\xcf\x11\xe0", "OLE compound document"), (b"\x1f\x8b", "gzip container"), (b"", "unidentified"), (b"\xff\x1f", "unidentified")]


def test_headers(spark):
    df = spark.createDataFrame([(bytearray(h), k) for k, (h, _) in enumerate(HEADERS)], "h binary, k int")
    assert [r[0] for r in df.orderBy("k").select(C.header_format(F.col("h"))).collect()] == [x for _, x in HEADERS]


GRAPHS = {
    "node_id_mismatch": ({"a": {"id": "b", "parent": None}}, "a"), "missing_parent_field": ({"a": {"id": "a"}}, "a"), "invalid_parent_type": ({"a": {"id": "a", "parent": 3}}, "a"), "missing_parent": ({"a": {"id": "a", "parent": "z"}}, "a"),
    "multiple_roots": ({"a": {"id": "a", "parent": None}, "b": {"id": "b", "parent": None}}, "a"), "no_root": ({"a": {"id": "a", "parent": "a"}}, "a"), "invalid_children": ({"a": {"id": "a", "parent": None, "children": 1}}, "a"), "children_mismatch": ({"a": {"id": "a", "parent": None, "children": ["q"]}}, "a"),
    "cycles": ({"a": {"id": "a", "parent": "b"}, "b": {"id": "b", "parent": "a"}}, "a"), "missing_current_node": ({"a": {"id": "a", "parent": None}}, None), "invalid_current_node": ({"a": {"id": "a", "parent": None}}, "z"), "invalid_active_path": ({"a": {"id": "a", "parent": "a"}}, "a"),
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_anomalies(name):
    mapping, current = GRAPHS[name]
    assert V.forest({"mapping": mapping, "current_node": current})["anomalies"][name] == 1


def test_schema_gates():
    assert code(V.forest, []) == code(V.forest, {"mapping": []}) == "CONVERSATION_SCHEMA"
    assert code(V.forest, {"mapping": {"a": 1}}) == "NODE_SCHEMA" and code(V.forest, {"mapping": {"a": {"message": "x"}}}) == "MESSAGE_SCHEMA"
    assert code(V.index_rows, talk("t", [node("a", None, content=[1])], "a"), 0, 0) == "MESSAGE_CONTENT_SCHEMA"


def test_forests_agree(spark):
    """The tables' operators and the one that sees a whole conversation, on random links."""
    r, rows, current, expected = random.Random(3), [], [], {}
    for c in range(40):
        n = r.randint(1, 14)
        mapping = {}
        for k in range(n):
            parent = r.choice([None, *range(n), "far"]) if r.random() < 0.8 else (k - 1 if k else None)
            mapping[str(k)] = {"id": str(k), "parent": None if parent is None else str(parent)}
            if r.random() < 0.3:
                mapping[str(k)]["children"] = [str(r.randrange(n)) for _ in range(r.randint(0, 2))]
        at = r.choice([None, "zz", str(r.randrange(n)), str(n - 1)])
        shape = V.forest({"mapping": mapping, "current_node": at})
        valid = shape["active_valid"]
        expected[c] = (n, shape["roots"], shape["branch_points"], shape["extra_branches"], shape["leaves"], len(shape["active"]), n - len(shape["active"]) if valid else 0, 0 if valid else n, shape["cycle_nodes"], {k: v for k, v in shape["anomalies"].items()})
        current.append((c, at))
        rows += [(c, k, v["parent"], v.get("children"), "list" if "children" in v else "absent") for k, v in mapping.items()]
    nodes = spark.createDataFrame(rows, "conv int, node string, parent string, child_list array<string>, child_kind string")
    out = forest.metrics(nodes, spark.createDataFrame(current, "conv int, node string"))
    got = {x["conv"]: (x["nodes"], x["roots"], x["branch_points"], x["extra_branches"], x["leaves"], x["active_nodes"], x["alternative_nodes"], x["unclassified_path_nodes"], x["cycle_nodes"], x["anomalies"]) for x in out.collect()}
    assert {k: v[:9] for k, v in got.items()} == {k: v[:9] for k, v in expected.items()}
    assert {k: {a: n for a, n in v[9].items() if a != "cycles"} for k, v in got.items()} == {k: {a: n for a, n in v[9].items() if a != "cycles"} for k, v in expected.items()}


def test_references():
    value = {"metadata": {"attachments": [{"id": "a", "name": "b"}, "bare", {"file_id": "f"}], "url": "no"}, "files": "direct", "content": {"parts": [{"asset_pointer": "p"}]}, "attachment": {"path": "q", "deep": [[{"url": "u"}]]}}
    assert [(k, v) for _, k, v in V.references(value)] == [("attachment_field", "a"), ("file_id", "f"), ("asset_pointer", "p"), ("attachment_field", "q"), ("attachment_field", "u")]


def test_resolution(spark):
    a = linkage.build_aliases(["p.dat", "q.bundle", "r.png"], [{"p.dat": "one"}, {"m": {"two": {"files": ["p.dat", "q.bundle"]}}}, [{"file_id": "f", "file_name": "q.bundle"}, {"file_id": 3}], {"one": "again"}])
    assert a.stats == {"metadata_files_scanned": 4, "aux_alias_records": 2, "manifest_mapping_records": 1, "file_metadata_records": 1}
    refs = spark.createDataFrame([(k, v) for k, v in enumerate(["sediment://one", "two", "f", "nothing", "r.png", "p.dat", "file-service://again"])], "k int, value string")
    alias, methods, candidates = a.tables(spark)
    known = linkage.resolved(refs, alias, methods, candidates, ["k"])
    links = {}
    for r in linkage.targets(known, alias, candidates, ["k"]).collect():
        links.setdefault(r["k"], []).append(r["entry_ordinal"])
    got = {r["value"]: (r["resolution"], sorted(links.get(r["k"], [])), r["method"]) for r in known.collect()}
    assert all(r["n_targets"] == len(links.get(r["k"], [])) for r in known.collect())
    assert got == {"sediment://one": ("resolved", [0], "explicit_aux_alias"), "two": ("ambiguous", [0, 1], "explicit_mapping_candidates"), "f": ("candidate_filename_join", [1], "unverified_filename_join"), "nothing": ("unresolved", [], "none"), "r.png": ("unresolved", [], "none"), "p.dat": ("resolved", [0], "exact_zip_path"), "file-service://again": ("resolved", [0], "explicit_aux_alias")}


def test_sample():
    raw = b'\xef\xbb\xbf[{"title":"x","secret":[1,null,"s"],"mapping":{"k":{"message":{"author":{"role":"user"},"create_time":1700000000.5}}},"create_time":12}, {"id": 12'
    s = sample.schema_sample(raw, 1000)
    assert s["root_type"] == "array" and s["paths"]["$[].[other-key][]"] == ["null", "number", "string"] and s["paths"]["$[].mapping.*.message.author.role"] == ["string"]
    assert s["observed_roles"] == ["user"] and s["sampled_timestamp_min"] == "2023-11-14T22:13:20.500000+00:00" and len(s["sampled_timestamps"]) == 1 and "$[].id" not in s["paths"]
    assert s["bounded_graph_check"]["node_count"] == 1 and not s["bounded_graph_check"]["current_node_resolves"] and not s["entire_member_read"]


def test_safe_codes():
    assert safe_code(J.JsonError("JSON_INVALID")) == "JSON_INVALID" and safe_code(KeyError("private")) == "KeyError"
    assert safe_code(RuntimeError("threadloom.functions.errors.GateError: NODE_SCHEMA\n at x")) == "NODE_SCHEMA"
