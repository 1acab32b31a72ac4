"""Many small shards: what is read, written and left behind does not grow with their number."""

import json

import pytest

from threadloom.functions.errors import CodeError
from threadloom.operators.index import TABLES, Index
from threadloom.operators.linkage import build_aliases
from threadloom.plans import indexing, inventory, selftest, staging, workspace
from threadloom.sources import zip_members as Z

from .made import node, talk, workspace as made_workspace

N = 40
NONE = build_aliases([], [])


def shard(k):
    return [talk(f"t{k}-{i}", [node("r", None, None), node("a", "r", metadata={"attachments": [{"id": "x"}]})], "a") for i in range(k % 3)]


def files(folder, n=N):
    for k in range(n):
        (folder / f"conversations-{k:03d}.json").write_text(json.dumps(shard(k)))
    return {k: str(folder / f"conversations-{k:03d}.json") for k in range(n)}


def rows(index):
    return {name: sorted(map(repr, index.table(name).collect())) for name in TABLES}


def test_files_share_tasks(spark, tmp_path):
    places = sorted(files(tmp_path).items())
    (tmp_path / "large.json").write_text(json.dumps(shard(2) * 500))
    places.insert(7, (99, str(tmp_path / "large.json")))
    parts = [p.files for p in Z.ArrayReader(places, None, 4).partitions()]
    assert [f for p in parts for f in p] == places and len(parts) <= 8 and [places[7]] in parts
    assert [len(p.files) for p in Z.ArrayReader([], None, 4).partitions()] == [0]
    found = Z.read_arrays(spark, dict(places)).groupBy("shard").count().collect()
    assert dict(map(tuple, found)) == {k: k % 3 for k in range(N) if k % 3} | {99: 1000}


def test_index_files_do_not_grow_with_shards(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    raw = Z.read_arrays(spark, files(tmp_path))
    index.add(list(range(N)), raw, NONE)
    assert index.complete() == set(range(N)) and len(rows(index)["nodes"]) == 2 * sum(k % 3 for k in range(N))
    for name in (*TABLES, "shards"):
        folder = tmp_path / "index" / name
        assert len([p for p in folder.iterdir() if p.is_dir()]) == 1 and len(list(folder.rglob("*.parquet"))) <= 32


def test_commits(spark, tmp_path):
    places = files(tmp_path, 9)
    raw = Z.read_arrays(spark, places)
    whole, index = (Index(spark, f"file://{tmp_path}/{name}") for name in ("whole", "index"))
    whole.add(list(places), raw, NONE)
    for cut in ([0, 1, 2], [2, 5], [2, 5]):
        with pytest.raises(CodeError, match="SYNTHETIC_INTERRUPT"):
            index.add(cut, raw, NONE, interrupt=True)
    assert not any(rows(index).values()) and len(list((tmp_path / "index/nodes").glob("commit=*"))) == 2
    assert index.add([2, 5], raw, NONE, batch=1) == [2, 5] and index.add(list(places), raw, NONE, batch=1) == [0, 1, 3, 4, 6, 7, 8]
    assert rows(index) == rows(whole)
    index.sweep()
    assert rows(index) == rows(whole) and len(list((tmp_path / "index/nodes").glob("commit=*"))) == len(list((tmp_path / "index/shards").glob("commit=*")))
    at = tmp_path / "index"
    for name in (*TABLES, "shards"):  # as a second writer of the same batches would leave it
        one = sorted((at / name).glob("commit=*"))[0]
        (at / name / "commit=z").mkdir()
        for p in one.glob("*.parquet"):
            (at / name / "commit=z" / p.name).write_bytes(p.read_bytes())
    assert rows(index) == rows(whole)


def test_a_build_reads_what_is_left(spark, tmp_path, monkeypatch):
    ws = workspace.open_workspace(made_workspace(tmp_path / "w", [shard(k) for k in (1, 2, 1, 1, 2)]), env={})
    inventory.inventory(spark, ws)
    staging.stage(spark, ws)
    selftest.record(ws)
    asked = []
    read = indexing.read_arrays
    monkeypatch.setattr(indexing, "read_arrays", lambda s, f: (asked.append(sorted(f)), read(s, f))[1])
    with pytest.raises(CodeError, match="SYNTHETIC_INTERRUPT"):
        indexing.build(spark, ws, interrupt_after=2)
    done = indexing.build(spark, ws)
    assert asked == [[0, 1], [2], [2, 3, 4], [0, 1, 2, 3, 4]] and [r["conversations"] for r in done["per_shard"]] == [1, 2, 1, 1, 2]
