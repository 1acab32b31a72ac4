"""Nulls in any column, very long texts, ties, repeated rows, and extra columns whose names the operators use too."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from threadloom.llm import bpe, decontaminate, html_text, jaccard, licenses, lines, quality, token_files, urls, warc
from threadloom.llm import queries as Q
from threadloom.llm._store import new_folder

from . import brute

CLASH = "n_words long, kept string, key long, node string, pivot long, size long, at int, line string, h1 long, doc long, own string, items string, host string, path string, shape string, digest string, held long, n string, html string, url string, component_id long, ids string, count long, label string"
LONG = " ".join(f"w{k}x{k * 7 % 1001}" for k in range(250_000))
COPY = " ".join(f"c{k}" for k in range(300))


def with_clash(df):
    names = [c.split() for c in CLASH.split(", ")]
    return df.select("*", *((F.lit(None) if k % 2 else F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(names) if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, None), (None, COPY), (1, None), (2, ""), (3, COPY), (3, COPY), (3, COPY + " another text of the same id"), (4, LONG), (5, LONG + " end"), (6, "\n" * 5000), (7, "x" * 300_000), (8, "a b"), (8, "a b")]
    return with_clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_row_by_row(spark, docs, plain):
    """Operators that see one text at a time give each row what the plain version gives its text."""
    one = lambda f: sorted(((i, *next(iter(f([(0, t)]).values()))) for i, t in plain), key=repr)
    assert values(quality.judged(docs, "doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == one(brute.op1)
    assert values(licenses.scan(docs, "doc_id"), "doc_id", "n_words") == sorted(((i, brute.op2([(0, t)])[0][0]) for i, t in plain), key=repr)
    bench = spark.createDataFrame([(None, "a b"), (1, " ".join(COPY.split()[10:40])), (1, None)], "item_id long, text string")
    items = [("", "a b"), ("1", " ".join(COPY.split()[10:40]))]
    expected = sorted(((i, *brute.op3([(0, t)], items)[0]) for i, t in plain), key=repr)
    assert values(decontaminate.report(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    path, split = Q.tokenizer("byte_bpe_multi_50k.tiktoken"), Q.pattern()
    out = bpe.decoded(bpe.encoded(docs, "doc_id", path=path, pattern=split), "doc_id", path=path, pattern=split)
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in out.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in plain), key=repr)


def test_lines(docs, plain):
    out = lines.with_kept(docs)
    assert out.count() == len(plain)
    got = {(r["doc_id"], r["text"]): r["__kept"] for r in out.collect()}
    assert got[3, COPY] == COPY and got[None, COPY] == "" and got[6, "\n" * 5000] == "\n" * 5000 and got[1, None] == ""


def test_jaccard(docs, plain):
    got = jaccard.joined(docs, 4, 85)
    assert got.count() == len(plain)
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()} == {(None, 0): None, (None, 297): 3, (1, 0): 1, (2, 0): 2, (3, 297): 3, (3, 303): 3, (4, 249_997): 4, (5, 249_998): 4, (6, 0): 6, (7, 1): 7, (8, 1): 8}


def test_token_files(spark, docs, plain):
    folder = new_folder(spark, "test")
    manifest = token_files.write(docs, folder, Q.tokenizer("word_bpe_49k.json"), shard_bytes=1000, file_tokens=500)
    got = token_files.read(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 8, None, None] and manifest.count() > 3
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:])) and got[0]["n_tokens"] == 1


def test_pages(spark):
    deep = "<div>" * 3000 + "<article><p>text</p></article>"
    rows = [(None, None, None), (1, "http://a.com/x y\r\nz", "<p>one</p>"), (1, "http://a.com/x y\r\nz", "<p>one</p>"), (2, "", "<p>one</p>"), (3, "x://", deep), (4, "http://b.net/es/" + "s/" * 5000, "<article>" + "<p>w</p>" * 20_000), (5, "nourl", "</div></p><<>&#x110000;<!-- <script>"), (6, None, "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = with_clash(pages).repartition(3)
    got = values(html_text.extracted(pages, "page_id", "url"), "page_id", "n_chars")
    assert len(got) == len(rows) and (4, 39_999) in got and (None, 0) in got
    assert values(urls.judged(pages, "page_id"), "page_id", "host") == sorted([(None, ""), (1, "a.com"), (1, "a.com"), (2, ""), (3, ""), (4, "b.net"), (5, ""), (6, "")], key=repr)
    folder = new_folder(spark, "test")
    manifest = warc.write(pages, folder, shard_bytes=1000, file_bytes=500)
    again = warc.write(pages, other := new_folder(spark, "test"), shard_bytes=1000, file_bytes=500)
    assert values(manifest, "name", "sha256") == values(again, "name", "sha256") and other != folder and manifest.count() > 3
    assert values(warc.read(manifest, folder), "page_id", "record_type", "refers_to") == sorted([(None, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)], key=repr)


def test_stages_keep_columns(spark, docs, plain):
    folder = "/root/testdata/sf0.001"
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(plain), name
    assert P.STAGES[-1][1](spark, docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")}), folder).count() == len(plain)


def test_suppression():
    D = licenses.Detection
    found = [D(0, 4, "a", 0.5, 5, False), D(1, 3, "b", 0.5, 4, False), D(2, 6, "c", 0.5, 3, False), D(2, 3, "base", 0.9, 9, True), D(5, 6, "d", 0.9, 2, False), D(8, 9, "e", 0.9, 2, False)]
    assert [d.label for d in licenses.suppressed(found)] == ["a", "base", "c", "e"]
    assert len(licenses.rules()) > 250


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, bad = got.where("quality = 1 and n_words >= 50"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


def test_boosted_trees_held_out():
    import random

    import numpy as np

    from threadloom.llm.dom import HIDDEN

    forest, r, right = html_text.model(), random.Random(99), []
    for _ in range(100):
        nodes, y, _ = html_text.labelled(html_text.made_page(r))
        keep = html_text.decode(nodes, forest.logit(html_text.features(nodes)))
        seen = np.array([n.tag not in HIDDEN for n in nodes])
        right.append((keep[seen] == (y[seen] > 0)).mean())
        assert all(keep[n.parent.index] for n in nodes[1:] if keep[n.index])
    assert np.mean(right) > 0.98


def test_workers_give_back():
    """What BPE keeps in a Python worker goes when another operator runs there, and freed blocks go back to the system."""
    import re

    import numpy as np
    import pyarrow as pa

    from threadloom.llm import _text

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10

    bpe.codec(Q.tokenizer("byte_bpe_multi_50k.tiktoken"), Q.pattern())
    batch = pa.RecordBatch.from_pydict({"__text": ["one text"]})
    assert next(quality._count("__text")(iter([batch])))["n_words"].to_pylist() == [2] and not bpe.codec.cache_info().currsize
    freed = [np.ones(1 << 13, np.int8) for _ in range(20_000)]  # 160 MB in pieces below malloc's mmap threshold
    last, before = freed[-1], held()
    del freed
    list(_text.blocks(batch["__text"]))
    assert len(last) and before - held() > 100


def test_vectored_reads(spark):
    from threadloom.session import VECTORED, ship

    was = spark.conf.get(VECTORED, None)
    try:
        spark.conf.unset(VECTORED)
        ship(spark)
        assert spark.conf.get(VECTORED) == "false"
        spark.conf.set(VECTORED, "true")
        ship(spark)
        assert spark.conf.get(VECTORED) == "true"
    finally:
        spark.conf.set(VECTORED, was or "false")
