"""The pipeline against the plain versions of its stages."""

import corpus_pipeline as P
from threadloom.llm import quality

from . import brute
from .test_contracts import PASSAGE, SCHEMA


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def _lines(docs):
    texts = dict(docs)
    split = {i: [(x, brute.re.sub(rf"^{brute.BLANK}+|{brute.BLANK}+\\Z", "", x).translate(brute.AZ)) for x in t.split("\n")] for i, t in docs}
    where = {}
    for i in sorted(texts):
        for _, key in split[i]:
            if len(key) >= 10:
                where.setdefault(key, i)
    kept = {i: "\n".join(x for x, key in rows if len(key) < 10 or where[key] == i) for i, rows in split.items()}
    return {i: t for i, t in kept.items() if t == texts[i] or t.strip(" \t\n\x0b\x0c\r")}


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    good = P.quality_rules(spark, docs, folder)
    assert good.columns == names
    judged = {r["doc_id"]: r["kept"] for r in quality.judged(docs, "doc_id").collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, kept in judged.items() if kept}
    lined = P.line_dedup(spark, good, folder)
    assert lined.columns == names and dict(_rows(lined)) == _lines(_rows(good))
    single = P.jaccard_join(spark, lined, folder)
    groups = brute.op8(_rows(lined), 5, 80)
    assert single.columns == names and {i for i, _ in _rows(single)} == {i for i, (_, c) in groups.items() if c == i}
    clean = P.decontamination(spark, single, folder)
    hits = brute.op3(_rows(single), [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()])
    assert clean.columns == names and {i for i, _ in _rows(clean)} == {i for i, h in hits.items() if not h[4]}
    same = dict(_rows(single))
    assert all(t == same[i] for i, t in _rows(clean) if not hits[i][1])
    out = {r["doc_id"]: r for r in P.byte_bpe(spark, clean, folder).collect()}
    assert {i: r["decoded_sha256"] for i, r in out.items()} == {i: brute.sha(t) for i, t in _rows(clean)}
    assert {r["doc_id"] for r in P.run(spark, folder).select("doc_id").collect()} == set(out)


def test_spans_are_cut(spark):
    own = " ".join(f"own{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{own}, {PASSAGE}; rest of it.", "en", "s", 0), (2, PASSAGE, "en", "s", 0), (3, own, "en", "s", 0)], SCHEMA["documents"])
    bench = spark.createDataFrame([(1, PASSAGE)], SCHEMA["benchmark"])
    from threadloom.llm import decontaminate

    assert dict(_rows(decontaminate.cleaned(docs, bench))) == {1: f"{own}, rest of it.", 3: own}


def test_extra_columns_and_nulls(spark):
    schema = "doc_id long, text string, n_words int, kept string, key long, node string, n_chars long, __text string"
    long = " ".join(f"good{k % 50}thing{k}" for k in range(120))
    docs = spark.createDataFrame([(None, long, 1, "a", 2, "b", 3, "c"), (1, None, None, None, None, None, None, None), (2, long, 1, "a", 2, "b", 3, "c"), (2, long, 1, "a", 2, "b", 3, "c")], schema)
    folder = "/root/testdata/sf0.001"
    assert P.quality_rules(spark, docs, folder).count() == 3
    lined = P.line_dedup(spark, docs, folder)
    assert sorted((r["doc_id"] or 0, r["node"] or "") for r in lined.collect()) == [(1, ""), (2, "b"), (2, "b")]
    assert sorted((r["doc_id"] or 0, r["node"] or "") for r in P.jaccard_join(spark, docs, folder).collect()) == [(1, ""), (2, "b")]  # one row of the group
    assert P.decontamination(spark, docs, folder).columns == docs.columns
