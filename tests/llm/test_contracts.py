"""Every query against its plain version, on a data folder and on planted edge cases."""

import pytest

from threadloom.llm import queries as Q

from . import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int"}
PASSAGE = "One two three FOUR five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
EDGE = [
    (1, None),
    (2, ""),
    (3, "   \t\n\x0b\x0c\r  "),
    (4, "word " * 60),
    (5, f"Before it. {PASSAGE} After it."),
    (6, f"{PASSAGE}\n" * 3),
    (7, f"Before it. {PASSAGE} After it."),
    (8, "  A Line That Repeats \nshort\nA Line That Repeats"),
    (9, "a line that repeats\t\nshort\nÉtude sur Éa ligne\nétude sur éa ligne"),
    (10, "ΑΣ.Β ΑΣ Ünïcödé İK TEXT with GNU General-Public, License v3 and cc\nby; MIT license mit license 𝒳𝒴 ok"),
    (11, "Étude sur Éa ligne\n" + "long" * 50 + "\n" + "x" * 5000),
    (12, " ".join(f"w{k % 977}q{k}" for k in range(3000))),
    (13, " ".join(f"w{k % 977}q{k}" for k in range(3000) if k % 400)),
    (14, " ".join(f"w{k % 977}q{k}" for k in range(3000) if k % 390 or k < 50)),
    (15, "short item"),
    (16, "a b c short ITEM d <|endoftext|> e\x00f 's don't  it's\n\n  x"),
    (17, "a b c short ITEM d <|endoftext|> e\x00f 's don't  it's\n\n  x"),
    (18, "Apache License apache license APACHE  LICENSE 2.0"),
    (19, "a.b\x00 a q r b\x00 q r b\x00\x00"),
    (20, "a x y a"),
    (21, "b\x00 x y b\x00"),
    (22, "gnu\x00 general mit\x00license apache\x00 license cc\x00by " * 20),
]
ITEMS = [(1, PASSAGE), (2, "short item"), (3, None), (4, " , "), (5, PASSAGE), (6, "six seven eight nine ten eleven twelve thirteen fourteen fifteen after it extra words here")]
PAGES = [(1, "http://a.com/x", "<p>x</p>"), (2, None, None), (3, "http://b.net/es/1", "<p>x</p>"), (4, "ftp//broken", ""), (5, "https://A.Net/es/?q", "é" * 1000), (6, "http://www.example.com/en/a", "é" * 1000)]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edge"))
    rows = {"documents": [(i, t, "en", "s", len(t or "")) for i, t in EDGE], "benchmark": ITEMS, "pages": PAGES, "labels": [(1, 0, 0), (12, 1, 0)]}
    for name, data in rows.items():
        spark.createDataFrame(data, SCHEMA[name]).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMA.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(params=["edge", "small"])
def folder(request, edge):
    return edge if request.param == "edge" else SMALL


def rows(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def result(spark, query, folder, *columns):
    got = query(spark, folder).collect()
    out = {r[0]: tuple(r[c] for c in columns) for r in got}
    assert len(out) == len(got)
    return out


def test_op1(spark, folder):
    got = result(spark, Q.op1_quality_rules, folder, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == brute.op1(rows(spark, folder, "documents", "doc_id", "text"))


def test_op2(spark, folder):
    got = result(spark, Q.op2_license_scan, folder, "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == brute.op2(rows(spark, folder, "documents", "doc_id", "text"))


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    t, start, expected = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json")), 0, {}
    for i, text in sorted(rows(spark, folder, "documents", "doc_id", "text")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert result(spark, Q.op4_token_files, folder, "start", "n_tokens", "ids_crc32") == expected


def test_op5(spark, folder):
    import tiktoken

    from threadloom.llm import bpe

    c = bpe.Codec(Q.tokenizer("byte_bpe_multi_50k.tiktoken"), Q.pattern())
    t, expected = tiktoken.Encoding("own", pat_str=Q.pattern(), mergeable_ranks=c.ranks, special_tokens={}), {}
    for i, text in rows(spark, folder, "documents", "doc_id", "text"):
        ids = t.encode_ordinary(text or "")
        expected[i] = (len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha(text or ""))
    assert result(spark, Q.op5_byte_bpe, folder, "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_op3(spark, folder):
    got = result(spark, Q.op3_decontamination, folder, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.op3(rows(spark, folder, "documents", "doc_id", "text"), rows(spark, folder, "benchmark", "item_id", "text"))


def test_op6(spark, folder):
    got = result(spark, Q.op6_line_dedup, folder, "n_lines", "n_dropped", "kept_sha256")
    assert got == brute.op6(rows(spark, folder, "documents", "doc_id", "text"))


def test_op7(spark):
    import html
    import re

    blocks = re.compile(r"<(?:br|/?p|/?h1)>")
    expected = {}
    for i, page in rows(spark, SMALL, "pages", "page_id", "html"):
        story = blocks.sub(" ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        text = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", story))).strip()
        expected[i] = (text, len(text))
    assert result(spark, Q.op7_html_text, SMALL, "text", "n_chars") == expected


def test_op8(spark, folder):
    got = result(spark, Q.op8_jaccard_join, folder, "n_shingles", "component_id")
    assert got == brute.op8(rows(spark, folder, "documents", "doc_id", "text"))


def test_op9(spark, folder):
    got = result(spark, Q.op9_url_filter, folder, "host", "path", "rule", "verdict")
    expected = brute.op9(rows(spark, folder, "pages", "page_id", "url"))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in expected.items()}
    assert all(v[3] == expected[k][3] for k, v in got.items() if v[2]) and {v[3] for v in got.values()} <= {"allow", "block"}


def test_op10(spark, folder):
    got = result(spark, Q.op10_warc, folder, "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.op10(rows(spark, folder, "pages", "page_id", "html"))


@pytest.mark.parametrize("name", list(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0
