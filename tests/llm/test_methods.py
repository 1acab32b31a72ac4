"""The methods themselves against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from threadloom.llm import licenses, quality, urls
from threadloom.llm import queries as Q

from . import brute
from .test_contracts import EDGE, edge, rows  # noqa: F401

SF = "/root/testdata/sf0.01"


def _shape(path):
    out = []
    for s in [x for x in path.split("/") if x]:
        ending = (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0]
        out.append("#" + ending if re.search(r"^[0-9]+(\.[A-Za-z]{1,5})?$", s) else "*" + ending if re.search("[0-9]", s) or len(s) > 24 else s)
    return tuple(out)


def _templates(pages):
    """Template and purity of each URL, with plain loops over one host at a time."""
    judged = brute.op9(pages)
    hosts = defaultdict(list)
    for i, (host, path, rule, verdict) in judged.items():
        hosts[host].append((i, _shape(path), rule is not None, verdict == "block"))
    labelled = sum(x[2] for h in hosts.values() for x in h)
    blocked = sum(x[2] and x[3] for h in hosts.values() for x in h)
    share, out = blocked / max(1, labelled), {}
    drawn = lambda b, l, to: (b + urls.WEIGHT * to) / (l + urls.WEIGHT)  # noqa: E731, E741
    kin = lambda s: "?" if re.fullmatch("[A-Za-z]{1,3}", s) else "*"
    for host, mine in hosts.items():
        shape = {i: s for i, s, _, _ in mine}
        label = {i: (a, a and b) for i, _, a, b in mine}
        tally = lambda own: (sum(label[i][0] for i in own), sum(label[i][1] for i in own))  # noqa: E731, B023
        template = {i: () for i in shape}
        for level in range(max(map(len, shape.values()), default=0)):
            places = defaultdict(list)
            for i in shape:
                if level < len(shape[i]):
                    places[template[i]].append(i)
            for at, here in places.items():
                seg = {i: shape[i][level] for i in here}
                ends = any(template[i] == at and len(shape[i]) == level for i in shape)
                follow = {i: shape[i][level + 1] if level + 1 < len(shape[i]) else "/" for i in here}
                named, first = {}, {}
                for s in set(seg.values()):
                    first[s] = max((n, f) for f, n in Counter(follow[i] for i in here if seg[i] == s).items())[1]
                for s in set(seg.values()):
                    named[s] = s
                    if s[:1] in "#*" or (len(set(seg.values())) == 1 and not ends):
                        continue
                    own, kind = [i for i in here if seg[i] == s], [i for i in here if seg[i][:1] not in "#*" and (kin(seg[i]), first[seg[i]]) == (kin(s), first[s])]
                    if len(own) == len(kind):
                        continue
                    mix, every = Counter(follow[i] for i in own), Counter(follow[i] for i in kind)
                    apart = sum(abs(n / len(own) - every[f] / len(kind)) for f, n in mix.items()) / 2
                    (a, b), (L, B) = tally(own), tally(kind)
                    near = a == 0 or abs(b / a - B / L) <= 1.96 * math.sqrt(B / L * (1 - B / L) * (1 / a + 1 / L)) + 1e-9
                    if near and apart <= urls.ALIKE:
                        named[s] = kin(s)
                for i in here:
                    template[i] += (named[seg[i]],)
        hl, hb = tally(shape)
        of_host = drawn(hb, hl, share)
        for t in set(template.values()):
            up_l, up_b = tally([i for i in template if template[i][:-1] == t[:-1]])
            own = [i for i in template if template[i] == t]
            a, b = tally(own)
            purity = drawn(b, a, drawn(up_b, up_l, of_host))
            for i in own:
                out[i] = ("/" + "/".join(t), round(purity, 6), judged[i][3] or ("block" if purity >= urls.REJECT and a >= urls.MIN_LABELLED else "allow"))
    return out


def test_url_templates(spark, edge):  # noqa: F811
    for folder in (SF, edge):
        expected = _templates(rows(spark, folder, "pages", "page_id", "url"))
        got = {r["page_id"]: r for r in Q.op9_url_filter(spark, folder).collect()}
        assert {i: (r["template"], r["verdict"]) for i, r in got.items()} == {i: (t, v) for i, (t, _, v) in expected.items()}
        assert all(abs(r["purity"] - expected[i][1]) < 2e-6 for i, r in got.items())


def test_gates_lose_no_rule(spark, edge):  # noqa: F811
    """Keywords and hashes only save time: all rules over all texts find the same."""
    for folder in (SF, edge):
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in Q.op2_license_scan(spark, folder).collect()}
        for i, text in rows(spark, folder, "documents", "doc_id", "text"):
            if i in got and (len(text or "") < 4000):
                found = licenses.detect((text or "").encode(), list(licenses.rules()))
                assert got[i] == (",".join(sorted({d.label for d in found})), round(1 - math.prod(1 - d.weight for d in found), 6))


def _said(pattern):
    """Some texts that a pattern matches: every group left out or with each of its choices, all others with the first."""
    import re._parser as parser

    def texts(items):
        out = [""]
        for op, v in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(v)]
            elif name == "IN":
                more = [chr(x[1]) if str(x[0]) == "LITERAL" else chr(x[1][0]) if str(x[0]) == "RANGE" else "9" for x in v if str(x[0]) != "NEGATE"] if str(v[0][0]) != "NEGATE" else ["w"]
            elif name == "NOT_LITERAL":
                more = ["w"]
            elif name == "SUBPATTERN":
                more = texts(v[3])
            elif name == "BRANCH":
                more = [t for x in v[1] for t in texts(x)]
            elif name == "MAX_REPEAT":
                more = ([""] if v[0] == 0 else []) + [t * max(1, v[0]) for t in texts(v[2])]
            elif name.startswith("ASSERT"):
                more = [""]
            else:
                raise AssertionError(name)
            first = out[0]
            out = [x + more[0] for x in out] + [first + m for m in more[1:]]
        return out

    return texts(parser.parse(pattern))


def test_rules_hold_their_keyword():
    assert len(licenses.rules()) > 250
    for r in licenses.rules():
        for text in _said(r.pattern.pattern):
            assert r.pattern.search(f" {text} "), (r, text)
            assert set(r.keywords) & set(text.split()), (r, text)
            assert any(d.start == 0 for d in licenses.detect(text.encode(), list(licenses.rules()))), (r, text)


def test_joined_forms():
    found = lambda t: ",".join(d.label for d in licenses.detect(t.encode(), list(licenses.rules())))
    assert found("GPLv3, LGPLv2.1 and AGPLv3+") == "gpl-3,lgpl-2.1,agpl-3"
    assert found("under the Apache License, Version 2.0.") == "apache-2.0,apache"
    assert [d.weight for d in licenses.detect(b"the apache license version 2", list(licenses.rules())) if d.base] == [0.0]
    assert [(d.label, d.weight) for d in licenses.detect(b"an apache license", list(licenses.rules()))] == [("apache", 0.9)]


def test_suppression_of_random_intervals():
    import random

    r, D = random.Random(2), licenses.Detection
    for _ in range(500):
        found = [D(a, a + r.randint(1, 6), f"l{k}", 0.5, 9 if base else r.randint(2, 8), base) for k in range(r.randint(0, 12)) for a in [r.randint(0, 12)] for base in [r.random() < 0.2]]
        kept = [d for d in found if d.base]
        for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
            if not any(k.start <= d.start and k.end >= d.end for k in kept):
                kept.append(d)
        weight = lambda d: 0.0 if d.base and any(not k.base and k.start <= d.start and k.end >= d.end for k in kept) else d.weight  # noqa: E731, B023
        assert licenses.suppressed(found) == sorted(d._replace(weight=weight(d)) for d in kept)
    assert [d.label for d in licenses.suppressed([D(5, 7, "a", 0.5, 8, False), D(3, 9, "b", 0.5, 5, False), D(3, 6, "c", 0.5, 4, False)])] == ["b", "a"]


def test_words_that_end_in_zero_bytes():
    from threadloom.llm import _text as X

    w = X.words([b"a b\x00 b\x00\x00 \x00 " + b"x" * 64 + b" " + b"x" * 65 + b" a"], X.NOT_WHITE, lower=False)
    h = X.hashes(w)
    assert len(set(h.tolist())) == 6 and h[0] == h[-1]
    first, back = X.distinct(w)
    assert [w.word(first[k]) for k in back] == [w.word(k) for k in range(len(back))] and len(first) == 6


def test_encoder_and_library_agree():
    import json
    import random

    from tokenizers import Tokenizer

    from threadloom.llm.token_files import WordEncoder, cuts_hold

    path, r = Q.tokenizer("word_bpe_49k.json"), random.Random(5)
    spec = json.load(open(path, encoding="utf-8"))
    assert cuts_hold(spec) and not cuts_hold(spec | {"normalizer": None}) and not cuts_hold(json.load(open(Q.tokenizer("byte_bpe_50k.json"), encoding="utf-8")))
    signs = [*"abcAB zé\x00\x01.,'!<|>#$%&-/_~019 \n\t\x0b\x1c\x85\xa0İß漢😀\u0301\u200b", "<|endoftext|>", "'s", "don't", "b\x00"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e, t = WordEncoder(Q.tokenizer(name)), Tokenizer.from_file(Q.tokenizer(name))
        ids, counts = e.encode([x.encode() for x in texts])
        ends = np.cumsum(counts)
        for x, n, end in zip(t.encode_batch_fast(texts, add_special_tokens=False), counts, ends):
            assert ids[end - n : end].tolist() == x.ids


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.85
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(r.random(len(good)) < 0.2, 0, np.where((r.random(len(good)) < p) == good, 1, -1)) for p in right], 1)
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    prior, weights = quality.estimate(patterns, times.astype(float))
    posterior = prior + sum(np.choose(votes[:, k] + 1, weights[k]) for k in range(len(right)))
    assert ((posterior > 0) == good).mean() > 0.95 and (weights[:-1, 2] > weights[1:, 2] - 0.2).all()
    assert quality.estimate(np.zeros((0, 5), int), np.zeros(0))[0] == 0


def test_verdicts_follow_the_votes(spark):
    """The posterior in the JVM is the one of plain Bayes over the fitted weights."""
    out = quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    names = [c for c in out.columns if c.startswith("vote_")]
    fit = out[~out["base_failed"]].groupby(names).size().reset_index()
    prior, weights = quality.estimate(fit[names].to_numpy(np.int8), fit[0].to_numpy(float))
    logit = prior + sum(np.choose(out[c].to_numpy() + 1, weights[k]) for k, c in enumerate(names))
    assert np.allclose(out["p_good"], 1 / (1 + np.exp(-logit)))
    assert (out["kept"] == (~out["base_failed"] & (out["p_good"] >= 0.5))).all() and len(EDGE) > 0


def test_tiles_of_a_bucket(spark, monkeypatch):
    """Members of a mixed bucket, in blocks and tiles of any size, give the pairs that plain bounds leave."""
    from threadloom.llm import jaccard as J

    r = np.random.default_rng(5)
    sizes = r.integers(200, 420, 60)
    base = r.integers(0, 2**63, 420, np.uint64)
    sets = [np.concatenate([base[: n - n // 9], r.integers(0, 2**63, n // 9, np.uint64)]) for n in sizes]
    bits = []
    for s, n in zip(sets, sizes):
        length = 1 << int(np.ceil(np.log2(n)))
        flips = np.bincount((s & np.uint64(length - 1)).astype(int), minlength=length) & 1
        bits.append(np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64).tolist())
    root = [k % 7 for k in range(60)]
    known = spark.createDataFrame([(k, int(n), b) for k, (n, b) in enumerate(zip(sizes, bits))], "node long, size long, bits array<long>")
    members = spark.createDataFrame([(1, k, root[k]) for k in range(60)] + [(2, k, root[k]) for k in range(5)], "key long, node long, root long")
    mixed = spark.createDataFrame([(1, 60), (2, 5)], "key long, all long")
    raw = [int.from_bytes(np.array(b).tobytes(), "little") for b in bits]
    expected = set()
    for i in range(60):
        for j in range(i):
            w = min(len(bits[i]), len(bits[j])) * 64
            fold = [x if len(bits[k]) * 64 == w else (x >> w) ^ (x & ((1 << w) - 1)) for k, x in ((i, raw[i]), (j, raw[j]))]
            n, m = int(sizes[i]), int(sizes[j])
            if root[i] != root[j] and 80 * max(n, m) <= 100 * min(n, m) and 180 * (fold[0] ^ fold[1]).bit_count() <= 20 * (n + m):
                expected.add((i, j))
    assert len(expected) > 20
    for block, tile in ((4096, 512), (7, 3), (20, 64)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "TILE", tile)
        assert {tuple(x) for x in J.compared(members, mixed, known, 80).collect()} == expected


def test_shards_are_balanced_whatever_the_ids(spark):
    """Ids far from the others, many of one id, and nulls: shards ascend with the id and hold no more than their bytes, but for one id's rows."""
    from threadloom.llm._shards import by_shard, range_sharded

    ids = [*range(0, 4000, 2), 2**62, -(2**63), *[77] * 50, None, None, *(2**40 + k for k in range(500)), *(2**20 * k for k in range(300))]
    df = spark.createDataFrame([(i, 100) for i in ids], "id long, size long").repartition(5)
    sharded, n = range_sharded(df, "id", "size", 1000)
    rows = [tuple(r) for r in sharded.select("__shard", "id").collect()]
    assert sorted((i is None, i or 0) for _, i in rows) == sorted((i is None, i or 0) for i in ids)
    by = {}
    for s, i in rows:
        by.setdefault(s, []).append(2**63 - 1 if i is None else i)
    assert sorted(by) == list(range(n)) and all(max(by[s]) < min(by[s + 1]) for s in range(n - 1))
    assert all(len(x) <= 10 or len(set(x)) == 1 for x in by.values()) and n < 2.5 * len(ids) / 10
    assert by_shard((sharded, n), "id").rdd.getNumPartitions() == n
    assert {tuple(r) for r in range_sharded(df.repartition(2), "id", "size", 1000)[0].select("__shard", "id").collect()} == set(rows)


def test_decontamination_without_broadcast(spark, edge):  # noqa: F811
    from threadloom.llm import decontaminate

    for folder in (edge, "/root/testdata/sf0.001"):
        docs, bench = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
        expected = brute.op3(rows(spark, folder, "documents", "doc_id", "text"), rows(spark, folder, "benchmark", "item_id", "text"))
        got = {r[0]: tuple(r[1:]) for r in decontaminate.report(docs, bench, broadcast_bytes=0).collect()}
        assert got == expected


def test_bitmaps_rule_out_only_what_is_not_there(spark):
    from pyspark.sql import functions as F

    from threadloom.llm._sql import bitmap, marked, met
    from threadloom.llm._store import stored

    docs = spark.range(5000).select(F.col("id"), F.xxhash64("id").alias("h"))
    found = stored(docs.where("id % 97 = 3").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.lit("x").alias("__what")), "found")
    seen = marked(docs, F.col("h"), bitmap(found, "__h"), "near")
    assert seen.where("near AND id % 97 = 3").count() == found.count() and seen.where("near").count() < 100
    left = met(docs, F.col("h"), found, F.col("id") == F.col("__id"), "__h", "left")
    assert left.count() == 5000 and left.where("__what = 'x'").count() == found.count()
    assert met(docs, F.col("h"), found, F.col("id") == F.col("__id"), "__h", "left_anti").count() == 5000 - found.count()


def test_bpe_waves():
    """Pieces' ids are those of a plain loop; a rank is looked up for each pair of a wave, not for each merge."""
    import random

    from threadloom.llm import bpe

    def plain(piece, ranks):
        parts = [bytes([x]) for x in piece]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[x] for x in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    c, r = bpe.Codec(Q.tokenizer("byte_bpe_multi_50k.tiktoken"), Q.pattern()), random.Random(7)
    syllables = ["an", "tion", "ou", "è", "ß", "sch", "aa", "a", "ción", "的", "😀", "th", "\x00", " "]
    pieces = {"".join(r.choices(syllables, k=r.choice((1, 2, 3, 5, 8, 40)))) for _ in range(4000)} | {"a" * n for n in range(1, 90)}
    asked, rank = [], c.merges.rank
    c.merges.rank = lambda pair: asked.append(pair) or rank(pair)
    c.learn({p for p in pieces if len(p.encode()) <= bpe.WAVE})
    merges = sum(len(p.encode()) - len(ids) // 4 for p, ids in c.known.items())
    assert len(asked) < merges / 2
    c.learn(pieces)
    assert {p: list(memoryview(ids).cast("I")) for p, ids in c.known.items()} == {p: [t] if (t := c.ranks.get(p.encode())) is not None else plain(p.encode(), c.ranks) for p in pieces}
    assert max(len(p.encode()) for p in pieces) > bpe.WAVE
