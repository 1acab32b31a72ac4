"""N-gram Jaccard join by parity sketches, to connected components.

A document is its set of distinct word shingles, as 64-bit hashes. Documents with equal
sets are one class, found by a hash of the set, so copies cost one row each.

Candidates. Two sets of sizes a <= b that link have |A xor B| <= a (100 - p) / p. Tokens are
dealt by hash into bands, and a band's parity sketch is the XOR of its tokens' hashes: a
64-bit sketch that changes with any token. At most one band differs for each token of the
symmetric difference, so with d + 1 + e bands, linked sets agree in e + 1 bands at least
(pigeonhole). Bands of no more than one token, which unrelated documents may share, are
left out by a document with at most e of them; e + 1 agreeing bands hold another one then.
The number of bands depends on a size band: levels of ratio ``RATIO``; a document near the
lower end of its level also takes part in the level below, so any two sizes that can link
meet in one level.

Filter and check. A second sketch has one bit flip for each token; its Hamming distance is at
most the symmetric difference and drops nearly all false candidates, as its bits are a power of
two no less than the set's size. Halves of a larger sketch XOR to the smaller one's length. What
is left is compared exactly, shingle by shingle.

Hot buckets. Documents that share a band's sketch are a bucket. Each is first compared to
one pivot of its bucket: where rows of a bucket meet in a map task, to that task's pivot, so
a bucket sends one row for each map task's chunk to the shuffle. Linked pairs become
components; a bucket whose members are all in one component is done. In the others, new
pivots are taken, round by round, and at last members of different components are compared
with each other, so no link between components is lost. Pairs within a component are
never listed. Before that, a document leaves all its buckets of more than ``HOT`` members
whose low and hot bands of a level are no more than e together: of e + 1 agreeing bands,
one is neither then, and its bucket is compared whole. So documents that share a passage
meet only if it is most of each of them.

Edge cases: without words (null or empty text) a set is empty and linked with nothing;
with fewer words than a shingle, the whole sequence is the only shingle; a null
``doc_id`` is never the smallest; repeated rows and rows with one id but other texts come
back each, with their text's component; an empty table gives no rows. Hashes are of 64
bits: two different sets are one class with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._sql import met, partitions
from ._store import discard, release, stored

MIN_BITS, RATIO, SPARE = 256, 1.3, 0.2
#: Keys in one chunk of a map task, texts in one block.
CHUNK, TEXTS = 1 << 20, 2048
#: Members of a block of a large bucket, and of a tile of its matrix.
BLOCK, TILE = 4096, 128
#: Ids of a broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A table of so many rows is one partition.
SMALL = 100_000
#: A bucket of more members is hot.
HOT = 256


class Sets(NamedTuple):
    """Distinct shingles of a block: ``flat[first[i]:first[i + 1]]`` are those of text i."""

    flat: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i + 1]]


def shingles(texts: list[bytes], n: int, seed: int = 0) -> Sets:
    w = X.words(texts, X.NOT_WHITE, lower=True)
    h, text, counts = X.hashes(w, seed), w.text_of_word(), w.counts()
    own = np.flatnonzero(X.whole(w, n))
    keys, of = X.windows(h, n)[own], text[own]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        more = np.array([X.windows(h[w.first[i] : w.first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        keys, of = np.concatenate([keys, more]), np.concatenate([of, short])
    salt = X.mix((of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    at = np.unique(keys ^ salt, return_index=True)[1]
    at = at[np.argsort(of[at], kind="stable")]
    return Sets(keys[at], np.concatenate(([0], np.cumsum(np.bincount(of[at], minlength=len(texts))))))


def set_hashes(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which do not depend on order."""
    out = []
    for factor in (0xC6BC279692B5C323, 0xD1342543DE82EF95):
        sums = np.zeros(len(s.flat) + 1, np.uint64)
        np.cumsum(X.mix((s.flat ^ np.uint64(factor >> 1)) * np.uint64(factor)), out=sums[1:])
        sizes = np.diff(s.first).astype(np.uint64)
        out.append(X.mix(sums[s.first[1:]] - sums[s.first[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    return out[0], out[1]


class Levels(NamedTuple):
    low: np.ndarray  # smallest size of each level
    high: np.ndarray
    bands: np.ndarray  # 0: only equal sets link
    spare: np.ndarray


@cache
def levels(percent: int) -> Levels:
    ratio, low, high = max(RATIO, 105 / percent), [], []
    at = 1
    while at < 1 << 40:
        low.append(at)
        high.append(max(at, int(at * ratio)))
        at = high[-1] + 1
    differ = np.array([x * (100 - percent) // percent for x in high])
    spare = np.ceil(SPARE * differ).astype(np.int64) + 1
    return Levels(np.array(low), np.array(high), np.where(differ > 0, differ + 1 + spare, 0), spare)


def _keys(s: Sets, mixed: np.ndarray, text: np.ndarray, level: np.ndarray, lv: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and key of each band that takes part, and how many hot bands each text may leave; ``level`` -1: none for this text.

    A key's lowest bit is that of its level.
    """
    m = np.where(level >= 0, lv.bands[level], 0)
    at = np.concatenate(([0], np.cumsum(m)))
    live = m[text] > 0
    t, h = text[live], mixed[live]
    band = (((h >> np.uint64(32)) * m[t].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    slot = at[t] + band
    sketch = np.zeros(at[-1], np.uint64)
    np.bitwise_xor.at(sketch, slot, X.mix(h * np.uint64(0xA24BAED4963EE407)))
    held = np.bincount(slot, minlength=at[-1])
    of = np.repeat(np.arange(len(m)), m)
    low = held <= 1
    n_low = np.bincount(of[low], minlength=len(m))
    take = ~low | (n_low > lv.spare[level])[of]
    number = (np.arange(at[-1]) - at[of]).astype(np.uint64) * np.uint64(1 << 8) + level[of].astype(np.uint64)
    keys = X.mix(sketch ^ X.mix(number + np.uint64(0x5851F42D4C957F2D))) & ~np.uint64(1) | (level[of] & 1).astype(np.uint64)
    return of[take], keys[take], np.where(m > 0, lv.spare[level] - n_low, -1)


def sketched(texts: list[bytes], n: int, percent: int) -> dict:
    """Of each text: size, class (``node``) and what tells it from others (``check``), bit sketch in 64-bit words, band keys, and spare bands by a level's lowest bit."""
    s, lv = shingles(texts, n), levels(percent)
    sizes = np.diff(s.first)
    text = np.repeat(np.arange(len(texts)), sizes)
    mixed = X.mix(s.flat ^ np.uint64(0x9E6C63D0876A9A35))
    node, check = set_hashes(s)
    length = np.maximum(MIN_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(length)))
    flips = np.bincount(at[text] + (mixed & (length[text] - 1).astype(np.uint64)).astype(np.int64), minlength=at[-1]) & 1
    bits = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)
    level = np.searchsorted(lv.low, sizes, "right") - 1
    fresh = np.zeros(len(texts), bool)
    fresh[np.unique(np.stack([node, check], 1), axis=0, return_index=True)[1]] = True
    level = np.where(fresh, level, -1)
    below = np.where((level > 0) & (percent * sizes <= 100 * lv.high[level - 1]), level - 1, -1)
    parts = [_keys(s, mixed, text, x, lv) for x in (level, below)]
    of, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(of, kind="stable")
    even = [np.where(x & 1 == 0, p[2], -1) for x, p in zip((level, below), parts)]
    odd = [np.where(x & 1 == 1, p[2], -1) for x, p in zip((level, below), parts)]
    spare = np.stack([np.maximum(*even), np.maximum(*odd)], 1)
    return {"sizes": sizes, "node": node, "check": check, "spare": spare, "bits": bits, "words": length // 64, "keys": keys[order].view(np.int64), "counts": np.bincount(of, minlength=len(texts))}


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for first, texts in X.blocks(column):
        for k in range(0, len(texts), TEXTS):
            yield first + k, texts[k : k + TEXTS]


def sketches(docs: DataFrame, n: int, percent: int, *keep: str, node_bits: int = 64) -> DataFrame:
    """(doc_id, size, node, check, spare, bits, keys) of each row, and the columns ``keep``; node is null for an empty set. ``node_bits``: of a node's hash, for tests."""
    cut = -1 << (64 - node_bits)

    def lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.forget()
        for b in batches:
            for first, texts in _pieces(b["text"]):
                x = sketched(texts, n, percent)
                node = pa.array(x["node"] & cut, mask=x["sizes"] == 0)
                spare = lists(np.full(len(texts), 2), x["spare"].astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, len(texts)), pa.array(x["sizes"].astype(np.int64)), node, pa.array(x["check"]), spare, lists(x["words"], x["bits"]), lists(x["counts"], x["keys"]), *(b[c].slice(first, len(texts)) for c in keep)], names=["doc_id", "size", "node", "check", "spare", "bits", "keys", *keep])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("size", T.LongType()), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("spare", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())), *(docs.schema[c] for c in keep)])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def _collapse(heads: bool):
    """Of each chunk of a map task: with ``heads`` each key's smallest node, else its other nodes with that one as pivot."""

    def out(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v = k[new], v[new]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        if heads:
            table = pa.RecordBatch.from_arrays([pa.array(k[head]), pa.array(v[head])], names=["key", "node"])
        else:
            pivot = v[np.flatnonzero(head)][np.cumsum(head) - 1]
            table = pa.RecordBatch.from_arrays([pa.array(x[~head]) for x in (k, v, pivot)], names=["key", "node", "pivot"])
        for a in range(0, table.num_rows, 1 << 16):
            yield table.slice(a, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for b in batches:
            lists = b["keys"]
            n = np.diff(lists.offsets.to_numpy())
            keys.append(lists.flatten().to_numpy())
            nodes.append(np.repeat(b["node"].fill_null(0).to_numpy(), n))
            held += len(keys[-1])
            if held > CHUNK:
                yield from out(keys, nodes)
                keys, nodes, held = [], [], 0
        if held:
            yield from out(keys, nodes)

    return run


def buckets(t: DataFrame) -> DataFrame:
    """(key, node, pivot) of each member of a bucket but its pivots' own; a bucket's pivots are members too.

    Chunks are collapsed twice, which is cheap, so that only keys and their smallest nodes are
    shuffled.
    """
    rows = t.select("node", "keys").where(F.size("keys") > 0)
    heads = rows.mapInArrow(_collapse(True), "key long, node long")
    heads = heads.withColumn("pivot", F.min("node").over(Window.partitionBy("key"))).where(F.col("node") != F.col("pivot"))
    return heads.unionByName(rows.mapInArrow(_collapse(False), "key long, node long, pivot long"))


def _folded(a: Column, n: Column) -> Column:
    """A sketch at the length of n words, which is its own or half of it."""
    half = F.zip_with(F.slice(a, 1, n), F.slice(a, n + 1, n), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(a) == n, a).otherwise(half)


def _hamming(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    a, b = _folded(a, n), _folded(b, n)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def may_link(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Sizes and Hamming distance leave room for a link."""
    small, large = F.least(n, m), F.greatest(n, m)
    return (100 * small >= percent * large) & ((100 + percent) * _hamming(a, b) <= (100 - percent) * (n + m))


def classes(t: DataFrame) -> DataFrame:
    """(node, size, bits, spare, rep, check, other): rep is the smallest doc_id of the class; ``other`` isn't ``check`` where two classes share a node.

    Spares are the greatest, as rows whose keys a block leaves out have none.
    """
    spare = F.array(*(F.max(F.get("spare", F.lit(k))) for k in (0, 1))).alias("spare")
    return t.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bits").alias("bits"), spare, F.min("check").alias("check"), F.max("check").alias("other"))


def told_apart(t: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches and classes in which no two classes share a node: all but the one of the least check get other nodes, again until none does."""
    while not (twins := known.where("check <> other").select("node", F.col("check").alias("least"))).isEmpty():
        other = F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        t = stored(t.join(twins, "node", "left").withColumn("node", other).select(*t.columns), "sketches")
        known = stored(classes(t), "classes")
    return t, known


def candidates(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, pivot) of distinct ``pairs`` that may link."""
    a = known.select(F.col("node"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    b = known.select(F.col("node").alias("pivot"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    both = pairs.select("node", "pivot").distinct().join(a, "node").join(b, "pivot")
    return both.where(may_link(F.col("size_a"), F.col("size_b"), F.col("bits_a"), F.col("bits_b"), percent)).select("node", "pivot")


def _fitting(a: dict, b: dict, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of pairs of different components that may link; each pair once if both are the same members."""
    n, m = a["size"][:, None], b["size"][None, :]
    fits = (a["root"][:, None] != b["root"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if same:
        fits &= np.arange(len(a["size"]))[:, None] < np.arange(len(b["size"]))[None, :]
    i, j = np.nonzero(fits)
    words = np.minimum(a["words"][i], b["words"][j])
    apart = np.zeros(len(i), np.int64)
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        x, y = a["folded"](w)[i[own]], b["folded"](w)[j[own]]
        apart[own] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)  # of signed numbers it counts the absolute value's bits
    good = (100 + percent) * apart <= (100 - percent) * (a["size"][i] + b["size"][j])
    return i[good], j[good]


def _members(rows: list[tuple]) -> dict:
    """Columns of (node, root, size, bits) rows; ``folded(w)`` gives sketches of w words, those that are shorter as zeros."""
    size, words = np.array([r[2] for r in rows]), np.array([len(r[3]) for r in rows])
    held: dict[int, np.ndarray] = {}

    def folded(w: int) -> np.ndarray:
        if w not in held:
            held[w] = out = np.zeros((len(rows), w), np.int64)
            for k, r in enumerate(rows):
                if len(r[3]) >= w:
                    out[k] = np.bitwise_xor.reduce(np.asarray(r[3]).reshape(-1, w), axis=0)
        return held[w]

    return {"node": np.array([r[0] for r in rows]), "root": np.array([r[1] for r in rows]), "size": size, "words": words, "folded": folded}


def compared(members: DataFrame, mixed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, pivot): pairs in one bucket (key, node, root) but not in one component that may link.

    A bucket of more than ``BLOCK`` members is dealt into blocks, and each two blocks meet in a
    task of their own; sketches are compared as matrices, ``TILE`` members at a time.
    """
    sized = members.select("key", "node", "root").join(mixed.select("key", F.ceil(F.col("all") / BLOCK).cast("int").alias("k")), "key")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("k")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    dealt = sized.withColumn("mine", mine).withColumn("p", F.explode(others)).select("key", "node", "root", "mine", "p.i", "p.j")
    ready = dealt.join(known.select("node", "size", "bits"), "node")
    ordered = ready.repartition(partitions(members), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(group: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, i, j = group
        sides = [[r[1:] for r in rows if r[0] == x] for x in ((i,) if i == j else (i, j))]
        for p in range(0, len(sides[0]), TILE):
            a = _members(sides[0][p : p + TILE])
            for q in range(p if i == j else 0, len(sides[-1]), TILE):
                same = i == j and p == q
                b = a if same else _members(sides[-1][q : q + TILE])
                x, y = _fitting(a, b, percent, same)
                if len(x):
                    u, v = a["node"][x], b["node"][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["node", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            keys = zip(b["key"].to_pylist(), b["i"].to_pylist(), b["j"].to_pylist())
            bits = b["bits"]
            values, at = bits.flatten().to_numpy(), (bits.offsets.to_numpy() - bits.offsets[0].as_py()).tolist()
            for k, (g, mine_, node, root, size) in enumerate(zip(keys, b["mine"].to_pylist(), b["node"].to_pylist(), b["root"].to_pylist(), b["size"].to_pylist())):
                if g != group:
                    if len(rows) > 1:
                        yield from pairs(group, rows)
                    group, rows = g, []
                rows.append((mine_, node, root, size, values[at[k] : at[k + 1]]))
        if len(rows) > 1:
            yield from pairs(group, rows)

    return ordered.mapInArrow(run, "node long, pivot long").distinct()


def _texts(docs: DataFrame, nodes: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(node, text) of the classes in ``nodes``; documents are read again, and only those of the classes' smallest ids go on."""
    need = stored(nodes.join(known.select("node", "rep", "check"), "node"), "needed")
    ids = need.select("rep").distinct()
    side = F.broadcast(ids) if need.count() <= BROADCAST_IDS else ids
    chosen = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _pieces(b["text"]):
                _, check = set_hashes(shingles(texts, n))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, len(texts)), pa.array(check), b["text"].slice(first, len(texts))], names=["doc_id", "own", "text"])

    found = chosen.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("own", T.LongType()), T.StructField("text", T.StringType())]))
    both = found.join(need, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("check")))
    return both.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose sets link, compared exactly."""
    pairs = stored(pairs, "candidates")
    texts = _texts(docs, pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct(), known, n)
    texts = stored(texts, "candidate-texts")
    both = pairs.join(texts.withColumnRenamed("text", "text_a"), "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("text_b")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                good = np.ones(part.num_rows, bool)
                for seed in (0, 1):  # what two hashes of all shingles agree on
                    sides = [[s.of(i) for _, texts in X.blocks(part[c]) for s in [shingles(texts, n, seed)] for i in range(len(texts))] for c in ("text_a", "text_b")]
                    common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)]
                    good &= [100 * c >= percent * (len(x) + len(y) - c) for x, y, c in zip(*sides, common)]
                yield pa.RecordBatch.from_arrays([part["node"], part["pivot"]], names=["node", "pivot"]).filter(pa.array(good))

    return stored(both.select("node", "pivot", "text_a", "text_b").mapInArrow(run, "node long, pivot long"), "links")


def _compact(df: DataFrame, kind: str) -> tuple[DataFrame, bool]:
    """``df`` stored; of no more than ``SMALL`` rows in one partition, so that what follows needs no shuffle; and whether it is empty."""
    df = stored(df, kind)
    n = df.count()
    return (df.coalesce(1) if n <= SMALL else df), n == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in ``links`` (node, pivot): the least node of its component.

    Each label hangs itself below its least neighbour; pointer jumping flattens this forest,
    edges between labels are contracted, and so on until none is left. Counts only reach
    the driver.
    """
    edges, roots = links.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct(), None
    while True:
        edges, none = _compact(edges, "edges")
        if none:
            break
        up = edges.groupBy("u").agg(F.min("v").alias("up"))
        tops = edges.select(F.col("v").alias("u"), F.col("v").alias("up")).distinct().join(up.select("u"), "u", "left_anti")
        up = up.unionByName(tops).withColumn("moved", F.lit(True))
        while True:
            up, _ = _compact(up, "forest")
            if up.where("moved").isEmpty():
                break
            over = up.select(F.col("u").alias("_u"), F.col("up").alias("_up"))
            up = up.join(over, F.col("up") == F.col("_u")).select("u", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved"))
        up = up.select("u", "up")
        if roots is None:
            roots = up.select(F.col("u").alias("node"), F.col("up").alias("root"))
        else:
            roots = roots.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("up", "root").alias("root"))
        roots, _ = _compact(roots, "roots")
        a, b = up.select(F.col("u"), F.col("up").alias("a")), up.select(F.col("u").alias("v"), F.col("up").alias("b"))
        edges = edges.join(a, "u").join(b, "v").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return roots if roots is not None else links.select("node", F.col("pivot").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more ``links``: only what these join is worked out again."""
    own, other = roots.select("node", F.col("root").alias("a")), roots.select(F.col("node").alias("pivot"), F.col("root").alias("b"))
    new = links.join(own, "node", "left").join(other, "pivot", "left").select(F.coalesce("a", "node").alias("node"), F.coalesce("b", "pivot").alias("pivot"))
    moved = components(new.where(F.col("node") != F.col("pivot"))).select(F.col("node").alias("label"), F.col("root").alias("to"))
    # labels that were no root before are nodes seen for the first time
    both = roots.join(moved, F.col("root") == F.col("label"), "full")
    return _compact(both.select(F.coalesce("node", "label").alias("node"), F.coalesce("to", "root").alias("root")).distinct(), "roots")[0]


def without_hot(open_: DataFrame, mixed: DataFrame, known: DataFrame, hot: int) -> DataFrame:
    """``open_`` (key, node) without the rows in hot buckets of those whose hot bands of a level are no more than they may leave."""
    heavy = stored(open_.join(mixed.where(F.col("all") > hot).select("key"), "key").withColumn("bit", F.col("key").bitwiseAND(F.lit(1)).cast("int")), "hot-buckets")
    times = heavy.groupBy("node", "bit").agg(F.count("*").alias("times")).join(known.select("node", "spare"), "node")
    leave = times.where(F.col("times") <= F.get("spare", F.col("bit"))).select("node", "bit")
    gone = stored(heavy.join(leave, ["node", "bit"], "left_semi").select("key", "node"), "left-buckets")
    return open_ if gone.isEmpty() else stored(open_.join(gone, ["key", "node"], "left_anti"), "cooled-buckets")


def joined(docs: DataFrame, n: int, percent: int, *keep: str, hot: int = HOT, node_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, node, root, component_id) of each row of ``docs`` (doc_id, text), and its columns ``keep``; ``root`` names the component."""
    spark = docs.sparkSession
    sketched_ = stored(sketches(docs, n, percent, *keep, node_bits=node_bits), "sketches")
    sketched_, known = told_apart(sketched_, stored(classes(sketched_), "classes"))
    t = stored(sketched_.select("doc_id", "size", "node", *keep), "sizes")
    members = stored(buckets(sketched_), "buckets")
    discard(sketched_)
    release(spark)
    roots = components(verified(candidates(members, known, percent), docs, known, n, percent))
    open_ = members.select("key", "node").unionByName(members.select("key", F.col("pivot").alias("node"))).distinct()
    before = float("inf")
    for turn in count():
        release(spark)
        labelled = open_.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        parts = labelled.groupBy("key", "root").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)), "node"))["node"].alias("lead"))
        mixed = parts.groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"), F.max(F.struct("m", "lead"))["lead"].alias("pivot"), F.count("*").alias("parts")).where(F.col("parts") > 1)
        mixed = stored(mixed, "mixed-buckets")
        left = mixed.agg(F.sum("all").alias("rows"), F.sum((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs")).first()
        if not left["rows"]:
            break
        # buckets in one component are done and go
        labelled = stored(labelled.join(mixed.select("key", "pivot"), "key"), "open-buckets")
        open_ = labelled.select("key", "node")
        if not turn and not mixed.where(F.col("all") > hot).isEmpty():
            open_ = without_hot(open_, mixed, known, hot)
            continue
        # new pivots as long as they leave far fewer pairs to compare
        last = left["pairs"] <= 8 * left["rows"] or left["pairs"] > before / 2
        before = left["pairs"]
        if last:
            pairs = compared(labelled, mixed, known, percent)
        else:
            pivots = labelled.where(F.col("node") == F.col("pivot")).select("key", F.col("root").alias("pivot_root"))
            pairs = candidates(labelled.join(pivots, "key").where(F.col("root") != F.col("pivot_root")).select("node", "pivot"), known, percent)
        more = verified(pairs, docs, known, n, percent)
        if not more.isEmpty():
            roots = merged(roots, more)
        if last:
            break
    release(spark)
    whole = known.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "root").select("node", "root", "component_id")
    out = t.select("doc_id", F.col("size").alias("n_shingles"), "node", *keep).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", "node", "root", F.coalesce("component_id", "doc_id").alias("component_id"), *keep)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, and of such with one id that of the least hash of its text.

    Ids that are null come last. A row goes by its id and a hash of its text, so other texts of
    the same id, or without one, stay; of rows with one id and text one stays. Rows without
    words are in no component and stay.
    """
    own = F.xxhash64("text")
    found = stored(joined(docs.select("doc_id", "text", own.alias("__hash")), n, percent, "__hash").where(F.col("node").isNotNull()).select("root", "doc_id", "__hash"), "components")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__hash")
    several = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("root", "first")
    rows = found.join(several, "root").groupBy("doc_id", "__hash").agg(F.count("*").alias("rows"), F.bool_or(place == F.col("first")).alias("stays"))
    rows = stored(rows.select(F.col("doc_id").alias("__id"), F.col("__hash"), "rows", "stays"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__hash"))
    kept = met(docs, own, stored(rows.where("NOT stays").select("__id", "__hash"), "gone"), same, "__hash", "left_anti")
    repeated = stored(rows.where("stays AND rows > 1").select("__id", "__hash"), "repeated")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(repeated, same, "left_semi").groupBy("doc_id", own).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("__doc"))
    return kept.join(repeated, same, "left_anti").unionByName(once.select("__doc.*"))
