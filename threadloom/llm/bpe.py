"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pieces of a block of texts are a corpus of byte sequences. An inverted
index leads from each pair of neighbouring tokens to the places that hold it. Pieces
replay their merges in waves: in each, a pair of the index merges wherever it is its
piece's leftmost of the lowest rank, and only the pairs of the new neighbours are indexed
again. A piece of more than ``WAVE`` bytes would need too many waves: for those, pairs
leave a heap in order of their rank, and a merge visits all places of its pair. Encoded
pieces are kept by the Python worker, so later blocks replay merges for new pieces only.

Scale: a narrow pass, one task's memory is bounded by a block of texts, the kept pieces
(``KNOWN``) and, for a very long text, ``PIECES`` pieces at a time.

Edge cases: a null or empty text has no ids; null ids, repeated rows and an empty table
pass; a piece as long as its text is encoded like any other, in time about linear in its
length times the logarithm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

KNOWN, PAIRS, PIECES, LONG_TEXT, WAVE = 120_000, 500_000, 1 << 19, 1 << 21, 64


class Merges:
    """Ranks of pairs of tokens, which are known by their own ranks; a pair's rank is that of its bytes."""

    SHIFT = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[int, int] = {}  # pair to rank, -1 for none

    def rank(self, pair: int) -> int:
        r = self.known.get(pair)
        if r is None:
            if len(self.known) >= PAIRS:
                self.known = {}
            a, b = pair >> self.SHIFT, pair & ((1 << self.SHIFT) - 1)
            r = self.known[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r


def waves(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Token ids of each piece as little-endian 32-bit integers. No piece may be empty.

    All pieces lie in one row of places; tokens that a merge uses up and pieces without a
    pair to merge leave it after each wave.
    """
    shift, none, low = Merges.SHIFT, 1 << Merges.SHIFT, (1 << 40) - 1

    def indexed(at: np.ndarray) -> None:
        """Ranks of the pairs that start at these places; each pair's is found once."""
        pairs, back = np.unique(token[at] << shift | token[at + 1], return_inverse=True)
        ranks = np.fromiter(map(merges.rank, pairs.tolist()), np.int64, len(pairs))
        rank[at] = np.where(ranks < 0, none, ranks)[back]

    token = np.array(merges.single, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full(len(token), none, np.int64)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end, piece, out = np.cumsum(size), np.arange(len(pieces)), [b""] * len(pieces)
    inner = np.ones(len(token), bool)
    inner[end - 1] = False
    indexed(np.flatnonzero(inner))
    while len(piece):
        first = np.minimum.reduceat(rank << 40 | np.arange(len(rank)), end - size)
        done = first >= none << 40
        over = np.repeat(done, size)
        ids, stop = token[over].astype("<u4").tobytes(), (4 * np.cumsum(size[done])).tolist()
        for i, a, b in zip(piece[done].tolist(), [0, *stop], stop):
            out[i] = ids[a:b]
        at = first[~done] & low
        token[at] = rank[at]
        over[at + 1] = True
        stays = ~over
        at = (np.cumsum(stays) - 1)[at]
        token, rank, piece, size = token[stays], rank[stays], piece[~done], size[~done] - 1
        end = np.cumsum(size)
        rank[at] = none
        indexed(np.concatenate([at[at + 1 < end], at[at > end - size] - 1]))
    return out


def replay(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each piece, of any length; all of a pair's merges in the corpus happen when its rank is the lowest left.

    All pieces lie in one row of places, linked to their neighbours. Within a piece the
    leftmost pair of the lowest rank merges first. If that makes a pair of a lower rank
    still, the piece's other merges of the same pair wait for it.
    """
    shift, single, rank_of = Merges.SHIFT, merges.single, merges.rank
    token = [single[x] for x in b"".join(pieces)]
    ends, n = [], 0
    for p in pieces:
        n += len(p)
        ends.append(n)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    start = 0
    for e in ends:
        if e > start:
            left[start], right[e - 1] = -1, -1
        start = e
    index: dict[int, list[int]] = {}
    for i, j in enumerate(right):
        if j >= 0:
            index.setdefault(token[i] << shift | token[j], []).append(i)
    heap = [(r, pair) for pair in index if (r := rank_of(pair)) >= 0]
    heapq.heapify(heap)

    def put(pair: int, rank: int, at: int) -> None:
        places = index.get(pair)
        if places is None:
            index[pair] = [at]
            heapq.heappush(heap, (rank, pair))
        else:
            places.append(at)

    while heap:
        rank, pair = heapq.heappop(heap)
        a, b = pair >> shift, pair & ((1 << shift) - 1)
        places = index.pop(pair)
        places.sort()
        wait = -1  # places before this one wait for a lower rank
        for i in places:
            j = right[i]
            if j < 0 or token[i] != a or token[j] != b:
                continue
            if i < wait:
                put(pair, rank, i)
                continue
            k, h = right[j], left[i]
            token[i], token[j], right[i] = rank, -1, k
            lower = False
            if k >= 0:
                left[k] = i
                new = rank << shift | token[k]
                if (r := rank_of(new)) >= 0:
                    put(new, r, i)
                    lower = r < rank
            if h >= 0:
                new = token[h] << shift | rank
                if (r := rank_of(new)) >= 0:
                    put(new, r, h)
                    lower = lower or r < rank
            if lower:
                wait = ends[bisect_right(ends, i)]
    out, start = [], 0
    for e in ends:
        out.append([t for t in token[start:e] if t >= 0])
        start = e
    return out


class Codec:
    """Encodes and decodes with a rank file and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.split, self.merges = regex.compile(pattern), Merges(self.ranks)
        self.tokens = self.merges.tokens
        # a piece's ids as little-endian 32-bit integers; pieces that are not met for long go with ``older``
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, short, long = self.known, {}, {}
        for p in pieces:
            if p not in known:
                if (ids := self.older.get(p)) is not None:
                    known[p] = ids
                elif (t := self.ranks.get(raw := p.encode())) is not None:  # a piece that is a token stays whole
                    known[p] = t.to_bytes(4, "little")
                else:
                    (short if len(raw) <= WAVE else long)[p] = raw
        if short:
            known.update(zip(short, waves(list(short.values()), self.merges)))
        for p, ids in zip(long, replay(list(long.values()), self.merges)):
            known[p] = np.array(ids, "<u4").tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in pieces]

    def encode_long(self, text: str) -> bytes:
        """The same in parts, so that a text's pieces are not all held at once."""
        found, out = (m.group() for m in self.split.finditer(text)), []
        while part := list(islice(found, PIECES)):
            self.learn(set(part))
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_long(t) for t in texts] if any(len(t) > LONG_TEXT for t in texts) else self.encode_block(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


X.KEPT.append(codec.cache_clear)


def _mapped(docs: DataFrame, keep: tuple[str, ...], column: str, path: str, pattern: str, names: dict[str, T.DataType], row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            if not b.num_rows:
                continue
            kept = [x for x in b.schema.names if x != "__text"]
            for first, texts in X.blocks(b["__text"]):
                values = list(zip(*(row(c, ids) for ids in c.encode([t.decode() for t in texts]))))
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part[x] for x in kept), *map(pa.array, values)], names=[*kept, *names])

    rows = docs.select(*keep, F.col(column).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"] + [T.StructField(k, v) for k, v in names.items()]
    return rows.mapInArrow(run, T.StructType(fields))


def encoded(docs: DataFrame, *keep: str, path: str, pattern: str, column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and ``ids``, little-endian 32-bit integers as binary."""
    return _mapped(docs, keep, column, path, pattern, {"n_tokens": T.LongType(), "ids": T.BinaryType()}, lambda c, ids: (len(ids) // 4, ids))


def decoded(rows: DataFrame, *keep: str, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            kept = [x for x in b.schema.names if x != "__ids"]
            yield pa.RecordBatch.from_arrays([*(b[x] for x in kept), pa.array([c.decode(x.as_py() or b"") for x in b["__ids"]], pa.binary())], names=[*kept, "decoded"])

    chosen = rows.select(*keep, F.col(column).alias("__ids"))
    fields = [f for f in chosen.schema.fields if f.name != "__ids"] + [T.StructField("decoded", T.BinaryType())]
    return chosen.mapInArrow(run, T.StructType(fields))


def round_trip(docs: DataFrame, *keep: str, path: str, pattern: str, column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, ``ids`` and the SHA-256 of what the ids decode to, in one pass: a task has one Python worker, and one set of kept pieces."""

    def row(c: Codec, ids: bytes) -> tuple[int, bytes, str]:
        return len(ids) // 4, ids, hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(docs, keep, column, path, pattern, {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded_sha256": T.StringType()}, row)


def digests(docs: DataFrame, *keep: str, path: str, pattern: str, column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and the SHA-256 of ids and of what they decode to: encoding and decoding in one pass."""

    def row(c: Codec, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    names = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _mapped(docs, keep, column, path, pattern, names, row)
