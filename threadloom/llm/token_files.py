"""Token ids in directly addressable files.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first
chunk of every id, level k chunk k of the ids that have one; a bitmap of each level says
which ids go on, and its rank directory (ones before each block of 512) leads from a
place in one level to the place in the next. So any id is read from a few bytes, without
decoding others.

File: magic, header length, JSON header (documents, tokens, levels, places of sections),
then document ids, first tokens and, per level, chunks, bitmap and directory.

Scale: documents are range-sharded by id, deterministically, sorted within a shard, and
encoded and written by the task that holds the shard, in files of at most
``FILE_TOKENS`` ids (a longer document has a file of its own). Files are written under
temporary names and moved when all tasks have ended well; the manifest names them.

Edge cases: a null or empty text has the end id alone; a null ``doc_id`` comes last;
repeated rows are written each, in order of their texts' hash; an empty table makes an
empty manifest; ids may need any number of levels.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._shards import Sink, by_shard, committed, filesystem, range_sharded
from ._store import stored

CHUNK_BITS, RANK_BLOCK, MAGIC = 8, 512, b"DACTOK1\n"
END_ID = 2
SHARD_BYTES, FILE_TOKENS = 8 << 20, 8 << 20
NO_ID = 2**63 - 1


#: ASCII letters, and ASCII marks but those of contractions and special tokens.
CUT = np.zeros(256, np.uint8)
CUT[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
CUT[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = 2


#: The normaliser and splitter that cutting texts into pieces relies on.
NORMALISER = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_hold(spec: dict) -> bool:
    """Whether a tokenizer's file lower-cases, drops white space and parts letters from marks as ``CUT`` has it, so that no piece sees another."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens") or [])
    return plain and [(s["type"], s.get("pattern"), s.get("content")) for s in steps] == NORMALISER and splits[0].get("pattern") == {"Regex": SPLITTER} and [s.get("use_regex") for s in splits[1:]] in ([], [False])


class WordEncoder:
    """Ids of texts by a tokenizers file that lower-cases, drops white space, and parts letters from marks.

    No token of such a tokenizer spans ASCII white space, or an ASCII letter and a mark of
    ``CUT`` beside it, so each distinct piece between those is encoded once, by the library.
    A-Z are lower-cased first, but where a block may hold a special token. Texts go to the
    library whole where the file is of another kind (``cuts_hold``).
    """

    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.in_pieces = cuts_hold(json.load(f))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.places = np.zeros((1 << 12, 2), np.int64)

    def _learn(self, new: list[bytes]) -> None:
        for enc, w in zip(self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), new):
            ids = enc.ids
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            if len(self.known) == len(self.places):
                self.places = np.concatenate([self.places, np.zeros_like(self.places)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.places[len(self.known)] = self.used, len(ids)
            self.known[w] = len(self.known)
            self.used += len(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has."""
        if not self.in_pieces:
            whole = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for ids in whole for i in ids], np.uint32), np.array([len(ids) for ids in whole], np.int64)
        w = X.words(texts, X.NOT_WHITE, lower=not any(b"<|" in t for t in texts), cut=CUT)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first, back = X.distinct(w)
        body = w.buf.tobytes()
        distinct = [body[a : a + n] for a, n in zip(w.start[first].tolist(), w.length[first].tolist())]
        if len(self.known) > self.LIMIT:
            self.forget()
        found = [self.known.get(x, -1) for x in distinct]
        if -1 in found:
            self._learn([x for x, k in zip(distinct, found) if k < 0])
            found = [self.known[x] if k < 0 else k for x, k in zip(distinct, found)]
        at = self.places[found][back]
        total = np.concatenate(([0], np.cumsum(at[:, 1])))
        ids = self.pool[np.repeat(at[:, 0] - total[:-1], at[:, 1]) + np.arange(total[-1])]
        return ids, np.diff(total[w.first])


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return WordEncoder(path)


def pack(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    sections = [np.array(doc_ids, "<i8").tobytes(), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype("<i8").tobytes()]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 1 << CHUNK_BITS
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append(len(rest))
        sections += [(rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), bits, np.concatenate(([0], np.cumsum(ones))).astype("<i8").tobytes()]
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": levels, "sections": [len(s) for s in sections]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


class TokenFile:
    """Reads a packed file; ``data`` may be a memory map."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("TOKEN_FILE_MAGIC")
        size = struct.unpack("<I", view[8:12])[0]
        self.header = json.loads(bytes(view[12 : 12 + size]))
        at, parts = 12 + size, []
        for n in self.header["sections"]:
            parts.append(view[at : at + n])
            at += n
        self.doc_ids, self.first = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8")
        self.levels = [(np.frombuffer(parts[k], np.uint8), np.frombuffer(parts[k + 1], np.uint8), np.frombuffer(parts[k + 2], "<i8")) for k in range(2, len(parts), 3)]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place i: the directory's, and those of part of a block."""
        block = i // RANK_BLOCK
        a = block * RANK_BLOCK // 8
        held = np.unpackbits(bits[a : (i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(held[: i - block * RANK_BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + CHUNK_BITS
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, by the same way for all at once; only their own chunks are read."""
        out, places, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks, bits, ranks in self.levels:
            if a >= b:
                break
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a = self._rank(bits, ranks, a)
            b = a + int(more.sum())
            places, shift = places[more], shift + CHUNK_BITS
        return out


MANIFEST = "name string, tmp string, shard int, part int, docs long, tokens long, bytes long, crc32 long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to ``folder``; the manifest of its files."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sharded = range_sharded(rows.withColumn("held", F.octet_length("text") + 8), "doc_id", "held", shard_bytes)
    ordered = by_shard((sharded[0].withColumn("own", F.xxhash64("text")), sharded[1]), "doc_id", "own").select("__shard", "doc_id", "text")

    def save(shard: int, part: int, ids: list[int], counts: list[int], tokens: list[np.ndarray], token: str) -> tuple:
        data = pack(ids, counts, np.concatenate(tokens))
        sink = Sink(folder, f"shard-{shard:06d}-{part:04d}.dac", token)
        sink.write(data)
        sink.out.close()
        return sink.name, sink.tmp, shard, part, len(ids), sum(counts), len(data), zlib.crc32(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, token = encoder(tokenizer), uuid.uuid4().hex
        shard, part, total, ids, counts, tokens, done = None, 0, 0, [], [], [], []
        for b in batches:
            shards, doc_ids = b["__shard"].to_pylist(), b["doc_id"].to_pylist()
            for first, texts in X.blocks(b["text"]):
                flat, n = enc.encode(texts)
                ends = np.cumsum(n)
                for k in range(len(texts)):
                    own, size = np.append(flat[ends[k] - n[k] : ends[k]], np.uint32(end_id)), int(n[k]) + 1
                    if ids and (shards[first + k] != shard or total + size > file_tokens):
                        done.append(save(shard, part, ids, counts, tokens, token))
                        part = part + 1 if shards[first + k] == shard else 0
                        ids, counts, tokens = [], [], []
                    if not ids:
                        total = 0
                    shard = shards[first + k]
                    ids.append(doc_ids[first + k])
                    counts.append(size)
                    tokens.append(own)
                    total += size
        if ids:
            done.append(save(shard, part, ids, counts, tokens, token))
        table = pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        yield from pa.Table.from_pandas(table, _schema(), preserve_index=False).to_batches()

    return committed(stored(ordered.mapInArrow(run, MANIFEST), "token-manifest"), folder)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MANIFEST.split(", ")])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    # one row for each file: few, and numbers only
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("name", "before")
    n = max(1, manifest.count())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for rows in parts:
            for name, start in zip(rows["name"], rows["before"]):
                with store.open_input_file(f"{root}/{name}") as f:
                    t = TokenFile(f.read())
                crcs = [zlib.crc32(t.span(a, b).astype("<u4").tobytes()) for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist())]
                yield pd.DataFrame({"doc_id": t.doc_ids, "start": start + t.first[:-1], "n_tokens": np.diff(t.first), "ids_crc32": crcs})

    out = files.repartition(n, "name").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
