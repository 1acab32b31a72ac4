"""WARC archives by a deterministic sharded writer.

Pages are range-sharded by id and sorted, so a file's records depend on the data alone.
Each task streams its shards into gzip members, one for a record, and rolls to a new file
when the compressed size passes ``FILE_BYTES``. Headers, lengths and digests are made anew.
Files are written under temporary names; the manifest, stored once all tasks have ended
well, says which files count, and only these are moved to their names.

Records with equal payloads of at least ``MIN_BYTES`` revisit the one with the smallest id.
Of the pages only ids and digests meet for that: payloads with more than 1 / (4 x
partitions) of all rows, at most 4 x partitions of them, are found by a count with
map-side combining and broadcast; the others are joined by digest. A revisit's marker
then reaches the writer in the same sort as its page, so payloads are shuffled once.

Edge cases: a null html is an empty payload; a null or odd URL is percent-encoded, or
`urn:page:<id>` where empty; a null page_id counts as the largest; of repeated rows with
the smallest id each is a response; an empty table makes no file. Memory: a record and
an Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import Sink, by_shard, committed, filesystem, range_sharded
from ._sql import partitions
from ._store import stored

SHARD_BYTES, FILE_BYTES, MIN_BYTES = 16 << 20, 64 << 20, 0
DATE = "2000-01-01T00:00:00Z"
NO_ID = 2**63 - 1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122
MANIFEST = "name string, tmp string, shard int, part int, records long, bytes long, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    block = b"software: threadloom\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page_record(page_id: int, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Page-ID", str(page_id)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # no name and no time in the header
    return c.compress(data) + c.flush()


def revisits(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of each row of (page_id, digest, size) that is not the first with its payload."""
    slim = stored(rows.where(F.col("size") >= min_bytes).select("page_id", "digest"), "digests")
    limit = max(100, slim.count() // (4 * partitions(rows)))
    firsts = slim.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where(F.col("last") > F.col("refers_to"))
    hot, cold = firsts.where(F.col("n") > limit), firsts.where(F.col("n") <= limit)
    both = slim.join(F.broadcast(hot.select("digest", F.col("refers_to").alias("hot"))), "digest", "left")
    found = both.where(F.col("hot").isNotNull()).select("page_id", "digest", F.col("hot").alias("refers_to"))
    rest = both.where(F.col("hot").isNull()).drop("hot").join(cold.select("digest", "refers_to"), "digest")
    return found.unionByName(rest.select("page_id", "digest", "refers_to")).where(F.col("page_id") > F.col("refers_to")).distinct()


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder``; the manifest of its files."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size"))
    marks = revisits(rows, min_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(0).alias("size"), "refers_to")
    # the marker sorts before its page
    every = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("is_page", F.lit(1)).unionByName(marks.withColumn("is_page", F.lit(0)))
    every = every.withColumn("held", F.col("size") + F.lit(300) * F.col("is_page"))
    plan = range_sharded(rows.select("page_id", (F.col("size") + 300).alias("held")), "page_id", "held", shard_bytes, onto=every)
    ordered = by_shard(plan, "page_id", "digest", "is_page", "url").select("__shard", "page_id", "url", "html", "digest", "refers_to", "is_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, done, now, mark = uuid.uuid4().hex, [], None, None

        def close() -> None:
            nonlocal now
            if now:
                sink, shard, part, n, sha = now
                sink.out.close()
                done.append((sink.name, sink.tmp, shard, part, n, sink.written, sha.hexdigest()))
            now = None

        def put(data: bytes) -> None:
            now[0].write(data)
            now[4].update(data)

        for b in batches:
            for r in b.to_pylist():
                key = r["page_id"], r["digest"]
                if not r["is_page"]:
                    mark = (key, r["refers_to"])
                    continue
                full = now is not None and (now[1] != r["__shard"] or now[0].written >= file_bytes)
                if now is None or full:
                    part = now[2] + 1 if now is not None and now[1] == r["__shard"] else 0
                    close()
                    name = f"shard-{r['__shard']:06d}-{part:04d}.warc.gz"
                    now = [Sink(folder, name, token), r["__shard"], part, 0, hashlib.sha256()]
                    put(gzipped(info(name)))
                put(gzipped(page_record(r["page_id"], r["url"], r["html"], mark[1] if mark and mark[0] == key else None)))
                now[3] += 1
        close()
        table = pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        yield from pa.Table.from_pandas(table, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MANIFEST.split(", ")]), preserve_index=False).to_batches()

    return committed(stored(ordered.mapInArrow(run, MANIFEST), "warc-manifest"), folder)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member."""
    d, out = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            out.append(d.decompress(data))
            data = d.unused_data if d.eof else b""
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("WARC_TRUNCATED")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("WARC_LENGTH")
    return headers, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page record; a response's payload is digested again."""
    n = max(1, manifest.count())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for names in parts:
            for name in names["name"]:
                out = []
                with store.open_input_stream(f"{root}/{name}") as f:
                    for m in members(iter(lambda: f.read(1 << 20), b"")):
                        headers, block = parsed(m)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base32_sha1(payload) != digest:
                                raise ValueError("WARC_DIGEST")
                            size = len(payload)
                        out.append((int(headers["X-Page-ID"]), size, digest, headers["WARC-Type"], int(headers.get("X-Refers-To-Page", -1))))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = manifest.select("name").repartition(n, "name").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers_to"))).withColumn("page_id", F.when(F.col("page_id") != NO_ID, F.col("page_id")))
