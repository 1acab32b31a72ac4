"""ZIP archives as Spark data sources.

``zip_members``: a row for each directory entry, in directory order, with the bounded prefix
that later steps look at; no payload beyond that is read. ``json_array``: elements of a member
or file that holds a JSON array, framed strictly, each file within one task. Archives are opened by
the executors through pyarrow's file systems, so the path may be local, shared or in a store.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K
from ..session import ship
from .strict_json import array_items, file_chunks


def _placed(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A seekable stream of a local path or URI."""
    store, at = _placed(path)
    return store.open_input_file(at)


def sample_positions(n: int) -> list[int]:
    """Which of n conversation members are sampled: the first, second, fourth and last."""
    return sorted({0, min(1, n - 1), min(3, n - 1), n - 1}) if n else []


def _tail(name: str) -> str:
    return re.split(r"[/\\]", name)[-1]


def prefix_limit(info: zipfile.ZipInfo, sampled: bool) -> int:
    """Bytes of a member that may be read. Protected members, and all not listed here, are not."""
    ext = PurePosixPath(_tail(info.filename)).suffix.lower().removeprefix(".")
    if info.flag_bits & 1 or info.is_dir():
        return 0
    if re.fullmatch(K.CONVERSATION_NAME, _tail(info.filename), re.I):
        return K.SAMPLE_BYTES if sampled else 0
    return {"json": K.ANCILLARY_BYTES, "dat": K.HEADER_BYTES, "bundle": K.HEADER_BYTES}.get(ext, 0)


class Span(InputPartition):
    """Entries of an archive: which, where in the directory their records are, and which are sampled."""

    def __init__(self, archive: int, first: int, last: int, start: int, end: int, directory: int, sampled: frozenset[int]):
        super().__init__((archive, first))
        self.archive, self.first, self.last, self.start, self.end, self.directory, self.sampled = archive, first, last, start, end, directory, sampled


#: A directory record's size without its name, extra field and comment, whose lengths are at an offset, and the record that ends a directory.
RECORD, LENGTHS, END_RECORD = 46, 28, "<4s4H2LH"


def directory_slice(stream, start: int, end: int, directory: int) -> zipfile.ZipFile:
    """An archive of the entries whose directory records lie between two places; members are read from ``stream``, before ``directory``."""
    stream.seek(start)
    records = stream.read(end - start)
    n, at = 0, 0
    while at < len(records):
        at += RECORD + sum(struct.unpack_from("<3H", records, at + LENGTHS))
        n += 1
    z = zipfile.ZipFile(io.BytesIO(records + struct.pack(END_RECORD, b"PK\5\6", 0, 0, n & 0xFFFF, n & 0xFFFF, len(records), 0, 0)))
    for x in z.infolist():
        if (x._end_offset or 0) <= x.header_offset:  # the last one ends where the whole directory starts, at the latest
            x._end_offset = directory
    z.fp = stream
    return z


class MembersReader(DataSourceReader):
    """The driver reads each directory once; a task reads its own entries' records only."""

    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Span]:
        out = []
        for k, path in enumerate(self.paths):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                infos, place = z.infolist(), z.start_dir
                talks = [i for i, x in enumerate(infos) if re.fullmatch(K.CONVERSATION_NAME, _tail(x.filename), re.I)]
                sampled = {talks[j] for j in sample_positions(len(talks))}
                f.seek(place)
                records = f.read()
            at = 0
            for a in range(0, len(infos), self.split):
                b, start = min(len(infos), a + self.split), at
                for _ in range(a, b):
                    at += RECORD + sum(struct.unpack_from("<3H", records, at + LENGTHS))
                out.append(Span(k, a, b, place + start, place + at, place, frozenset(i for i in sampled if a <= i < b)))
        return out or [Span(0, 0, 0, 0, 0, 0, frozenset())]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        with opened(self.paths[partition.archive]) as f:
            z = directory_slice(f, partition.start, partition.end, partition.directory)
            for i, x in enumerate(z.infolist(), partition.first):
                prefix, sampled = None, i in partition.sampled
                if limit := prefix_limit(x, sampled):
                    with z.open(x) as member:
                        prefix = member.read(limit)
                yield (i, x.filename, x.file_size, x.compress_size, list(x.date_time), x.CRC, x.compress_type, x.flag_bits, x.header_offset, sampled, prefix, partition.archive)


class ZipMembers(DataSource):
    """Options: path (or several, a line each), split (directory entries in a task)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "ordinal int, name string, uncompressed_bytes long, compressed_bytes long, zip_timestamp array<int>, crc long, compression_method int, flag_bits int, header_offset long, is_sampled boolean, prefix binary, archive int"

    def reader(self, schema) -> MembersReader:
        return MembersReader([p for p in self.options["path"].split("\n") if p], int(self.options.get("split", 512)))


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(tuple(files))
        self.files = files


#: Bytes of small files that a task reads at most, and what a file counts besides its own.
TASK_BYTES, FILE_BYTES = 64 << 20, 4096


class ArrayReader(DataSourceReader):
    """A file is never cut, as an element's place in the array is known to who reads from the start only; small files share a task."""

    def __init__(self, files: list[tuple[int, str]], archive: str | None, tasks: int):
        self.files, self.archive, self.tasks = files, archive, tasks

    def _sizes(self) -> list[int]:
        if self.archive:
            with opened(self.archive) as f, zipfile.ZipFile(f) as z:
                members = z.infolist()
            return [members[int(place)].file_size for _, place in self.files]
        return [store.get_file_info(at).size or 0 for store, at in (_placed(place) for _, place in self.files)]

    def partitions(self) -> list[Files]:
        sizes = [n + FILE_BYTES for n in self._sizes()]
        most, held, out = min(TASK_BYTES, -(-sum(sizes) // self.tasks)), 0, []
        for file, n in zip(self.files, sizes):
            if not out or held + n > most:
                out.append([])
                held = 0
            out[-1].append(file)
            held += n
        return [Files(files) for files in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        if self.archive and partition.files:
            with opened(self.archive) as f, zipfile.ZipFile(f) as z:
                members = z.infolist()
                for shard, place in partition.files:
                    with z.open(members[int(place)]) as member:
                        yield from self._items(shard, member)
        else:
            for shard, place in partition.files:
                with opened(place) as f:
                    yield from self._items(shard, f)

    @staticmethod
    def _items(shard: int, stream) -> Iterator[tuple]:
        from .strict_json import load

        for ordinal, raw in enumerate(array_items(file_chunks(stream), decode=lambda raw: (load(raw), raw)[1])):
            yield shard, ordinal, raw.decode("utf-8")


class JsonArray(DataSource):
    """Options: files, as lines ``shard<TAB>path``, or with ``archive`` as lines ``shard<TAB>ordinal``; tasks, about how many are wanted where files are small."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "shard long, ordinal int, payload string"

    def reader(self, schema) -> ArrayReader:
        files = [x.split("\t", 1) for x in self.options["files"].split("\n") if x]
        return ArrayReader([(int(a), b) for a, b in files], self.options.get("archive"), int(self.options.get("tasks", len(files) or 1)))


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (ZipMembers, JsonArray):
        spark.dataSource.register(source)


def read_members(spark: SparkSession, *paths: str):
    register(spark)
    return spark.read.format("zip_members").option("path", "\n".join(paths)).load()


def read_arrays(spark: SparkSession, files: dict[int, str], archive: str | None = None):
    register(spark)
    reader = spark.read.format("json_array").option("files", "\n".join(f"{k}\t{v}" for k, v in sorted(files.items()))).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return (reader.option("archive", archive) if archive else reader).load()
