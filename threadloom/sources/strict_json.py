"""Strict JSON: whole documents, and arrays one element at a time.

Spark's JSON reader lets duplicate keys, NaN and trailing text pass, so these gates are
here. An array is framed by its structural bytes only, found by a compiled pattern over
each chunk; at most one element is held.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from ..functions.constants import MAX_DEPTH, MAX_ELEMENT_BYTES
from ..functions.errors import JsonError, need

BLANK = b" \t\r\n"
_OUTSIDE = re.compile(rb'["\[\]{},]')
_INSIDE = re.compile(rb'["\\]')


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    need(len(out) == len(pairs), "JSON_DUPLICATE_KEY", JsonError)
    return out


def _constant(_: str):
    raise JsonError("JSON_NONFINITE")


def _finite(text: str) -> float:
    value = float(text)
    need(value - value == 0, "JSON_NONFINITE", JsonError)
    return value


def load(raw: bytes):
    """A value; duplicate keys, numbers that aren't finite, bad UTF-8 and bad syntax have a code each."""
    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_constant, parse_float=_finite)
    except JsonError:
        raise
    except (ValueError, RecursionError):
        raise JsonError("JSON_INVALID") from None


class ArrayFramer:
    """Fed with chunks of an array's bytes; gives the bytes of each element."""

    def __init__(self, max_bytes: int = MAX_ELEMENT_BYTES, max_depth: int = MAX_DEPTH):
        self.max_bytes, self.max_depth = max_bytes, max_depth
        self.open = self.closed = False
        self.seen = 0  # separators so far
        self.held = bytearray()
        self.depth, self.quoted, self.escaped = 0, False, False

    def _hold(self, piece: bytes) -> None:
        self.held += piece
        if not self.depth and not self.quoted and not self.held.strip(BLANK):
            self.held.clear()  # blanks before an element
        need(len(self.held) <= self.max_bytes, "JSON_ELEMENT_LIMIT", JsonError)

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        at = 0
        if not self.open:
            rest = chunk.lstrip(BLANK)
            if not rest:
                return
            need(rest[:1] == b"[", "JSON_ARRAY_REQUIRED", JsonError)
            self.open, at = True, len(chunk) - len(rest) + 1
        while at < len(chunk):
            if self.closed:
                need(not chunk[at:].strip(BLANK), "JSON_TRAILING", JsonError)
                return
            if self.quoted:
                if self.escaped:
                    self._hold(chunk[at : at + 1])
                    self.escaped, at = False, at + 1
                    continue
                m = _INSIDE.search(chunk, at)
                end = m.end() if m else len(chunk)
                self._hold(chunk[at:end])
                if m:
                    self.quoted, self.escaped = m[0] == b"\\", m[0] == b"\\"
                at = end
                continue
            m = _OUTSIDE.search(chunk, at)
            if not m:
                self._hold(chunk[at:])
                return
            self._hold(chunk[at : m.start()])
            at, b = m.end(), m[0]
            if not self.depth and b in b",]":
                blank = not self.held.strip(BLANK)
                if blank and b == b"]":
                    need(not self.seen, "JSON_TRAILING_COMMA", JsonError)
                else:
                    need(not blank, "JSON_EMPTY_ELEMENT", JsonError)
                    yield bytes(self.held)
                    self.held.clear()
                self.seen += b == b","
                self.closed = b == b"]"
                continue
            self.depth += (b in b"[{") - (b in b"]}")
            need(self.depth <= self.max_depth, "JSON_DEPTH_LIMIT", JsonError)
            need(self.depth >= 0, "JSON_BRACKET", JsonError)
            self.quoted = b == b'"'
            self._hold(b)

    def finish(self) -> None:
        need(self.closed, "JSON_INCOMPLETE", JsonError)


def array_items(chunks: Iterable[bytes], framer: ArrayFramer | None = None, decode: Callable = load) -> Iterator:
    """Decoded elements of an array that comes in chunks."""
    framer = framer or ArrayFramer()
    for chunk in chunks:
        for raw in framer.feed(chunk):
            yield decode(raw)
    framer.finish()


def file_chunks(stream, size: int = 65_536) -> Iterator[bytes]:
    return iter(lambda: stream.read(size), b"")


def outcome(raw: bytes, max_bytes: int = MAX_ELEMENT_BYTES, size: int = 65_536) -> tuple[int, str | None]:
    """How many elements an array's text gives, and the code that stops it, if any."""
    n = 0
    try:
        for _ in array_items((raw[k : k + size] for k in range(0, len(raw), size)), ArrayFramer(max_bytes)):
            n += 1
    except JsonError as e:
        return n, str(e)
    return n, None


def scanned(rows, text: str, cap: str | None = None):
    """``rows`` with ``elements`` and ``code`` of the JSON array in a string or binary column; ``cap`` names a column of limits."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            caps = b[cap].to_pylist() if cap else [None] * b.num_rows
            found = [outcome(x or b"", c or MAX_ELEMENT_BYTES) for x, c in zip(b[text].cast(pa.large_binary()).to_pylist(), caps)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=[*b.schema.names, "elements", "code"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("elements", T.LongType()), T.StructField("code", T.StringType())]))


def loaded(rows, text: str):
    """``rows`` with ``code`` of the JSON document in a string or binary column: null where it is strictly valid."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def code(raw: bytes) -> str | None:
        try:
            load(raw)
        except JsonError as e:
            return str(e)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [code(x or b"") for x in b[text].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.StringType())]))
