"""Whole-batch tokenizing of UTF-8 text with numpy.

A word is a run of bytes of one class, so each byte of a code point above 127
counts as a word byte; this is the same as splitting by code points, since both
word classes in use hold every code point above 127.

Memory: texts are handled in blocks of about ``BLOCK`` bytes (a longer text is a
block of its own), each needing some ten times its size. After a batch the worker gives
back what it no longer needs, which allocators would keep otherwise.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
WHITE = bytes([0x20, *range(0x09, 0x0E)])
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mask(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_WHITE = ~_mask(WHITE)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, that is of lower-cased letters, digits and all above ASCII.
ALNUM = _mask([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a block of texts. ``first[i]:first[i + 1]`` are the words of text i."""

    buf: np.ndarray  # the texts, one separator byte after each, and padding
    at: np.ndarray  # where each text starts, and the end
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.length[i]].tobytes()


def words(texts: list[bytes], kind: np.ndarray, lower: bool, cut: np.ndarray | None = None) -> Words:
    """Runs of bytes of ``kind``; with ``cut``, also divided between bytes of classes 1 and 2 of that table."""
    raw = b"\n".join(texts) + b"\n" + bytes(16)
    if lower:
        raw = raw.translate(ASCII_LOWER)
    buf = np.frombuffer(raw, np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=at[1:])
    inside = kind[buf]
    inside[at[-1] - 1 if len(texts) else 0 :] = False
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    start, end = edges[::2], edges[1::2]
    if cut is not None:
        group = cut[buf]
        inner = np.flatnonzero(group[1:] * group[:-1] == 2) + 1
        inner = inner[inside[inner] & inside[inner - 1]]
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return Words(buf, at, start, end - start, np.searchsorted(start, at))


def hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes only; the length is mixed in first, so zero bytes at an end count."""
    chunk = np.ndarray((max(0, len(w.buf) - 7),), "<u8", w.buf.tobytes(), strides=(1,))
    h = mix((w.length.astype(np.uint64) ^ np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)) * _ODD)
    live = np.arange(len(w.start))
    long = np.flatnonzero(w.length > 64)
    for k in range(0, 64, 8):
        left = w.length[live] - k
        if k:
            live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        piece = chunk[w.start[live] + k] & _LOW[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ piece) * _ODD)
    for i in long:
        h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(w.word(i), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
    return h


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The places of distinct words, and which of them each word is. Hashes group the words, their bytes decide."""
    _, first, back = np.unique(hashes(w), return_index=True, return_inverse=True)
    twin = first[back]
    same = w.length == w.length[twin]
    chunk = np.ndarray((max(0, len(w.buf) - 7),), "<u8", w.buf, strides=(1,))
    live, k = np.flatnonzero(same & (twin != np.arange(len(twin)))), 0
    while len(live):
        low = _LOW[np.minimum(w.length[live] - k, 8)]
        equal = ((chunk[w.start[live] + k] ^ chunk[w.start[twin[live]] + k]) & low) == 0
        same[live[~equal]] = False
        k += 8
        live = live[equal & (w.length[live] > k)]
    odd: dict[bytes, int] = {}  # of words that share another's hash
    more: list[int] = []
    for i in np.flatnonzero(~same).tolist():
        word = w.word(i)
        if word not in odd:
            odd[word] = len(first) + len(more)
            more.append(i)
        back[i] = odd[word]
    return np.concatenate([first, np.array(more, np.int64)]), back


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places of the block have none."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mix((out ^ h[k : k + len(out)]) * _ODD + np.uint64(k))
    return out


def whole(w: Words, n: int) -> np.ndarray:
    """Which windows of n words lie in one text: a mask over ``windows``."""
    size = max(0, len(w.start) - n + 1)
    text = w.text_of_word()
    return text[:size] == text[n - 1 : n - 1 + size]


#: Of what operators keep in a Python worker between tasks: functions that let it go.
KEPT: list[Callable[[], object]] = []


def forget() -> None:
    """Lets go what other operators have kept in this Python worker, before one that needs none of it."""
    for f in KEPT:
        f()


@cache
def _trim() -> Callable[[int], int]:
    """The C library's ``malloc_trim``, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8, null as empty, in blocks; with the index of each block's first."""
    out: list[bytes] = []
    held, first = 0, 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        t = x.as_py() or b""
        if out and held + len(t) > size:
            yield first, out
            out, held, first = [], 0, i
        out.append(t)
        held += len(t)
    if out:
        yield first, out
    give_back()
