"""License detection by ordered signature rules.

A rule is a regular expression over a text's normalised words, with a label, a
priority, a weight and keywords, one of which any match holds. A text's words are hashed
as a block; rules without a keyword in the text never run, and a text without any keyword
is only counted. Of overlapping detections, one that lies inside a kept one of the same or
a higher priority is suppressed; base phrases are always kept. The score is the doubt that
all kept detections leave, taken from one.

Scale: a narrow pass; memory is bounded by a block of texts or the longest text.

Edge cases: a null or empty text has 0 words and no detection; any other columns,
null ids and repeated rows pass; an empty table gives no rows. Very long texts are
matched whole, in time linear in their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .signatures import SIGNATURES

#: Phrases and labels that must be found.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

class Rule(NamedTuple):
    label: str  # may name the pattern's group
    pattern: re.Pattern
    keywords: tuple[str, ...]  # any match holds one of them
    priority: int  # the higher, the stronger
    weight: float
    base: bool


def _rule(label: str, pattern: str, keywords: str, priority: int, weight: float, base: bool = False) -> Rule:
    return Rule(label, re.compile(rf"(?<= )(?:{pattern})(?= )"), tuple(keywords.split("/")), priority, weight, base)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, then the signatures."""
    out = [_rule(label, phrase, phrase.split()[0], 9, 0.9, base=True) for phrase, label in BASE.items()]
    for line in SIGNATURES.strip().split("\n"):
        head, pattern = line.split(" | ", 1)
        priority, weight, label, keywords = head.split()
        out.append(_rule(label, pattern, keywords, int(priority), float(weight)))
    return tuple(out)


@cache
def _by_keyword() -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
    """Sorted hashes of all keywords, and the places of each one's rules."""
    by: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        for word in r.keywords:
            by.setdefault(word, []).append(k)
    keys = list(by)
    h = X.hashes(X.words([k.encode() for k in keys], X.ALNUM, lower=True))
    return np.sort(h), {int(x): tuple(by[k]) for x, k in zip(h, keys)}


class Detection(NamedTuple):
    start: int  # in words
    end: int
    label: str
    weight: float
    priority: int
    base: bool


class Kept:
    """Intervals, and whether one of them holds another: the greatest end up to each start, in a Fenwick tree."""

    def __init__(self, starts: set[int]):
        self.place = {s: k + 1 for k, s in enumerate(sorted(starts))}
        self.end = [-1] * (len(starts) + 1)

    def add(self, d: Detection) -> None:
        k = self.place[d.start]
        while k < len(self.end):
            self.end[k] = max(self.end[k], d.end)
            k += k & -k

    def holds(self, d: Detection) -> bool:
        k, most = self.place[d.start], -1
        while k:
            most = max(most, self.end[k])
            k -= k & -k
        return most >= d.end


def suppressed(found: list[Detection]) -> list[Detection]:
    """``found`` without detections inside a kept one, in order of priority and length; base phrases come first and stay.

    A base phrase inside another kept detection weighs nothing, as that one counts.
    """
    starts = {d.start for d in found}
    every, others = Kept(starts), Kept(starts)
    base, rest = [d for d in found if d.base], []
    for d in base:
        every.add(d)
    for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not every.holds(d):
            every.add(d)
            others.add(d)
            rest.append(d)
    return sorted(rest + [d._replace(weight=0.0) if others.holds(d) else d for d in base])


def detect(text: bytes, active: list[Rule]) -> list[Detection]:
    w = [x for x in re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(X.ASCII_LOWER))]
    line = " " + " ".join(x.decode() for x in w) + " "
    at = np.cumsum([0, *(len(x.decode()) + 1 for x in w)]) + 1  # where each word begins
    found = []
    for r in active:
        for m in r.pattern.finditer(line):
            a, b = np.searchsorted(at, (m.start(), m.end()))
            label = m.expand(r.label).replace(" ", ".") if "\\" in r.label else r.label
            found.append(Detection(int(a), int(b), label, r.weight, r.priority, r.base))
    return suppressed(found)


OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("detections", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("base", T.BooleanType())])))])
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64()), ("base", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    (keys, by), every = _by_keyword(), rules()
    for b in batches:
        counts, found = [], []
        for _, texts in X.blocks(b["__text"]):
            w = X.words(texts, X.ALNUM, lower=True)
            counts.append(w.counts())
            h = X.hashes(w)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == h)
            active: dict[int, set[int]] = {}
            for t, x in zip(w.text_of_word()[hit].tolist(), h[hit].tolist()):
                active.setdefault(t, set()).update(by[x])
            for i, t in enumerate(texts):
                chosen = [every[k] for k in sorted(active.get(i, ()))]
                found.append([{"start": d.start, "end": d.end, "label": d.label, "weight": d.weight, "base": d.base} for d in detect(t, chosen)] if chosen else [])
        if b.num_rows:
            kept = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(found, _ARROW)], names=[*kept, "n_words", "detections"])


def scan(docs: DataFrame, *keep: str, column: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_words`` and ``detections`` of ``column``."""
    rows = docs.select(*keep, F.col(column).alias("__text"))
    return rows.mapInArrow(_scan, T.StructType([f for f in rows.schema.fields if f.name != "__text"] + OUT.fields))
