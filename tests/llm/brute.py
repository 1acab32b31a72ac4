"""Plain versions of what the queries return, straight from their definitions."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

AZ = str.maketrans(ascii_uppercase, ascii_lowercase)
BLANK = r"[\x20\x09-\x0D]"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def op1(docs: list[tuple]) -> dict:
    out = {}
    for i, text in docs:
        w = SPACED.findall(text or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        rows = [x for x in (text or "").split("\n") if SPACED.search(x)]
        counts = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(rows) - len(set(rows)), len(covered))
        out[i] = (*counts, len(w) < 50 or 100 * len(covered) > 50 * len(w))
    return out


def op2(docs: list[tuple]) -> dict:
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(AZ))
        found = [(k, k + len(p) - 1, label) for phrase, label in phrases.items() for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        out[i] = (len(w), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), ",".join(sorted({f[2] for f in found})))
    return out


def op3(docs: list[tuple], benchmark: list[tuple]) -> dict:
    has = defaultdict(set)
    for item, text in benchmark:
        w = tuple(ALNUM.findall((text or "").translate(AZ)))
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            has[w[k : k + 13]].add(str(item))
    out = {}
    for i, text in docs:
        w = tuple(ALNUM.findall((text or "").translate(AZ)))
        hit, items = set(), set()
        for n in {len(x) for x in has}:
            for k in range(len(w) - n + 1):
                if found := has.get(w[k : k + n]):
                    hit |= set(range(k, k + n))
                    items |= found
        out[i] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def op6(docs: list[tuple]) -> dict:
    split = {i: [(x, re.sub(rf"^{BLANK}+|{BLANK}+\Z", "", x).translate(AZ)) for x in (text or "").split("\n")] for i, text in docs}
    where = defaultdict(set)
    for i, rows in split.items():
        for _, key in rows:
            if len(key) >= 10:
                where[key].add(i)
    out = {}
    for i, rows in split.items():
        kept = [x for x, key in rows if len(key) < 10 or min(where[key]) == i]
        out[i] = (len(rows), len(rows) - len(kept), sha("\n".join(kept)))
    return out


def shingles(text: str | None, n: int) -> set:
    w = tuple(SPACED.findall((text or "").translate(AZ)))
    return {w[k : k + n] for k in range(max(1, len(w) - n + 1))} if w else set()


def op8(docs: list[tuple], n: int = 4, percent: int = 85) -> dict:
    sets = {i: shingles(t, n) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    near = set()
    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                near.add((j, i))
    for j, i in near:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def op9(pages: list[tuple]) -> dict:
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    out = {}
    for i, url in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(AZ), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out[i] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    return out


def op10(pages: list[tuple]) -> dict:
    first, out = {}, {}
    for i, html in sorted(pages):
        body = (html or "").encode()
        to = first.setdefault(body, i)
        out[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)
    return out


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
