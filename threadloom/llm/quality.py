"""Quality rules by weak supervision.

Rules look at counts of a text and vote good, vote bad or abstain. Expectation
maximisation over the votes of all documents estimates how often each rule votes
what on good and on bad documents, without labels; the posterior probability of
good then decides, instead of a demand that all rules pass.

Scale: one narrow pass counts, the votes are grouped with map-side combining to
at most 3^rules patterns (``PATTERNS``), which alone reach the driver; the
posterior is a sum of weights, evaluated in the JVM.

Edge cases: a null or empty text has no words, all counts 0, and fails the base;
rows with a null ``doc_id`` and repeated rows are judged like any other; an empty
table gives an empty result; other columns are kept by ``with_quality``, save
those with names of the counts, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._store import stored

SYMBOLS = X._mask(b"#*$%&|<>")
MARKS = X._mask(b"#*$%&|<>!?@^~=+_{}[]/\\")
UPPER, LETTER = X._mask(range(65, 91)), X._mask([*range(65, 91), *range(97, 123), *range(128, 256)])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_distinct", "n_lines", "longest_word", "n_marks", "n_bare_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Upper bound of the rows that reach the driver.
PATTERNS = 3**11


def _by_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, at[:-1], dtype=np.int64)


def count_block(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text."""
    w = X.words(texts, X.NOT_WHITE, lower=False)
    body, n = w.buf[: w.at[-1]], len(texts)
    inside = X.NOT_WHITE[body]
    inside[w.at[1:] - 1] = False
    out = {"n_words": w.counts(), "word_chars": _by_text(inside & ((body & 0xC0) != 0x80), w.at)}
    out["n_symbols"] = _by_text(SYMBOLS[body], w.at)
    out["n_upper"], out["n_letters"] = _by_text(UPPER[body], w.at), _by_text(LETTER[body], w.at)
    h = X.hashes(w)
    text = w.text_of_word()
    salt = X.mix((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    out["n_distinct"] = np.bincount(text[np.unique(h ^ salt, return_index=True)[1]], minlength=n)
    longest = np.zeros(n, np.int64)
    full = np.flatnonzero(w.counts())
    if len(full):
        longest[full] = np.maximum.reduceat(w.length, w.first[:-1][full])
    out["longest_word"] = longest
    out["n_marks"] = _by_text(MARKS[body], w.at)
    lettered = np.concatenate(([0], np.cumsum(LETTER[body])))
    out["n_bare_words"] = np.bincount(text[lettered[w.start + w.length] == lettered[w.start]], minlength=n)
    keys = X.windows(h, 3)
    own = np.flatnonzero(X.whole(w, 3))
    keys = keys[own] ^ salt[own]
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = own[times[back] >= 2]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if x.strip(X.WHITE)]
        lines[i], dup[i] = len(rows), len(rows) - len(set(rows))
    return out | {"n_dup_lines": dup, "n_lines": lines}


def _count(column: str, field: str | None = None):
    """Adds the ``COUNTS`` of a column, which goes, or of a field of a struct column, which stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.forget()
        for b in batches:
            if not b.num_rows:
                continue
            parts = [count_block(texts) for _, texts in X.blocks(b[column].field(field) if field else b[column])]
            counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
            kept = [c for c in b.schema.names if field or c != column]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *counts], names=[*kept, *COUNTS])

    return run


def counts(docs: DataFrame, *keep: str, column: str = "text") -> DataFrame:
    """The columns ``keep`` and the ``COUNTS`` of ``column``, in a narrow pass."""
    rows = docs.select(*keep, F.col(column).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"] + [T.StructField(c, T.LongType()) for c in COUNTS]
    return rows.mapInArrow(_count("__text"), T.StructType(fields))


def base_failed() -> Column:
    """Too short, or too much said twice."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Of each rule: when it votes good, and when it votes bad; else it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    shout, dup = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": (n >= 100, n < MIN_WORDS),
        "repeats": (per_word("n_repeat_words") <= 0.2, per_word("n_repeat_words") > 0.5),
        "symbols": (per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.1),
        "dup_lines": (dup <= 0.1, dup > 0.3),
        "word_length": (per_word("word_chars").between(3, 9), ~per_word("word_chars").between(2, 14)),
        "shouting": (shout <= 0.1, shout > 0.3),
        "variety": (per_word("n_distinct") >= 0.3, (per_word("n_distinct") < 0.1) & (n < 2000)),
        "giant_words": (F.col("longest_word") <= 60, F.col("longest_word") > 200),
        "letters": (F.col("n_letters") >= 0.93 * F.col("word_chars"), F.col("n_letters") < 0.85 * F.col("word_chars")),
        "marks": (per_word("n_marks") <= 0.05, per_word("n_marks") > 0.2),
        "bare_words": (per_word("n_bare_words") <= 0.05, per_word("n_bare_words") > 0.2),
    }


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstains."""
    return [F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint").alias(f"vote_{k}") for k, (good, bad) in rules().items()]


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """EM over vote patterns and how many documents have each: the log odds of good, and weights[rule, vote + 1].

    Starts from the share of good votes. A rule is held to be no worse than chance:
    a vote's weight never has the wrong sign, so the two classes cannot swap.
    """
    k = patterns.shape[1]
    if not len(patterns):
        return 0.0, np.zeros((k, 3))
    one = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    good = (1 + (patterns == 1).sum(1) * 0.5) / (2 + (patterns == 1).sum(1) * 0.5 + (patterns == -1).sum(1) * 2.0)
    prior, weights, was = 0.0, np.zeros((k, 3)), np.inf
    for _ in range(rounds):
        g, b = times * good, times * (1 - good)
        share = (g.sum() + 1) / (times.sum() + 2)
        p = (np.einsum("n,nkv->kv", g, one) + 0.5) / (g.sum() + 1.5)
        q = (np.einsum("n,nkv->kv", b, one) + 0.5) / (b.sum() + 1.5)
        weights = np.log(p / q)
        weights[:, 0], weights[:, 2], weights[:, 1] = np.minimum(weights[:, 0], 0), np.maximum(weights[:, 2], 0), np.clip(weights[:, 1], -0.5, 0.5)
        prior = float(np.log(share / (1 - share)))
        logit = np.clip(prior + np.einsum("nkv,kv->n", one, weights), -500, 500)
        good = 1 / (1 + np.exp(-logit))
        now = float(np.average(np.logaddexp(0, logit), weights=times))
        if abs(now - was) < tol:
            break
        was = now
    return prior, weights


def fitted(voted: DataFrame) -> tuple[float, np.ndarray]:
    """``estimate`` over a table of votes."""
    seen = voted.groupBy(*voted.columns).count().collect()  # at most PATTERNS rows
    return estimate(np.array([r[:-1] for r in seen], np.int8).reshape(-1, len(voted.columns)), np.array([r[-1] for r in seen], float))


def _posterior(prior: float, weights: np.ndarray, names: list[str]) -> Column:
    logit = F.lit(prior)
    for name, (less, none, more) in zip(names, weights.tolist()):
        logit = logit + F.when(F.col(name) == 1, more).when(F.col(name) == -1, less).otherwise(none)
    return 1 / (1 + F.exp(-logit))


def with_quality(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``counted`` (columns ``COUNTS``) with votes, ``p_good``, ``base_failed`` and ``kept``.

    Accuracies are estimated on what passes the base: what fails it is decided already.
    """
    voted = counted.where(~base_failed()).select(*votes())
    prior, weights = fitted(voted)
    out = counted.select("*", *votes()).withColumn("p_good", _posterior(prior, weights, voted.columns))
    failed = base_failed()
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def judged(docs: DataFrame, *keep: str, column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes and verdict of each row; the counts are stored, as EM and the verdict both read them."""
    return with_quality(stored(counts(docs, *keep, column=column), "quality"), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept. Each text is counted once: rows that pass the base are stored with their votes, of which EM reads the votes alone."""
    voted = stored(_carried(docs).where(~base_failed()).select("__doc", *votes()), "votes")
    names = [c for c in voted.columns if c != "__doc"]
    prior, weights = fitted(voted.select(*names))
    kept = voted.where(_posterior(prior, weights, names) >= threshold)
    return kept.select(*(F.col(f"__doc.`{c}`").alias(c) for c in docs.columns))


def _carried(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as ``__doc``, with the counts of its text."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    schema = T.StructType([boxed.schema["__doc"], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return boxed.mapInArrow(_count("__doc", "text"), schema)
