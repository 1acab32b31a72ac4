"""Line deduplication across documents, with DataFrame functions only.

A line's key is hashed to 128 bits. Hashes are range-partitioned and sorted by
document and position, so the first occurrence of each streams past before the
others, which are dropped unless they are in the same document. What comes back is a
bitmap per document of the lines to drop, stored sparsely (64-bit words without a bit
are left out), not text.

Skew: a hash with more than 1 / (4 x partitions) of all lines is hot. There are at
most 4 x partitions of those, found by a count with map-side combining that also
gives their first document, so they are broadcast and their lines never meet in one
task; all other hashes are small against a partition.

Edge cases: a null or empty text is one empty line; a null ``doc_id`` counts as the
largest; rows with one ``doc_id`` are one document, told apart by a hash of their
text; repeated rows each come back; an empty table gives no rows; other columns are
kept by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._sql import WHITE, ascii_lower, met, partitions
from ._store import stored

MIN_CHARS = 10
LAST = 2**63 - 1


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, own, at, h1, h2) of each line whose key is long enough."""
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("own"), F.posexplode(_split(F.col("text"))).alias("at", "line"))
    keys = lines.select("doc", "own", "at", F.trim(F.col("line"), F.lit(WHITE)).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select("doc", "own", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, own, at) of each line that an earlier document has."""
    lines = stored(line_hashes(docs, min_chars), "lines")
    n = partitions(docs)
    limit = max(100, lines.count() // (4 * n))
    hot = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc")).where(F.col("n") > limit).drop("n")
    both = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    late = F.col("doc") > F.col("first_doc")
    from_hot = both.where(late)
    rest = both.where(F.col("first_doc").isNull()).drop("first_doc")
    ranged = rest.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "doc", "at")
    order = Window.partitionBy("h1", "h2").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_rest = ranged.withColumn("first_doc", F.first("doc").over(order)).where(late)
    return from_hot.select("doc", "own", "at").unionByName(from_rest.select("doc", "own", "at"))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, own, n_dropped, bitmap) of each document that loses lines; bitmap: sorted (word, bits), 64 lines a word."""
    words = dropped_lines(docs, min_chars).groupBy("doc", "own", F.expr("at div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("bits"))
    return words.groupBy("doc", "own").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def _positions(bitmap: Column) -> Column:
    """Line positions of a bitmap's bits."""
    return F.flatten(F.transform(bitmap, lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.getbit(w["bits"], k) == 1, w["word"] * 64 + k)), lambda p: p.isNotNull())))


def with_kept(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__n_lines``, ``__n_dropped`` and ``__kept``, the remaining text. Only texts that lose lines move, to meet their bitmap."""
    found = drop_bitmaps(docs, min_chars).select(F.col("doc").alias("__doc"), F.col("own").alias("__own"), F.col("n_dropped").alias("__n_dropped"), F.col("bitmap").alias("__bitmap"))
    on = (F.coalesce("doc_id", F.lit(LAST)) == F.col("__doc")) & (F.xxhash64("text") == F.col("__own"))
    both = met(docs, F.xxhash64("text"), stored(found, "bitmaps"), on, "__own", "left").withColumn("__lines", _split(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), _positions(F.col("__bitmap")))
    kept = F.when(F.col("__bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n"))
    out = both.withColumn("__n_lines", F.size("__lines").cast("long")).withColumn("__kept", kept)
    return out.withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0).cast("long"))).select(*docs.columns, "__n_lines", "__n_dropped", "__kept")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the remaining text; documents that lost lines and have no word left are gone."""
    out = with_kept(docs, min_chars)
    gone = (F.col("__n_dropped") > 0) & (F.trim(F.col("__kept"), F.lit(WHITE)) == "")
    return out.where(~gone).withColumn("text", F.when(F.col("__n_dropped") > 0, F.col("__kept")).otherwise(F.col("text"))).select(*docs.columns)
