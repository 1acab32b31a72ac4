"""Benchmark decontamination, with DataFrame functions only.

Every window of ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window) is a row of a hash table. Documents are scanned once: each word position
hashes its window in generated code and probes that table; a hit is verified by
comparing the words. Hits become disjoint spans of words per document, which can be
cut, or reject the document.

Scale: the table of windows is broadcast when its measured size is at most
``BROADCAST_BYTES``; then the only shuffle has a row per document and per hit, not per
word. Beyond, a bitmap of the windows' hashes, of a fixed size, is broadcast instead, and
only positions that it lets pass are shuffled to meet the table, each with its own window's
words. Overlapping hits are merged by a window over one document's hits in order of
position, which can spill.

Edge cases: null or empty texts have no words and no hits; items without words are
ignored; items with one id count as one item, a null id as ''; repeated rows of
documents each come back; documents with one id and different texts are told apart
by a hash of the text; an empty benchmark or table gives no hits or no rows; other
columns are kept by ``cleaned``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._sql import WORD, ascii_lower, bitmap, marked, met
from ._store import stored

WINDOW = 13
PERCENT = 5
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _word_hashes(words: Column) -> Column:
    """Numbers in place of words: windows of numbers are hashed in place, without an object for each word."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, length, passage, items): each distinct window and the items that have it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(ascii_lower(F.col("text"))).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(size)))
    each = items.select("item", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    each = each.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("w"))
    passages = each.groupBy("length", F.array_join("w", " ").alias("passage")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    passages = passages.withColumn("h", _word_hashes(F.split("passage", " ")))
    key = F.lit(None).cast("bigint")
    for n in range(size, 0, -1):
        key = F.when(F.col("length") == n, F.xxhash64(*(F.get("h", F.lit(k)) for k in range(n)))).otherwise(key)
    return passages.select(key.alias("key"), "length", "passage", "items")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, first, from_, to, items): a row for each hit, and one with null ``from_`` for each document.

    ``first`` marks one row of each row of ``docs``. Hashes are of words lower-cased by
    all of Unicode, one by one: they agree wherever words lower-cased by A-Z agree,
    which the comparison of the words then settles.
    """
    table = stored(windows(benchmark, size), "windows")
    lengths = [r[0] for r in table.select("length").distinct().orderBy(F.desc("length")).collect()] or [size]  # at most WINDOW values
    held = table.agg(F.coalesce(F.sum(F.octet_length("passage") + F.octet_length(F.array_join("items", ",")) + 96), F.lit(0))).first()[0]
    raw = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("raw"))
    raw = raw.withColumn("h", _word_hashes(F.col("raw"))).withColumn("n_words", F.size("raw").cast("long"))
    at = raw.select("doc_id", "text_hash", "n_words", "raw", "h", F.posexplode_outer("h").alias("at", "_w"))

    def probe(n: int) -> Column:
        return F.when(F.col("at") + n <= F.col("n_words"), F.xxhash64(*(F.get("h", F.col("at") + k) for k in range(n))))

    if len(lengths) == 1:
        at = at.withColumn("n", F.lit(lengths[0])).withColumn("probe", probe(lengths[0]))
    else:
        at = at.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("n"), probe(n).alias("probe")) for n in lengths))))
    said = F.translate(F.array_join(F.slice("raw", F.col("at") + 1, F.col("n")), " "), ascii_uppercase, ascii_lowercase)
    first = (F.coalesce(F.col("at"), F.lit(0)) == 0) & (F.col("n") == lengths[0])
    if held > broadcast_bytes:
        seen = marked(at.where(F.col("probe").isNotNull() | first), F.col("probe"), bitmap(table, "key"), "near").withColumn("first", first).where("first OR near")
        seen = stored(seen.select("doc_id", "text_hash", "n_words", "first", "near", "at", "n", "probe", F.when(F.col("near"), said).alias("said")), "probes")
        both = seen.where("near").join(table, (F.col("probe") == F.col("key")) & (F.col("n") == F.col("length")) & (F.col("said") == F.col("passage")))
        found = both.select("doc_id", "text_hash", "n_words", F.lit(False).alias("first"), F.col("at").alias("from_"), (F.col("at") + F.col("n")).alias("to"), "items")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        return found.unionByName(seen.where("first").select("doc_id", "text_hash", "n_words", "first", none("int", "from_"), none("int", "to"), none("array<string>", "items")))
    same = said == F.col("passage")
    # not part of the join's condition: as a join key, the words would be put together at every position
    both = at.join(F.broadcast(table), (F.col("probe") == F.col("key")) & (F.col("n") == F.col("length")), "left")
    both = both.withColumn("first", first).withColumn("hit", F.when(F.col("key").isNotNull(), same).otherwise(False)).where(F.col("first") | F.col("hit"))
    hit = F.col("hit")
    return both.select("doc_id", "text_hash", "n_words", "first", F.when(hit, F.col("at")).alias("from_"), F.when(hit, F.col("at") + F.col("n")).alias("to"), F.when(hit, F.col("items")).alias("items"))


def spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each (doc_id, text): n_words, n_hit, spans of hit words, items, contaminated and how many copies of the row there are."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("from_", "to")
    before = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = hits(docs, benchmark, size, broadcast_bytes).withColumn("before", before)
    fresh = F.greatest(F.col("to") - F.greatest("from_", "before"), F.lit(0))
    seen = seen.withColumn("fresh", F.when(F.col("from_").isNotNull(), fresh).otherwise(0))
    out = seen.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum("fresh").cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.when(F.col("fresh") > 0, F.struct((F.col("to") - F.col("fresh")).alias("from_"), "to")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.col("first").cast("int")).alias("copies"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each row of ``docs``."""
    out = spans(docs, benchmark, broadcast_bytes=broadcast_bytes).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def cleaned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """``docs`` without contaminated documents; from the others, hit words are cut with the separators after them."""
    found = spans(docs, benchmark, size, percent).where(F.col("n_hit") > 0)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"), F.col("contaminated").alias("__gone"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    both = met(docs, F.xxhash64("text"), stored(found, "spans"), on, "__hash", "left")
    words, gaps = _words(F.col("text")), F.split("text", WORD, -1)
    hit = F.flatten(F.transform("__spans", lambda s: F.sequence(s["from_"], s["to"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), hit)
    rest = F.concat(F.get("__gaps", F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get(F.col("__words"), i), F.get(F.col("__gaps"), i + 1))), ""))
    both = both.where(~F.coalesce("__gone", F.lit(False))).withColumn("__words", F.when(F.col("__spans").isNotNull(), words)).withColumn("__gaps", F.when(F.col("__spans").isNotNull(), gaps))
    both = both.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest))
    return both.select(*docs.columns)
