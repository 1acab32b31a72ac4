"""Column expressions that several native operators share."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

#: Words of letters, digits and all above ASCII; of texts that aren't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WHITE = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else: ``lower`` where the text is all ASCII, which is faster, else ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ascii_uppercase, ascii_lowercase))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: 64-bit words of a bitmap, that is 8 MiB of bits: the bound of what is broadcast, however many hashes it holds.
BITMAP_WORDS = 1 << 20


def _place(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(__word, __bits): a bit for each 64-bit hash, as a stored table of at most ``BITMAP_WORDS`` rows."""
    word, bit = _place(F.col(column))
    return stored(hashes.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits")), "bitmap")


def marked(rows: DataFrame, h: Column, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: false only where the bitmap lacks the hash."""
    word, bit = _place(h)
    both = rows.join(F.broadcast(bits), word == F.col("__word"), "left")
    return both.withColumn(name, F.coalesce(F.getbit("__bits", bit) == 1, F.lit(False))).drop("__word", "__bits")


def met(docs: DataFrame, h: Column, found: DataFrame, on: Column, hash_column: str, how: str) -> DataFrame:
    """``docs`` joined (``left`` or ``left_anti``) with ``found``, a stored table whose ``hash_column`` has ``h`` of each row that may match.

    Rows that a bitmap of ``found`` rules out stay where they are; the others meet ``found``
    by a join of Spark's choice: a broadcast within its limit, else a merge join, whose large
    partitions adaptive execution splits.
    """
    seen = marked(docs, h, bitmap(found, hash_column), "__near")
    near = seen.where("__near").drop("__near").join(found, on, how)
    far = seen.where("NOT __near").drop("__near")
    if how == "left":
        far = far.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields))
    return near.unionByName(far)
