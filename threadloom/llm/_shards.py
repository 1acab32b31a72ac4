"""Deterministic range shards: which rows go to which file depends on the data alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

#: Shards, and key blocks of a level, at most; so many rows reach the driver and are broadcast, some tens of megabytes.
BLOCKS = 1 << 18


def _blocks(df: DataFrame, key: Column, size: str) -> list[tuple]:
    """(id, sub, held, least, most) of each block of the rows whose interval is still open."""
    sub = F.call_function("div", key - F.col("__lo"), F.col("__width"))
    held = df.groupBy("__id", sub.alias("__sub")).agg(F.sum(F.col(size).cast("long")).alias("held"), F.min(key).alias("least"), F.max(key).alias("most"))
    return sorted(tuple(r) for r in held.collect())


def range_sharded(df: DataFrame, key: str, size: str, shard_bytes: int, onto: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``onto``, or else ``df``, with ``__shard``, ascending with the integer ``key``, and how many there are; null keys come last.

    The span of keys is cut into blocks of one width, whose bytes (``size``) are summed
    exactly. A block heavier than a shard is cut again, between its own least and greatest
    key, and so on until blocks fit or hold one key, so ids far from the others cost another
    pass over keys and sizes and nothing else. Runs of blocks of about ``shard_bytes`` make a
    shard; more than that where there would be over ``BLOCKS`` shards.
    """
    at = F.coalesce(F.col(key), F.lit(2**63 - 1)).cast("decimal(38,0)")
    slim = stored(df.select(key, size), "shard-sizes")
    low, high, total = slim.agg(F.min(at), F.max(at), F.sum(F.col(size).cast("long"))).first()
    if low is None:
        return (onto if onto is not None else df).withColumn("__shard", F.lit(0)), 1
    target = max(shard_bytes, -(-int(total or 0) // (BLOCKS // 4)))
    spark, wide = df.sparkSession, "decimal(38,0)"
    schema = f"__id int, __sub long, __next int, __lo {wide}, __width {wide}"
    opened = lambda rows: rows.withColumn("__id", F.lit(0)).withColumn("__lo", F.lit(low).cast(wide)).withColumn("__width", F.lit((int(high) - int(low)) // BLOCKS + 1).cast(wide))
    sub = F.call_function("div", at - F.col("__lo"), F.col("__width"))

    def stepped(rows: DataFrame, level: DataFrame) -> DataFrame:
        """Rows of blocks that were cut again, with their new interval."""
        inner = level.select("__id", "__sub", F.col("__next").alias("_id"), F.col("__lo").alias("_lo"), F.col("__width").alias("_width"))
        return rows.withColumn("__sub", sub).join(F.broadcast(inner), ["__id", "__sub"]).drop("__id", "__sub", "__lo", "__width").withColumnsRenamed({"_id": "__id", "_lo": "__lo", "_width": "__width"})

    slim = opened(slim)
    levels, leaves, ids = [], [], 0
    while True:
        heavy = []
        for i, s, held, least, most in _blocks(slim, at, size):
            if (held or 0) > target and most > least:
                heavy.append((i, s, int(held), int(least), int(most)))
            else:
                leaves.append((int(least), len(levels), i, s, held or 0))
        if not heavy:
            break
        every = sum(h[2] for h in heavy)
        cut = []
        for i, s, held, least, most in heavy:
            ids += 1
            parts = max(2, min(16 * held // target, BLOCKS * held // every))
            cut.append((i, s, ids, Decimal(least), Decimal((most - least) // parts + 1)))
        levels.append(spark.createDataFrame(cut, schema))
        slim = stepped(slim, levels[-1])
    shard, full, named = 0, 0, [[] for _ in range(len(levels) + 1)]
    for _, level, i, s, held in sorted(leaves):
        if full and full + held > target:
            shard, full = shard + 1, 0
        full += held
        named[level].append((i, s, shard))
    rows = opened(onto if onto is not None else df)
    for k, names in enumerate(named):
        table = spark.createDataFrame(names, "__id int, __sub long, __name int")
        rows = rows.withColumn("__sub", sub).join(F.broadcast(table), ["__id", "__sub"], "left")
        rows = rows.withColumn("__shard", F.coalesce("__shard", "__name") if k else F.col("__name")).drop("__name")
        if k < len(levels):
            inner = levels[k].select("__id", "__sub", F.col("__next").alias("_id"), F.col("__lo").alias("_lo"), F.col("__width").alias("_width"))
            rows = rows.join(F.broadcast(inner), ["__id", "__sub"], "left").drop("__id", "__sub", "__lo", "__width").withColumnsRenamed({"_id": "__id", "_lo": "__lo", "_width": "__width"})
    return rows.drop("__id", "__sub", "__lo", "__width"), shard + 1


def by_shard(sharded: tuple[DataFrame, int], *order: str) -> DataFrame:
    """A task for each shard, its rows in ascending order."""
    df, n = sharded
    return df.repartitionById(n, "__shard").sortWithinPartitions("__shard", *order)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def committed(manifest: DataFrame, folder: str) -> DataFrame:
    """Gives each file of ``manifest`` (columns ``tmp`` and ``name``) its own name; the manifest, which is stored already, names only files of tasks that ended well.

    A move that was done before is passed over, so a lost executor's moves can run again.
    """

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for rows in parts:
            for tmp, name in zip(rows["tmp"], rows["name"]):
                if store.get_file_info(f"{root}/{tmp}").type == fs.FileType.File:
                    store.move(f"{root}/{tmp}", f"{root}/{name}")
            yield rows[["name"]]

    moved = manifest.select("tmp", "name").repartition(16, "name").mapInPandas(move, "name string").count()
    if moved != manifest.count():
        raise RuntimeError("COMMIT_INCOMPLETE")
    return manifest.drop("tmp")


class Sink:
    """A file under a temporary name."""

    def __init__(self, folder: str, name: str, token: str):
        self.store, self.root = filesystem(folder)
        self.name, self.tmp, self.written = name, f"_tmp-{token}/{name}", 0
        self.store.create_dir(f"{self.root}/_tmp-{token}", recursive=True)
        self.out = self.store.open_output_stream(f"{self.root}/{self.tmp}")

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)


Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
