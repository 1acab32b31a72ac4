"""Structured Streaming over a folder of shard files: each new file becomes a complete shard of an index.

Each file is a row of a streaming ``binaryFile`` source; a micro-batch indexes its shards
through ``Index.add_shard``, which passes over complete shards, so a batch that is run again
after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.errors import need
from ..operators.discovery import shard_of
from ..operators.index import Index
from ..operators.linkage import Aliases
from ..sources.zip_members import read_arrays

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, index: Index, aliases: Aliases, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the query; with ``once`` it ends when all files that are there are done."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder).select("path")

    def batch(df: DataFrame, _: int) -> None:
        for r in df.orderBy("path").collect():  # a path for each new file
            path = r["path"].removeprefix("file:")
            shard = shard_of(path.rsplit("/", 1)[-1])
            need(shard is not None, "DISCOVERY_SHARD_NAME")
            index.add_shard(shard, read_arrays(spark, {shard: path}), aliases)

    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time and type with a watermark; ``events`` may stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
