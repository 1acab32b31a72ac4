"""The structural index: tables of digests, enums and numbers, a partition for each commit.

Conversations are indexed in batches of ``BATCH`` of each shard, of all shards at once; one
commit has the next batch of each, so small shards share files. Its rows are written to all
tables first and its batches to ``shards`` last, so a batch counts when it is committed, and a
shard when its last one is. A run that was cut off goes on behind what is committed: a commit
is named by its batches, so it is written over if they are tried again, and read by nobody else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as K
from ..functions.digests import digest
from ..functions.errors import need
from ..sources.strict_json import load
from . import linkage
from .conversations import index_rows

METRICS = K.METRICS.split()
_METRIC_STRUCT = ", ".join(f"{m}: long" for m in METRICS)
ANALYSED = (
    "shard long, ordinal int, "
    f"conversation struct<identity_digest: string, structural_digest: string, create_time: double, update_time: double, current_digest: string, metrics: struct<{_METRIC_STRUCT}>, anomalies: map<string, long>>, "
    "nodes array<struct<node_digest: string, parent_digest: string, message_digest: string, is_message: boolean, role: string, content_type: string, create_time: double, update_time: double, active: boolean>>, "
    "refs array<struct<node_digest: string, reference_ordinal: int, reference_digest: string, field_path_digest: string, kind: string, value: string>>"
)
#: Conversations of a shard between commits.
BATCH = 1 << 16
TABLES = ("conversations", "nodes", "attachment_refs", "attachment_links")
_REF = ["shard", "conversation_ordinal", "node_digest", "reference_ordinal"]


def analysed(raw: DataFrame) -> DataFrame:
    """Conversations (shard, ordinal, payload) decoded and indexed, each where it was read; rows leave as Arrow structs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(ANALYSED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, ordinal, payload in zip(*(b[c].to_pylist() for c in ("shard", "ordinal", "payload"))):
                row = index_rows(load(payload.encode()), shard, ordinal)
                talk = row["conversation"]
                out.append({"shard": shard, "ordinal": ordinal, "conversation": talk | {"anomalies": list(talk["anomalies"].items())}, "nodes": row["nodes"], "refs": row["refs"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return raw.select("shard", "ordinal", "payload").mapInArrow(run, schema)


def tables(rows: DataFrame, aliases: linkage.Aliases) -> dict[str, DataFrame]:
    """The four tables from analysed conversations; values of references are dropped here."""
    spark = rows.sparkSession
    at = [F.col("shard"), F.col("ordinal").alias("conversation_ordinal")]
    refs = rows.select(*at, F.explode("refs").alias("r")).select("shard", "conversation_ordinal", "r.*")
    alias, methods, candidates = aliases.tables(spark)
    known = linkage.resolved(refs, alias, methods, candidates, _REF)
    return {
        "conversations": rows.select("shard", "ordinal", "conversation.*"),
        "nodes": rows.select(*at, F.explode("nodes").alias("n")).select("shard", "conversation_ordinal", "n.*"),
        "attachment_refs": known.select(*_REF, "reference_digest", "field_path_digest", "kind", "resolution"),
        "attachment_links": linkage.targets(known, alias, candidates, _REF),
    }


class Index:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _place(self, name: str) -> tuple:
        """Hadoop's file system and path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        store, at = self._place(name)
        return store.exists(at)

    def bind(self, fingerprint: str) -> None:
        """The first run leaves its fingerprint; a later one must have the same."""
        if self._exists("run"):
            need(self.spark.read.parquet(f"{self.folder}/run").where("key = 'fingerprint'").first()["value"] == fingerprint, "INDEX_VERSION_CHANGED")
        else:
            self.spark.createDataFrame([("fingerprint", fingerprint)], "key string, value string").coalesce(1).write.parquet(f"{self.folder}/run")

    def batches(self) -> DataFrame:
        """A row for each committed batch, of the first commit that has it."""
        schema = "committed long, status string, shard long, batch long, commit string"
        if not self._exists("shards"):
            return self.spark.createDataFrame([], schema)
        first = F.min_by(F.struct("committed", "status", "commit"), "commit").alias("first")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/shards").groupBy("shard", "batch").agg(first).select("first.committed", "first.status", "shard", "batch", "first.commit")

    def shards(self) -> DataFrame:
        """(shard, committed, status): how many conversations of each shard are committed, ``complete`` or still ``indexing``."""
        done = F.max(F.col("status") == "complete")
        return self.batches().groupBy("shard").agg(F.max("committed").alias("committed"), F.when(done, "complete").otherwise("indexing").alias("status"))

    def complete(self) -> set[int]:
        return {r["shard"] for r in self.shards().where("status = 'complete'").select("shard").collect()}  # shards: few

    def _put(self, name: str, commit: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/commit={commit}")

    def sweep(self) -> None:
        """Removes what runs that were cut off left without a commit; for who alone writes to the index."""
        kept = {f"commit={r['commit']}" for r in self.batches().select("commit").distinct().collect()}
        for name in TABLES:
            store, at = self._place(name)
            for status in store.listStatus(at) if store.exists(at) else ():
                if status.getPath().getName().startswith("commit=") and status.getPath().getName() not in kept:
                    store.delete(status.getPath(), True)

    def add(self, shards: list[int], raw: DataFrame, aliases: linkage.Aliases, interrupt: bool = False, batch: int = BATCH, committed: Callable[[], object] | None = None) -> list[int]:
        """Indexes those of ``shards`` that are not complete, from what is committed on; gives them.

        ``committed`` is called after each commit; ``interrupt`` stops before the first, as a crash would.
        """
        state = {r["shard"]: r for r in self.shards().collect()}
        todo = {s: state[s]["committed"] if s in state else 0 for s in shards if s not in state or state[s]["status"] != "complete"}
        begun = list(todo)
        if resumed := [s for s, n in todo.items() if n]:
            ends = {r["shard"]: r["n"] for r in raw.where(F.col("shard").isin(resumed)).groupBy("shard").agg(F.max("ordinal").alias("n")).collect()}
            need(all(ends.get(s, -1) + 1 >= todo[s] for s in resumed), "CHECKPOINT_PAST_EOF")
        while todo:
            starts = self.spark.createDataFrame([(s, n) for s, n in sorted(todo.items())], "shard long, batch long")
            commit = f"c{digest([[s, n] for s, n in sorted(todo.items())])}"
            part = raw.join(F.broadcast(starts), "shard").where((F.col("ordinal") >= F.col("batch")) & (F.col("ordinal") < F.col("batch") + batch))
            rows = analysed(part).persist()
            try:
                for name, df in tables(rows, aliases).items():
                    self._put(name, commit, df.join(F.broadcast(starts), "shard"))
                need(not interrupt, "SYNTHETIC_INTERRUPT")
                n = F.coalesce("n", F.lit(0))
                done = starts.join(rows.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left")
                done = done.select((F.col("batch") + n).alias("committed"), F.when(n < batch, "complete").otherwise("indexing").alias("status"), "shard", "batch")
                self._put("shards", commit, done.coalesce(1))
            finally:
                rows.unpersist()
            if committed:
                committed()
            state = {r["shard"]: r for r in self.shards().collect()}
            todo = {s: state[s]["committed"] for s in todo if state[s]["status"] != "complete"}
        return begun

    def add_shard(self, shard: int, raw: DataFrame, aliases: linkage.Aliases, interrupt: bool = False, batch: int = BATCH) -> bool:
        """One shard; False where it is complete."""
        return bool(self.add([shard], raw.where(F.col("shard") == shard), aliases, interrupt, batch))

    def table(self, name: str) -> DataFrame:
        """Rows of complete shards."""
        if not self._exists(name):
            return self.spark.createDataFrame([], _schema(name))
        done = self.batches().join(self.shards().where("status = 'complete'").select("shard"), "shard", "left_semi").select("shard", "batch", "commit")
        return self.spark.read.schema(f"{_schema(name)}, batch long, commit string").parquet(f"{self.folder}/{name}").join(done, ["shard", "batch", "commit"], "left_semi").drop("batch", "commit")


def _schema(name: str) -> str:
    ref = "conversation_ordinal int, node_digest string, reference_ordinal int"
    return {
        "conversations": f"ordinal int, identity_digest string, structural_digest string, create_time double, update_time double, current_digest string, metrics struct<{_METRIC_STRUCT}>, anomalies map<string, long>, shard long",
        "nodes": "conversation_ordinal int, node_digest string, parent_digest string, message_digest string, is_message boolean, role string, content_type string, create_time double, update_time double, active boolean, shard long",
        "attachment_refs": f"{ref}, reference_digest string, field_path_digest string, kind string, resolution string, shard long",
        "attachment_links": f"{ref}, method string, entry_ordinal int, shard long",
    }[name]
