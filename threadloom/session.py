"""A session with the settings that the operators rely on, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str, **conf: str) -> SparkSession:
    """UTC, adaptive plans and dynamic partition overwrite, and whatever else is given."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    return SparkSession.builder.appName(name).config(map=fixed | conf).getOrCreate()


#: Rows of an Arrow batch, so that batches of long texts stay small in executors and their Python workers.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Parquet's reads of many ranges at once; on local disks each of Java's reading threads keeps a direct buffer as large as the largest range it read.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that it need not be installed there.

    Where the session has Spark's own sizes of Arrow batches, they become ``BATCH_ROWS`` and
    ``BATCH_BYTES``; sizes that someone chose stay. The same holds for ``VECTORED``, which is switched off.
    """
    for key, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) in (usual, f"{usual}b", "64MB"):
            spark.conf.set(key, ours)
    context = spark.sparkContext
    if spark.conf.get(VECTORED, None) is None and context.getConf().get(f"spark.hadoop.{VECTORED}") is None:
        spark.conf.set(VECTORED, "false")
    if getattr(context, "_threadloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="threadloom-")) / "threadloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))
    context._threadloom_shipped = True
