"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that they need no copy of the folder.

    The archive is served by the driver; workers import it wherever they run.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="rollmark-package-"), "rollmark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on; the session's other settings are left alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the session's own, or a scratch one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rollmark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


_TABLES: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it from there afterwards.

    This cuts lineage, and later steps read only the columns they need and know the size. The
    tables stay until ``release`` or the end of a ``run``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote, but for the first ``keep``; no frame may need them any more."""
    jvm, tables = spark._jvm, _TABLES.get(spark.sparkContext.applicationId, [])
    while len(tables) > keep:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """``with run(spark):`` removes at its end what was materialised inside; write results before that."""
    before = len(_TABLES.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of very few partitions out to all cores before heavy row-wise work.

    Only inputs too small to fill the cluster are moved; a large table stays as it is read.
    Rows are placed by hash, which unlike round-robin needs no sort to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *df.columns) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key to the session's full number of partitions.

    For Python folds: adaptive execution would merge small partitions into one task by
    their bytes, although it is the per-row work that counts.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast after counting it; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


BROADCAST_BYTES = 256 * 1024 * 1024


def broadcast_vectors(vectors: DataFrame, column: str = "embedding", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table of vectors for broadcast if all of it is small; a larger one joins by shuffle.

    Rows that look vectors up by key are far more than the vectors, so carrying a vector along with
    each of them through a shuffle costs many times the table.
    """
    values = F.sum(F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)))
    rows, values = vectors.agg(F.count(F.lit(1)), F.coalesce(values, F.lit(0))).first()
    width = 4 if "float" in vectors.schema[column].dataType.simpleString() else 8
    return F.broadcast(vectors) if rows * 64 + values * width <= max_bytes else vectors
