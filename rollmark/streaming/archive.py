"""Keyed tables that micro-batches replace rows of, safe under replay.

Rows are dealt by key to a fixed number of small partitions. A change writes the whole of each
partition it touches as a new version, from the last version before it and the new rows. Nothing is
overwritten that a replay still needs: doing a change again reads the same older version and writes
the same newer one. Readers take the newest version of each partition; older ones than the last two
are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of each partition, oldest first, from the names of the folders."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*"))
    out: dict[int, list[int]] = {}
    for status in found or []:
        folder = status.getPath()
        out.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return {bucket: sorted(versions) for bucket, versions in out.items()}


def _folder(path: str, bucket: int, version: int) -> str:
    return f"{path}/bucket={bucket}/version={version}"


def read_archive(spark: SparkSession, path: str, schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest rows, or those before a version; only of some partitions if they are named."""
    folders = []
    for bucket, versions in _versions(spark, path).items():
        known = [v for v in versions if before is None or v < before]
        if known and (buckets is None or bucket in buckets):
            folders.append(_folder(path, bucket, known[-1]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace_rows(changes: DataFrame, path: str, key: str, version: int, buckets: int = BUCKETS) -> None:
    """Rows of ``changes`` (one for each ``key``) replace those of the same key, as version ``version``.

    ``buckets`` must stay what it was when the table was begun. At most so many numbers come to the driver.
    """
    spark = changes.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r.bucket for r in changes.select(place.alias("bucket")).distinct().collect())
    if not touched:
        return
    old = read_archive(spark, path, schema, version, touched).join(changes.select(key), key, "left_anti")
    rows = old.select(*changes.columns).unionByName(changes).withColumns({"bucket": place, "version": F.lit(version)})
    writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket", "version").parquet(path)
    jvm = spark._jvm
    for bucket, versions in _versions(spark, path).items():
        for stale in [v for v in versions if v < version][:-1]:
            target = jvm.org.apache.hadoop.fs.Path(_folder(path, bucket, stale))
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
