"""Writers for galleries, caches, logs, exports, reports and the attendance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollmark.operators.attendance import csv_export, json_export
from rollmark.operators.gallery import validate


def save_gallery(templates: DataFrame, path: str, dim: int) -> None:
    """Write a gallery as Parquet unless it is invalid."""
    report = validate(templates, dim).first()
    if not report["valid"]:
        raise ValueError(f"gallery not saved: {report['errors']}")
    columns = ["template_id", "identity", "embedding", "source_path"]
    missing = {c: F.lit(None).cast("string") for c in columns if c not in templates.columns}
    templates.withColumns(missing).select(*columns).write.mode("overwrite").parquet(path)


def write_embedding_cache(vectors: DataFrame, path: str) -> None:
    """Append keys with their vectors; a failed key has a NULL vector."""
    vectors.select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)


def write_quality_cache(scored: DataFrame, path: str) -> None:
    scored.write.mode("append").parquet(path)


def append_detection_log(recognised: DataFrame, path: str) -> None:
    """Append a (name, time) line per recognised row, sessions or not."""
    lines = recognised.where("recognized").select(
        F.col("identity").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")
    )
    lines.write.mode("append").option("header", True).csv(path)


def export_attendance_csv(records: DataFrame, path: str) -> None:
    csv_export(records).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_attendance_json(records: DataFrame, path: str) -> None:
    json_export(records).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_scored_pairs(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write report rows as JSON objects."""
    report.write.mode("overwrite").json(path)


def write_attendance(records: DataFrame, path: str) -> None:
    """Replace the date partitions that ``records`` touches and no others.

    Rebalancing by date gathers small days into few files and splits a very large day.
    """
    (
        records.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )
