"""Readers for metadata, pair lists, labelled folders, galleries, caches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollmark import schemas
from rollmark.functions.scalars import image_path
from rollmark.operators.gallery import validate
from rollmark.operators.ordering import positions

IMAGE_PATTERN = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SPLITS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.VERIFICATION_PAIRS)


def read_identity_counts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.IDENTITY_COUNTS)


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """Fold-structured pair list: a header ``folds pairs``, then per fold n genuine and n impostor lines.

    A line's fold and class follow from its ordinal by arithmetic, so the lines can be
    parsed in any task. Genuine lines read ``name i j``, impostor lines ``name1 i name2 j``.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            F.trim("value").alias("line"),
        )
        .where("line <> ''")
    )
    # files follow each other by name; a row number per file, of which there are few
    files = lines.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).alias("_number"))
    numbered = positions(lines.join(files, "_file"), (), "_number", "_pos", ["_block", "_row"])
    parts = F.split("line", r"\s+")
    per_fold = numbered.where("_pos = 1").select(parts[1].cast("bigint").alias("n")).scalar()
    rows = numbered.where("_pos > 1").withColumns({"n": per_fold, "p": parts, "pair_id": F.col("_pos") - 1})
    zero = F.col("pair_id") - 1
    same = F.pmod(F.floor(zero / F.col("n")), F.lit(2)) == 0
    name1, name2 = F.get("p", 0), F.when(same, F.get("p", 0)).otherwise(F.get("p", 2))
    first, second = F.get("p", 1), F.when(same, F.get("p", 2)).otherwise(F.get("p", 3))
    return rows.select(
        "pair_id",
        (F.floor(zero / (2 * F.col("n"))) + 1).cast("int").alias("fold"),
        name1.alias("identity1"),
        image_path(name1, first).alias("image1_rel_path"),
        name2.alias("identity2"),
        image_path(name2, second).alias("image2_rel_path"),
        same.cast("int").alias("is_same"),
    )


def list_labelled_files(spark: SparkSession, folder: str, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Files under ``folder`` with the identity named by their parent folder; contents stay unread."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    parts = F.split("path", "/")
    identity, name = F.element_at(parts, -2), F.element_at(parts, -1)
    return found.select(
        "path",
        identity.alias("identity"),
        name.alias("image_name"),
        F.concat_ws("/", identity, name).alias("relative_path"),
        "length",
    )


def hash_files(spark: SparkSession, folder: str, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """SHA-256 of each file's content."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return found.select("path", F.sha2("content", 256).alias("file_hash"))


def load_gallery(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Saved gallery; an invalid one is refused."""
    templates = spark.read.schema(schemas.TEMPLATES).parquet(path)
    report = validate(templates, dim).first()
    if not report["valid"]:
        raise ValueError(f"invalid gallery at {path}: {report['errors']}")
    return templates


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors by key; a NULL vector marks a key that could not be embedded."""
    return spark.read.schema(schemas.EMBEDDING_CACHE).parquet(path)


def read_detection_log(spark: SparkSession, path: str) -> DataFrame:
    """The appended (name, time) lines; every part has a header, whether a batch or the live job wrote it."""
    return _csv(spark, path, schemas.DETECTION_LOG)


def read_scored_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _csv(spark, path, schema)


def read_quality_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def observation_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Observation files as a stream; each trigger takes a bounded number of files."""
    return spark.readStream.schema(schemas.OBSERVATIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_attendance(spark: SparkSession, path: str, dates: Sequence[str] = ()) -> DataFrame:
    """Attendance table; given dates prune its partitions."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("date").isin([d for d in dates])) if dates else rows
