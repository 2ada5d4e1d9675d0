"""Dataset checks: leakage between splits, sample counts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollmark.functions.scalars import with_rounding

SPLITS = ["enrollment", "validation", "test"]


def leaked_hashes(splits: DataFrame) -> DataFrame:
    """Content hashes found in more than one split, with a flag per split.

    Three flags per hash are kept instead of the rows, so content with very many copies is
    combined before the shuffle.
    """
    flags = splits.groupBy("file_hash").agg(*[F.bool_or(F.col("split") == s).alias(s) for s in SPLITS])
    held = sum((F.col(s).cast("int") for s in SPLITS), F.lit(0))
    return flags.where(held > 1)


def leakage_report(splits: DataFrame) -> DataFrame:
    """Leaked hashes per pair of splits and their total."""
    e, v, t = (F.col(s) for s in SPLITS)
    return (
        leaked_hashes(splits)
        .agg(
            F.count_if(e & v).alias("enrollment_validation"),
            F.count_if(e & t).alias("enrollment_test"),
            F.count_if(v & t).alias("validation_test"),
        )
        .withColumn(
            "cross_split_leakage_count",
            F.col("enrollment_validation") + F.col("enrollment_test") + F.col("validation_test"),
        )
    )


def split_counts(splits: DataFrame) -> DataFrame:
    """Items per split and in total for each identity."""
    return splits.groupBy("identity").agg(
        F.count(F.lit(1)).alias("total_images"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in SPLITS],
    )


def sample_errors(counts: DataFrame, min_items: int = 20) -> DataFrame:
    """One row per unmet minimum of an identity."""
    too_few = F.when(
        F.col("total_images") < min_items, F.concat(F.lit("fewer than "), F.lit(min_items), F.lit(" images"))
    )
    empty = [F.when(F.col(f"{s}_count") < 1, F.lit(f"no {s} images")) for s in SPLITS]
    return counts.select("identity", F.explode(F.array_compact(F.array(too_few, *empty))).alias("error"))


def dataset_summary(splits: DataFrame) -> DataFrame:
    """Totals by split and images per identity, in one row."""
    counts = split_counts(splits)
    summary = counts.agg(
        F.count(F.lit(1)).alias("total_identities"),
        F.sum("total_images").alias("total_images"),
        *[F.sum(f"{s}_count").alias(s) for s in SPLITS],
        F.min("total_images").alias("images_per_identity_min"),
        F.max("total_images").alias("images_per_identity_max"),
        F.avg("total_images").alias("images_per_identity_mean"),
    )
    return with_rounding(summary, {"images_per_identity_mean": 2})


def resolutions(splits: DataFrame) -> DataFrame:
    """Distinct image sizes with their counts."""
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return splits.groupBy(size.alias("resolution")).agg(F.count(F.lit(1)).alias("images"))


def missing_files(splits: DataFrame, listing: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """Rows whose file is not in the folder listing (column ``relative_path``)."""
    files = listing.select(F.col("relative_path").alias(path_col)).distinct()
    return splits.join(files, path_col, "left_anti")


def flag_existing(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Pairs with a flag per side that says whether its file is in the listing."""
    for side in ("1", "2"):
        files = listing.select(F.col("relative_path").alias(f"image{side}_rel_path")).distinct()
        pairs = pairs.join(files.withColumn("_found", F.lit(True)), f"image{side}_rel_path", "left")
        pairs = pairs.withColumn(f"image{side}_exists", F.coalesce("_found", F.lit(False))).drop("_found")
    return pairs
