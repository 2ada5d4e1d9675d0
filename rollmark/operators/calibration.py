"""Threshold sweep, calibration strategies and their stability over identity folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.functions.scalars import round_half_even, with_rounding
from rollmark.operators.metrics import (
    attach_totals,
    class_counts,
    compact_pairs,
    equal_error_rate,
    ratio,
    roc_points,
    roc_summary,
    valid_pairs,
)
from rollmark.operators.ordering import hash60, positions
from rollmark.session import broadcast_if_small, materialize

#: Sweep range and steps, and the false-accept target.
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEP = -0.2, 0.95, 0.001
STABILITY_STEP = 0.005
TARGET_FAR = 0.001
MIN_TRAIN_PAIRS = 100
MAX_GRID = 100_000

RATES = ["accuracy", "far", "frr", "precision", "recall", "f1", "acceptance_rate"]


def grid_size(low: float, high: float, step: float) -> int:
    """Number of sweep thresholds from ``low`` to ``high`` inclusive."""
    size = math.ceil((high + step / 2 - low) / step)
    if size > MAX_GRID:
        raise ValueError(f"a sweep of {size} thresholds is too fine; use a larger step")
    return size


def _tau(slot: str, low: float, step: float, size: int) -> Column:
    """Threshold number ``slot`` (from 1) of the grid, rounded to 4 places.

    Steps of whole ten-thousandths are counted in integers, which gives the same doubles.
    """
    start, stride = round(low * 1e4), round(step * 1e4)
    if all((start + i * stride) / 1e4 == round(low + i * step, 4) for i in range(size)):
        return F.expr(f"({start}L + ({slot} - 1) * {stride}L) / 1e4D")
    return round_half_even(f"({float(low)}D + ({slot} - 1) * {float(step)}D)", 4)


def _with_reach(pairs: DataFrame, size: int, low: float, step: float) -> DataFrame:
    """Add ``slot``: how many grid thresholds the score reaches, by comparison with the rounded grid."""
    guess = f"cast(greatest(0, least({size}, floor((raw_score - {float(low)}D) / {float(step)}D) + 1)) as bigint)"
    reached = {
        f"_r{d}": F.expr(f"_g + {d} >= 1 and _g + {d} <= {size}") & (F.col("raw_score") >= _tau(f"(_g + {d})", low, step, size))
        for d in (0, 1)
    }
    slot = F.expr("case when _r1 then _g + 1 when _r0 then _g else greatest(0L, _g - 1) end")
    return pairs.withColumn("_g", F.expr(guess)).withColumns(reached).withColumn("slot", slot)


def threshold_sweep(
    pairs: DataFrame,
    low: float = SWEEP_LOW,
    high: float = SWEEP_HIGH,
    step: float = SWEEP_STEP,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and rounded rates at every grid threshold.

    Each pair adds to one bin, bins add up from the top: linear in pairs plus grid, one
    shuffle of at most one row per bin and task.
    """
    size = grid_size(low, high, step)
    placed = _with_reach(valid_pairs(pairs), size, low, step)
    binned = placed.groupBy(*group_cols, "slot").agg(*class_counts(pairs))
    slots = F.sequence(F.lit(1).cast("bigint"), F.lit(size).cast("bigint"))
    frame = (
        binned.groupBy(*group_cols)
        .agg(
            F.coalesce(F.sum("pos"), F.lit(0)).alias("genuine"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("impostor"),
        )
        .select("*", F.explode(slots).alias("slot"))
        .withColumn("threshold", _tau("slot", low, step, size))
    )
    above = (
        Window.partitionBy(*group_cols)
        .orderBy(F.col("slot").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        frame.join(binned, [*group_cols, "slot"], "left")
        .withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(above).cast("bigint"))
        .withColumn("fp", F.sum(F.coalesce("neg", F.lit(0))).over(above).cast("bigint"))
        .withColumn("tn", F.col("impostor") - F.col("fp"))
        .withColumn("fn", F.col("genuine") - F.col("tp"))
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = F.col("genuine") + F.col("impostor")
    rates = counted.select(
        *group_cols,
        "threshold",
        "tp",
        "tn",
        "fp",
        "fn",
        ratio(tp + tn, total).alias("accuracy"),
        ratio(fp, F.col("impostor")).alias("far"),
        ratio(fn, F.col("genuine")).alias("frr"),
        ratio(tp, tp + fp, empty=1.0).alias("precision"),
        ratio(tp, F.col("genuine")).alias("recall"),
        ratio(tp + fp, total).alias("acceptance_rate"),
    )
    both = F.col("precision") + F.col("recall")
    rates = rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
    return with_rounding(rates, dict.fromkeys(RATES, 4) | {"far": 6, "frr": 6}).select(
        *group_cols, "threshold", "tp", "tn", "fp", "fn", *RATES
    )


def nearest_row(sweep: DataFrame, threshold: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """The sweep row closest to a threshold column, the lower one on ties."""
    row = F.struct(*[c for c in sweep.columns if c not in group_cols])
    best = F.min_by(row, F.struct(F.abs(F.col("threshold") - threshold), F.col("threshold")))
    return sweep.groupBy(*group_cols).agg(best.alias("_b")).select(*group_cols, "_b.*")


def calibration_strategies(pairs: DataFrame, target_far: float = TARGET_FAR, **sweep_options) -> DataFrame:
    """Operating point of each of five strategies plus which one production should use.

    Ties go to the lowest threshold, except that maximum accuracy and F1 take the upper
    median of the tied rows. All picks come from one aggregation over the sweep.
    """
    pairs = compact_pairs(pairs)
    sweep = threshold_sweep(pairs, **sweep_options)
    facts = roc_summary(pairs)
    whole = Window.partitionBy()

    def tied(rate: str) -> list[Column]:
        same = Window.partitionBy(rate)
        return [
            F.max(rate).over(whole).alias(f"_max_{rate}"),
            F.row_number().over(same.orderBy("threshold")).alias(f"_rank_{rate}"),
            F.count(F.lit(1)).over(same).alias(f"_ties_{rate}"),
        ]

    marked = attach_totals(sweep, (), facts).select("*", *tied("accuracy"), *tied("f1"))
    row = F.struct("threshold", *RATES)
    threshold = F.col("threshold")

    def upper_median(rate: str) -> Column:
        chosen = (F.col(rate) == F.col(f"_max_{rate}")) & (
            F.col(f"_rank_{rate}") == F.floor(F.col(f"_ties_{rate}") / 2) + 1
        )
        return F.max(F.when(chosen, row))

    within = F.col("far") <= F.lit(target_far)
    strict = F.min_by(
        F.when(within, row), F.when(within, F.struct(-F.col("recall"), -F.col("accuracy"), threshold))
    )
    fallback = F.min_by(row, F.struct(F.col("far"), threshold))
    picked = marked.agg(
        F.max("eer").alias("eer"),
        F.max("roc_auc").alias("roc_auc"),
        F.min_by(row, F.struct(F.abs(threshold - F.col("eer_threshold")), threshold)).alias("eer_operating_point"),
        upper_median("accuracy").alias("maximum_accuracy"),
        F.coalesce(strict, fallback).alias("security_oriented_low_far"),
        (F.count_if(within) > 0).alias("low_far_supported"),
        upper_median("f1").alias("f1_optimal"),
        F.min_by(row, F.struct(F.abs(F.col("far") - F.col("frr")), threshold)).alias("far_frr_balanced"),
    )
    names = [
        "eer_operating_point",
        "maximum_accuracy",
        "security_oriented_low_far",
        "f1_optimal",
        "far_frr_balanced",
    ]
    production = F.when(F.col("low_far_supported"), F.lit("security_oriented_low_far")).otherwise(
        F.lit("maximum_accuracy")
    )
    listed = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("point")) for n in names])
    strategy = F.col("_s.strategy")
    low_far = strategy == "security_oriented_low_far"
    return picked.select("*", F.explode(listed).alias("_s")).select(
        strategy.alias("strategy"),
        *[F.col(f"_s.point.{c}").alias(c) for c in ("threshold", *RATES)],
        round_half_even("roc_auc", 4).alias("roc_auc"),
        F.when(strategy == "eer_operating_point", round_half_even("eer", 4)).alias("eer_continuous"),
        F.when(low_far, F.lit(float(target_far))).alias("target_far"),
        F.when(low_far, F.col("low_far_supported")).alias("supported"),
        F.when(
            strategy == "far_frr_balanced", round_half_even("abs(_s.point.far - _s.point.frr)", 6)
        ).alias("far_frr_diff"),
        (strategy == production).alias("recommended"),
    )


def identity_folds(identities: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Assign each identity to one of ``folds`` nearly equal bands of a seeded shuffle."""
    ranked = positions(
        identities.select("identity", hash60(F.lit(seed), F.col("identity")).alias("_h")),
        (),
        "_h",
        "_rank",
        tie_cols=["identity"],
    )
    total = identities.agg(F.count(F.lit(1))).scalar()
    zero = F.col("_rank") - 1
    size = F.floor(total / F.lit(folds))
    longer = F.pmod(total, F.lit(folds))
    edge = longer * (size + 1)
    fold = F.when(zero < edge, F.floor(zero / (size + 1))).otherwise(
        longer + F.floor((zero - edge) / F.greatest(size, F.lit(1)))
    )
    return ranked.select("identity", fold.cast("bigint").alias("fold"))


def fold_training_pairs(pairs: DataFrame, folds: DataFrame, num_folds: int) -> DataFrame:
    """Pairs repeated for each fold that holds neither of their identities (``train_fold``)."""
    folds = broadcast_if_small(folds)
    first = folds.select(F.col("identity").alias("identity1"), F.col("fold").alias("_f1"))
    second = folds.select(F.col("identity").alias("identity2"), F.col("fold").alias("_f2"))
    placed = (
        valid_pairs(pairs)
        .join(first, "identity1")
        .join(second, "identity2")
        .select("_f1", "_f2", "raw_score", "is_same")
    )
    placed = compact_pairs(placed, ["_f1", "_f2"])
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(num_folds - 1).cast("bigint"))
    return (
        placed.select("*", F.explode(every).alias("train_fold"))
        .where((F.col("train_fold") != F.col("_f1")) & (F.col("train_fold") != F.col("_f2")))
        .select("train_fold", "raw_score", "is_same", "weight")
    )


def pair_identities(pairs: DataFrame) -> DataFrame:
    """Distinct identities from both sides of the pairs."""
    return (
        pairs.select(F.col("identity1").alias("identity"))
        .unionByName(pairs.select(F.col("identity2").alias("identity")))
        .distinct()
    )


def stability_thresholds(training: DataFrame) -> DataFrame:
    """EER, maximum-accuracy and low-FAR thresholds of every training set of enough pairs."""
    key = ["train_fold"]
    sizes = training.groupBy(*key).agg(F.sum("weight").alias("train_pairs"))
    enough = sizes.where(F.col("train_pairs") >= MIN_TRAIN_PAIRS)
    errors = equal_error_rate(roc_points(training, group_cols=key), group_cols=key)
    sweep = threshold_sweep(training, step=STABILITY_STEP, group_cols=key)
    tau = F.col("threshold")
    chosen = sweep.groupBy(*key).agg(
        F.min_by(tau, F.struct(-F.col("accuracy"), tau)).alias("max_accuracy_threshold"),
        F.min(F.when(F.col("far") <= TARGET_FAR, tau)).alias("low_far_threshold"),
    )
    return (
        enough.join(errors, key, "left")
        .join(chosen, key, "left")
        .select("train_fold", "train_pairs", "eer_threshold", "max_accuracy_threshold", "low_far_threshold")
    )


def stability_summary(thresholds: DataFrame) -> DataFrame:
    """Mean, population std, min and max of each kind of threshold over the folds."""
    kinds = ["eer_threshold", "max_accuracy_threshold", "low_far_threshold"]
    long = thresholds.unpivot(["train_fold"], kinds, "kind", "threshold").where(F.col("threshold").isNotNull())
    spread = long.groupBy("kind").agg(
        F.avg("threshold").alias("mean"),
        F.stddev_pop("threshold").alias("std"),
        F.min("threshold").alias("min"),
        F.max("threshold").alias("max"),
    )
    return with_rounding(spread, dict.fromkeys(["mean", "std", "min", "max"], 4))


def threshold_stability(pairs: DataFrame, num_folds: int = 5, seed: int = 42) -> DataFrame:
    """Spread of calibrated thresholds when each identity fold is held out in turn."""
    identities = materialize(pair_identities(valid_pairs(pairs)))
    folds = materialize(identity_folds(identities, num_folds, seed))
    return stability_summary(stability_thresholds(fold_training_pairs(pairs, folds, num_folds)))
