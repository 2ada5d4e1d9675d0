"""Verification metrics over scored pairs: confusion rates, ROC, AUC, EER, thresholds, folds.

Input rows carry ``is_same`` (1 genuine, 0 impostor) and ``raw_score``. Everything starts
from ``score_counts``, one row per distinct score, so repeated scores collapse before the
first shuffle and ordered work runs on the collapsed rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollmark.functions.scalars import round_half_even, with_rounding
from rollmark.operators.ordering import (
    ROWS_PER_CELL,
    Cut,
    cut,
    exact_percentiles,
    join_groups,
    neighbour,
    running_totals,
)
from rollmark.session import materialize

SIMILARITY = "similarity"
DISTANCE = "distance"

def check_direction(direction: str) -> str:
    if direction not in (SIMILARITY, DISTANCE):
        raise ValueError(f"unknown score direction: {direction!r}")
    return direction


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """Division that yields ``empty`` instead of failing on a zero denominator."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(empty))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Drop pairs that could not be scored."""
    return pairs.where(F.col("raw_score").isNotNull() & ~F.isnan("raw_score"))


def pair_weight(pairs: DataFrame) -> Column:
    """How many pairs a row stands for: the ``weight`` column of ``compact_pairs``, else one."""
    return (F.col("weight") if "weight" in pairs.columns else F.lit(1)).cast("bigint")


def compact_pairs(pairs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Collapse pairs to (group, score, class, weight) and write that once.

    Reports that read the pairs several times call this first, so the raw pairs are
    scanned once however many metrics follow.
    """
    weight = pair_weight(pairs)
    return materialize(
        valid_pairs(pairs).groupBy(*group_cols, "raw_score", "is_same").agg(F.sum(weight).alias("weight"))
    )


def class_counts(pairs: DataFrame) -> list[Column]:
    weight = pair_weight(pairs)
    genuine = F.col("is_same") == 1
    return [
        F.sum(F.when(genuine, weight).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(genuine, 0).otherwise(weight)).cast("bigint").alias("neg"),
    ]


def score_counts(pairs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Genuine and impostor counts per distinct score."""
    return valid_pairs(pairs).groupBy(*group_cols, "raw_score").agg(*class_counts(pairs))


def attach_totals(df: DataFrame, group_cols: Sequence[str], totals: DataFrame) -> DataFrame:
    """Put one row of per-group totals beside every row of the group."""
    if group_cols:
        return join_groups(df, totals, group_cols)
    packed = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("_totals", packed).select("*", "_totals.*").drop("_totals")


def confusion_at(
    pairs: DataFrame, threshold: float, direction: str = SIMILARITY, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts with accuracy, FAR and FRR at one threshold."""
    check_direction(direction)
    score = F.col("raw_score")
    accepted = score >= F.lit(threshold) if direction == SIMILARITY else score <= F.lit(threshold)
    genuine = F.col("is_same") == 1
    weight = pair_weight(pairs)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight).otherwise(0)), F.lit(0)).cast("bigint")

    counts = valid_pairs(pairs).groupBy(*group_cols).agg(
        total(accepted & genuine).alias("tp"),
        total(~accepted & ~genuine).alias("tn"),
        total(accepted & ~genuine).alias("fp"),
        total(~accepted & genuine).alias("fn"),
    )
    return counts.select("*", *confusion_rates())


def confusion_rates() -> list[Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(fp, fp + tn).alias("far"),
        ratio(fn, fn + tp).alias("frr"),
    ]


def roc_points(
    pairs: DataFrame,
    direction: str = SIMILARITY,
    group_cols: Sequence[str] = (),
    drop_intermediate: bool = True,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """ROC curve points (threshold, tp, fp, tpr, fpr), including the (0, 0) origin.

    With ``drop_intermediate`` a point stays only if it is the first or last of its curve
    or the step in genuine or impostor counts changes after it. Rates are NULL where a
    class is absent.
    """
    counts = _settled_counts(pairs, group_cols)
    return _points(_summed(counts, direction, group_cols, rows_per_cell), direction, drop_intermediate)


def roc_auc(
    pairs: DataFrame, group_cols: Sequence[str] = (), direction: str = SIMILARITY, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, one row per group."""
    return _area(_summed(_settled_counts(pairs, group_cols), direction, group_cols, rows_per_cell))


def roc_summary(
    pairs: DataFrame, direction: str = SIMILARITY, group_cols: Sequence[str] = (), rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """AUC, EER and EER threshold per group, from one set of running totals."""
    summed = _summed(_settled_counts(pairs, group_cols), direction, group_cols, rows_per_cell)
    error = equal_error_rate(_points(summed, direction, True), direction, group_cols)
    return attach_totals(_area(summed), group_cols, error)


def _settled_counts(pairs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Score counts that may be read several times: raw pairs are collapsed and written first."""
    counts = score_counts(pairs, group_cols)
    return counts if "weight" in pairs.columns else materialize(counts)


def _summed(counts: DataFrame, direction: str, group_cols: Sequence[str], rows_per_cell: int) -> Cut:
    """Score counts with running totals ``tp`` and ``fp`` from the most to the least certain score."""
    similar = check_direction(direction) == SIMILARITY
    rows = cut(counts, group_cols, "raw_score", rows_per_cell)
    return running_totals(rows, {"tp": F.col("pos"), "fp": F.col("neg")}, descending=similar)


def _points(summed: Cut, direction: str, drop_intermediate: bool) -> DataFrame:
    descending, group_cols = direction == SIMILARITY, list(summed.group_cols)
    curve = summed.df
    if drop_intermediate:
        curve = neighbour(summed, {"next_pos": "pos", "next_neg": "neg"}, descending=descending).df.where(
            ((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
            | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos"))
            | (F.col("next_neg") != F.col("neg"))
        )
    totals = summed.df.groupBy(*group_cols).agg(F.sum("pos").alias("genuine"), F.sum("neg").alias("impostor"))
    points = attach_totals(
        curve.select(*group_cols, F.col("raw_score").alias("threshold"), "tp", "fp"), group_cols, totals
    )
    origin = totals.select(
        *group_cols,
        F.lit(float("inf") if descending else float("-inf")).alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
        "genuine",
        "impostor",
    )
    return points.unionByName(origin).select(
        *group_cols,
        "threshold",
        "tp",
        "fp",
        F.when(F.col("genuine") > 0, F.col("tp") / F.col("genuine")).alias("tpr"),
        F.when(F.col("impostor") > 0, F.col("fp") / F.col("impostor")).alias("fpr"),
    )


def _area(summed: Cut) -> DataFrame:
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    classes = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return summed.df.groupBy(*summed.group_cols).agg(F.when(classes > 0, area / classes).alias("roc_auc"))


def equal_error_rate(points: DataFrame, direction: str = SIMILARITY, group_cols: Sequence[str] = ()) -> DataFrame:
    """EER and its threshold: the first ROC point with the smallest |FPR - FNR|."""
    along = F.col("threshold") if check_direction(direction) == DISTANCE else -F.col("threshold")
    fnr = F.lit(1.0) - F.col("tpr")
    best = F.min_by(
        F.struct(((F.col("fpr") + fnr) / 2.0).alias("eer"), F.col("threshold").alias("eer_threshold")),
        F.struct(F.abs(F.col("fpr") - fnr), along),
    )
    usable = points.where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    return usable.groupBy(*group_cols).agg(best.alias("_b")).select(*group_cols, "_b.*")


def optimal_threshold(
    pairs: DataFrame, direction: str = SIMILARITY, candidates: int = 1000, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Threshold of best accuracy on an even grid over the score range, one row per group.

    The median of the candidates tied (within 1e-7 + 1e-5 of the accuracy) with the best
    one and not before it. No pairs at all gives 0.0.
    """
    counts = _settled_counts(pairs, group_cols)
    bounds = counts.groupBy(*group_cols).agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    found = _best_on_grid(attach_totals(counts, group_cols, bounds), direction, candidates, group_cols)
    if group_cols:
        return found
    return found.agg(F.coalesce(F.max("optimal_threshold"), F.lit(0.0)).alias("optimal_threshold"))


def _grid_value(index: Column, candidates: int) -> Column:
    step = (F.col("hi") - F.col("lo")) / F.lit(float(candidates - 1))
    return F.when(index >= candidates - 1, F.col("hi")).otherwise(index * step + F.col("lo"))


def _best_on_grid(counts: DataFrame, direction: str, candidates: int, group_cols: Sequence[str]) -> DataFrame:
    """Rows (group, raw_score, pos, neg, lo, hi) to the best grid threshold of each group."""
    return _best_of_bins(_binned(counts, direction, candidates, group_cols), direction, candidates, group_cols)


def _binned(counts: DataFrame, direction: str, candidates: int, group_cols: Sequence[str]) -> DataFrame:
    """Counts per grid value (``slot``): a score belongs to the last value, in the direction, that accepts it."""
    last = candidates - 1
    rising = check_direction(direction) == SIMILARITY
    width = F.col("hi") - F.col("lo")
    guess = F.when(
        width > 0, F.floor((F.col("raw_score") - F.col("lo")) / (width / F.lit(float(last)))).cast("bigint")
    ).otherwise(F.lit(last if rising else 0))
    guess = F.greatest(F.lit(0), F.least(F.lit(last), guess))
    counts = counts.withColumn("_g", guess.cast("bigint"))
    near = [F.greatest(F.lit(0), F.least(F.lit(last), F.col("_g") + d)).cast("bigint") for d in (1, 0, -1)]
    if rising:
        slot = F.coalesce(*[F.when(_grid_value(n, candidates) <= F.col("raw_score"), n) for n in near], F.lit(0))
    else:
        slot = F.coalesce(
            *[F.when(_grid_value(n, candidates) >= F.col("raw_score"), n) for n in reversed(near)], F.lit(last)
        )
    slots = counts.groupBy(*group_cols, "lo", "hi", slot.cast("bigint").alias("slot"))
    return slots.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _best_of_bins(binned: DataFrame, direction: str, candidates: int, group_cols: Sequence[str]) -> DataFrame:
    """The best grid threshold of each group, from counts per grid value."""
    last = candidates - 1
    rising = check_direction(direction) == SIMILARITY
    keys = [*group_cols, "lo", "hi"]
    grid = (
        binned.groupBy(*keys)
        .agg(F.sum("pos").alias("genuine"), F.sum("neg").alias("impostor"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("slot"))
    )
    slot_order = F.col("slot").desc() if rising else F.col("slot").asc()
    along = Window.partitionBy(*keys).orderBy(slot_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = (
        join_groups(grid, binned, [*keys, "slot"], "left")
        .withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(along))
        .withColumn("fp", F.sum(F.coalesce("neg", F.lit(0))).over(along))
        .withColumn(
            "acc",
            (F.col("tp") + F.col("impostor") - F.col("fp")) / (F.col("genuine") + F.col("impostor")),
        )
    )
    whole = Window.partitionBy(*keys)
    tied = (
        curve.withColumn("best", F.max("acc").over(whole))
        .withColumn("first", F.min(F.when(F.col("acc") == F.col("best"), F.col("slot"))).over(whole))
        .where(
            (F.col("slot") >= F.col("first"))
            & (F.col("best") - F.col("acc") <= F.lit(1e-7) + F.lit(1e-5) * F.col("best"))
        )
    )
    return tied.groupBy(*group_cols).agg(
        F.percentile(_grid_value(F.col("slot"), candidates), 0.5).alias("optimal_threshold")
    )


def score_stats(
    pairs: DataFrame, group_cols: Sequence[str] = ("is_same",), rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Count, mean, median, population std, min and max of the scores per group."""
    pairs = valid_pairs(pairs)
    basic = pairs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("raw_score").alias("mean"),
        F.stddev_pop("raw_score").alias("std"),
        F.min("raw_score").alias("min"),
        F.max("raw_score").alias("max"),
    )
    median = exact_percentiles(pairs, group_cols, "raw_score", {"median": 0.5}, rows_per_cell)
    return join_groups(basic, median, group_cols) if group_cols else basic.join(median)


#: Percentiles of the distribution summary.
SUMMARY_PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def distribution_summary(
    df: DataFrame, value_col: str, group_cols: Sequence[str], rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Thirteen-field summary of one numeric column per group, rounded to 4 places."""
    df = df.where(F.col(value_col).isNotNull())
    basic = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value_col).alias("mean"),
        F.stddev_pop(value_col).alias("std"),
        F.min(value_col).alias("min"),
        F.max(value_col).alias("max"),
    )
    shares = exact_percentiles(df, group_cols, value_col, {"median": 0.5, **SUMMARY_PERCENTILES}, rows_per_cell)
    rounded = ["mean", "median", "std", "min", "max", *SUMMARY_PERCENTILES]
    joined = join_groups(basic, shares, group_cols) if group_cols else basic.join(shares)
    return joined.select(
        *group_cols, "n", *[round_half_even(c, 4).alias(c) for c in rounded]
    )


def density_histogram(
    df: DataFrame, value_col: str, bins: int, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Equal-width bins over each group's range (last bin closed) with counts and densities."""
    df = df.where(F.col(value_col).isNotNull())
    stats = df.groupBy(*group_cols).agg(
        F.min(value_col).alias("lo"), F.max(value_col).alias("hi"), F.count(F.lit(1)).alias("total")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    index = F.when(width > 0, F.floor((F.col(value_col) - F.col("lo")) / width)).otherwise(F.lit(0))
    placed = attach_totals(df.select(*group_cols, value_col), group_cols, stats)
    counted = placed.groupBy(
        *group_cols, F.least(index, F.lit(bins - 1)).cast("bigint").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    frame = stats.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return join_groups(frame, counted, [*group_cols, "bin"], "left").select(
        *group_cols,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        n.alias("n"),
        ratio(n, F.col("total") * width).alias("density"),
    )


def fold_metrics(
    pairs: DataFrame,
    direction: str = SIMILARITY,
    candidates: int = 2000,
    rows_per_cell: int = ROWS_PER_CELL,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Per fold (of each group, say an experiment): threshold trained on the other folds, then rates, AUC, EER and stats on the fold.

    Training is by subtraction: all scores are binned once for each distinct range of the grids, and a
    fold's training bins are all bins of its range without its own. The range of a fold is that of the
    others, so it ends at the least and largest score of all or at the next fold's: four ranges at most.
    """
    check_direction(direction)
    keys = [*group_cols, "fold"]
    counts = score_counts(compact_pairs(pairs, keys), keys)
    spans = counts.groupBy(*keys).agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    in_turn = Window.partitionBy(*group_cols).orderBy("fold")  # a row for each fold
    before, behind = in_turn.rowsBetween(Window.unboundedPreceding, -1), in_turn.rowsBetween(1, Window.unboundedFollowing)
    folds = spans.select(
        *keys,
        F.least(F.min("lo").over(before), F.min("lo").over(behind)).alias("lo"),
        F.greatest(F.max("hi").over(before), F.max("hi").over(behind)).alias("hi"),
    )
    folds = materialize(folds.where("lo IS NOT NULL"))
    ranges = folds.select(*group_cols, "lo", "hi").distinct()
    ranged = join_groups(counts, ranges, group_cols) if group_cols else counts.crossJoin(F.broadcast(ranges))
    bins = materialize(_binned(ranged, direction, candidates, keys))
    everyone = bins.groupBy(*group_cols, "lo", "hi", "slot").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    training = join_groups(
        join_groups(folds, everyone, [*group_cols, "lo", "hi"]), bins, [*keys, "lo", "hi", "slot"], "left"
    ).select(
        *keys,
        "lo",
        "hi",
        "slot",
        (F.col("all_pos") - F.coalesce("pos", F.lit(0))).alias("pos"),
        (F.col("all_neg") - F.coalesce("neg", F.lit(0))).alias("neg"),
    )
    chosen = _best_of_bins(training, direction, candidates, keys).withColumnRenamed("optimal_threshold", "threshold")
    score, cut = F.col("raw_score"), F.col("threshold")
    accepted = score >= cut if direction == SIMILARITY else score <= cut

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("bigint").alias

    tested = (
        join_groups(counts, chosen, keys)
        .groupBy(*keys, "threshold")
        .agg(
            total("pos", accepted)("tp"),
            total("neg", ~accepted)("tn"),
            total("neg", accepted)("fp"),
            total("pos", ~accepted)("fn"),
        )
        .select("*", *confusion_rates())
    )
    summed = _summed(counts, direction, keys, rows_per_cell)
    errors = equal_error_rate(_points(summed, direction, True), direction, keys)
    size = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    everything = Window.partitionBy(*group_cols)
    return (
        join_groups(join_groups(tested, _area(summed), keys, "left"), errors, keys, "left")
        .select(
            *keys,
            size.alias("test_pairs"),
            (F.sum(size).over(everything) - size).alias("train_pairs"),
            round_half_even("threshold", 4).alias("calibrated_threshold"),
            round_half_even("accuracy", 4).alias("calibrated_accuracy"),
            round_half_even("far", 4).alias("calibrated_far"),
            round_half_even("frr", 4).alias("calibrated_frr"),
            round_half_even("roc_auc", 4).alias("roc_auc"),
            round_half_even("eer", 4).alias("eer"),
            round_half_even("eer_threshold", 4).alias("eer_threshold"),
        )
    )


def fold_score_stats(pairs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Count, mean, median, std, min and max of the scores of each fold and class, rounded to 4 places.

    A class that a fold lacks has count 0 and zeros.
    """
    found = score_stats(pairs, ["fold", "is_same"], rows_per_cell)
    folds = found.select("fold").distinct()
    wanted = folds.select("fold", F.explode(F.array(F.lit(0), F.lit(1))).alias("is_same"))
    joined = join_groups(wanted, found, ["fold", "is_same"], "left")
    filled = joined.fillna(0, ["n"]).fillna(0.0, ["mean", "median", "std", "min", "max"])
    return with_rounding(filled, dict.fromkeys(("mean", "median", "std", "min", "max"), 4))


def experiment_summary(scored: DataFrame, direction: str = SIMILARITY) -> DataFrame:
    """One row per experiment: mean and std over its folds of rates, threshold, AUC and EER.

    The experiment is a key of the fold training, so any number of them is one job.
    """
    return fold_summary(fold_metrics(scored, direction, group_cols=["experiment_id"]), ["experiment_id"])


def side_by_side(summaries: DataFrame) -> DataFrame:
    """Summaries of experiments as a table: a row for each metric, a column for each experiment."""
    metrics = [c for c in summaries.columns if c != "experiment_id"]
    long = summaries.select("experiment_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x"))
    return long.groupBy(F.col("x.metric").alias("metric")).pivot("experiment_id").agg(F.first("x.value"))


def fold_summary(folds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean and population std over the rounded per-fold values, in one row (of each group)."""
    picks = []
    for name in (
        "calibrated_accuracy",
        "calibrated_far",
        "calibrated_frr",
        "calibrated_threshold",
        "roc_auc",
        "eer",
    ):
        picks += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    means = folds.groupBy(*group_cols).agg(*picks)
    return with_rounding(means, dict.fromkeys((c for c in means.columns if c not in group_cols), 4))


def verification_summary(
    scored: DataFrame, reference_threshold: float, direction: str = SIMILARITY, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """One row per experiment: pair counts, global AUC and EER, rates at a reference threshold."""
    key = ["experiment_id"]
    failed = F.col("raw_score").isNull() | F.isnan("raw_score")
    sizes = scored.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(~failed).alias("successful_pairs"),
        F.count_if(failed).alias("failed_pairs"),
    )
    compact = compact_pairs(scored, key)
    rates = confusion_at(compact, reference_threshold, direction, key)
    curves = join_groups(sizes, roc_summary(compact, direction, key, rows_per_cell), key, "left")
    return (
        join_groups(curves, rates.select(*key, "accuracy", "far", "frr"), key, "left")
        .select(
            *key,
            "total_pairs",
            "successful_pairs",
            "failed_pairs",
            round_half_even("roc_auc", 4).alias("global_roc_auc"),
            round_half_even("eer", 4).alias("global_eer"),
            round_half_even("eer_threshold", 4).alias("global_eer_threshold"),
            F.lit(float(reference_threshold)).alias("reference_threshold"),
            round_half_even("accuracy", 4).alias("accuracy"),
            round_half_even("far", 4).alias("far"),
            round_half_even("frr", 4).alias("frr"),
        )
    )


def class_spread(scored: DataFrame, group_cols: Sequence[str] = (), rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Score statistics of genuine and impostor pairs side by side, rounded to 4 places."""
    stats = score_stats(scored, [*group_cols, "is_same"], rows_per_cell)
    names, fields = {"genuine": 1, "impostor": 0}, ("n", "mean", "median", "std", "min", "max")
    picks = [F.max(F.when(F.col("is_same") == label, F.col(f))).alias(f"{name}_{f}") for name, label in names.items() for f in fields]
    return with_rounding(stats.groupBy(*group_cols).agg(*picks), {f"{name}_{f}": 4 for name in names for f in fields[1:]})


def verification_report(
    scored: DataFrame, reference_threshold: float, direction: str = SIMILARITY, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """``verification_summary`` with direction, fold means and stds, and the scores of both classes, per experiment."""
    key = ["experiment_id"]
    summary = verification_summary(scored, reference_threshold, direction, rows_per_cell)
    folds = fold_summary(fold_metrics(scored, direction, rows_per_cell=rows_per_cell, group_cols=key), key)
    joined = join_groups(join_groups(summary, folds, key, "left"), class_spread(scored, key, rows_per_cell), key, "left")
    return joined.withColumn("score_direction", F.lit(direction))


def nested_report(summary: DataFrame, folds: DataFrame, strategies: DataFrame) -> DataFrame:
    """One row with ``summary`` as a struct, and folds and strategies (few rows each) as lists of structs."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))

    head = summary.select(F.struct(*summary.columns).alias("summary"))
    return head.crossJoin(listed(folds, "folds")).crossJoin(listed(strategies, "strategies"))


def compare_experiments(scored: DataFrame, threshold: float, direction: str = SIMILARITY) -> DataFrame:
    """Accuracy, FAR and FRR of each experiment per fold and overall (fold NULL), one row each."""
    accepted = F.col("raw_score") >= threshold if direction == SIMILARITY else F.col("raw_score") <= threshold
    genuine = F.col("is_same") == 1
    grouped = (
        valid_pairs(scored)
        .groupBy("experiment_id", "fold")
        .agg(
            F.count_if(accepted & genuine).alias("tp"),
            F.count_if(~accepted & ~genuine).alias("tn"),
            F.count_if(accepted & ~genuine).alias("fp"),
            F.count_if(~accepted & genuine).alias("fn"),
        )
    )
    overall = grouped.groupBy("experiment_id").agg(
        F.lit(None).cast("bigint").alias("fold"), *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]
    )
    return grouped.unionByName(overall).select("experiment_id", "fold", "tp", "tn", "fp", "fn", *confusion_rates())
