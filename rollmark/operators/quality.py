"""Quality scoring and gating of detections, and quality against match scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rollmark.functions import quality as q
from rollmark.functions.scalars import round_half_even, with_rounding
from rollmark.operators.gallery import COSINE_THRESHOLD, search
from rollmark.operators.metrics import distribution_summary, ratio
from rollmark.policies import QUALITY, preset

PAIR_MINIMA = {
    "min_blur": "blur_score",
    "min_brightness": "brightness_score",
    "min_contrast": "contrast_score",
    "min_confidence": "detection_confidence",
    "min_alignment": "alignment_quality",
    "min_pose": "pose_quality",
    "min_overall_quality": "overall_quality",
}


def quality_scores(detections: DataFrame, settings: Mapping[str, float] | None = None) -> DataFrame:
    """Add geometry, alignment, pose and overall quality to detections."""
    settings = settings or preset(QUALITY)
    c = F.col
    scored = detections.withColumns(
        {
            "face_width": q.face_width(c("bbox")),
            "face_height": q.face_height(c("bbox")),
            "face_area": q.face_width(c("bbox")) * q.face_height(c("bbox")),
            "face_area_ratio": q.face_area_ratio(c("bbox"), c("image_w"), c("image_h")),
            "detection_confidence": c("confidence"),
            "alignment_quality": q.alignment_quality(c("landmarks"), c("bbox")),
            "pose_quality": q.pose_quality(c("landmarks")),
        }
    )
    overall = q.composite_quality(
        c("blur_score"),
        c("brightness_score"),
        c("contrast_score"),
        c("detection_confidence"),
        c("alignment_quality"),
        c("pose_quality"),
        settings["min_blur_score"],
    )
    return scored.withColumn("overall_quality", overall)


def quality_gate(
    detections: DataFrame, mode: str = "balanced", enabled: bool = True, **overrides: float
) -> DataFrame:
    """Score detections and add ``rejection_reasons`` and ``quality_status`` (good or poor)."""
    settings = preset(QUALITY, mode, **overrides)
    gated = quality_scores(detections, settings).withColumn("rejection_reasons", q.rejection_reasons(settings))
    poor = ~q.passes(settings) & F.lit(enabled)
    return gated.withColumn("quality_status", F.when(poor, F.lit("poor")).otherwise(F.lit("good")))


def primary_detections(detections: DataFrame, by: str = "confidence") -> DataFrame:
    """One detection per image, of highest confidence or largest area, and the image's count.

    A partial aggregation, so an image with very many detections is trimmed in each task.
    """
    if by == "confidence":
        rank = F.struct(-F.col("confidence"), F.col("det_idx"))
    elif by == "area":
        rank = F.struct(-(q.face_width(F.col("bbox")) * q.face_height(F.col("bbox"))), F.col("det_idx"))
    elif by == "first":
        rank = F.struct(F.col("det_idx"))
    else:
        raise ValueError(f"unknown rule: {by!r}")
    others = [c for c in detections.columns if c != "image_id"]
    return (
        detections.groupBy("image_id")
        .agg(F.min_by(F.struct(*others), rank).alias("_d"), F.count(F.lit(1)).alias("n_detections"))
        .select("image_id", "_d.*", "n_detections")
    )


def recognise(
    images: DataFrame,
    detections: DataFrame,
    templates: DataFrame,
    threshold: float = COSINE_THRESHOLD,
    mode: str = "balanced",
    multi_face_policy: str = "highest",
    gate_enabled: bool = True,
) -> DataFrame:
    """Recognition outcome of every image (image_id, valid) with the reason for it.

    Images that fail a check never reach the vector search. Every detection is judged where it is read, so
    only what the outcome needs is sorted and shuffled, and no vector of a detection that fails.
    """
    gated = quality_gate(detections, mode, gate_enabled)
    poor, marked = F.col("quality_status") == "poor", F.col("landmarks").isNotNull()
    judged = gated.select(
        "image_id",
        "det_idx",
        "confidence",
        "overall_quality",
        F.when(poor, q.rejection_text(F.col("rejection_reasons"))).when(~marked, F.lit("missing_landmarks")).alias("failed"),
        F.when(~poor & marked, F.col("embedding")).alias("embedding"),
    )
    joined = images.join(primary_detections(judged).drop("det_idx", "confidence"), "image_id", "left")
    many = (F.col("n_detections") > 1) & F.lit(multi_face_policy == "reject")
    blocked = (
        F.when(~F.coalesce("valid", F.lit(False)), F.lit("invalid_image"))
        .when(F.col("n_detections").isNull(), F.lit("no_face_detected"))
        .when(many, F.lit("multiple_faces_rejected"))
        .otherwise(F.col("failed"))
    )
    staged = joined.withColumn("reason", blocked)
    quality = F.when(
        F.col("reason").isNull() | F.startswith("reason", F.lit("quality")) | (F.col("reason") == "missing_landmarks"),
        F.col("overall_quality"),
    )
    queries = staged.select(
        F.col("image_id").alias("query_id"),
        "reason",
        quality.alias("overall_quality"),
        F.when(F.col("reason").isNull(), F.col("embedding")).alias("embedding"),
    )
    verdict = F.coalesce(
        "reason", F.when(F.col("recognized"), F.lit("accepted")).otherwise(F.lit("below_threshold"))
    )
    return search(queries, templates, threshold).select(
        F.col("query_id").alias("image_id"),
        "identity",
        "best_candidate",
        F.col("score").alias("similarity"),
        F.lit(float(threshold)).alias("threshold"),
        "recognized",
        "overall_quality",
        verdict.alias("reason"),
    )


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """Images per outcome; all quality rejections count as one."""
    kind = F.regexp_replace("reason", ":.*", "")
    return outcomes.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("images"))


def detection_audit(images: DataFrame, detections: DataFrame) -> DataFrame:
    """How many images have none, one or several detections, and success rates."""
    counts = detections.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("landmarks").isNotNull()).alias("aligned")
    )
    n = F.coalesce("n", F.lit(0))
    total = F.count(F.lit(1))
    audit = images.join(counts, "image_id", "left").agg(
        total.alias("images_checked"),
        F.count_if(n == 0).alias("zero_detected"),
        F.count_if(n == 1).alias("single_detected"),
        F.count_if(n > 1).alias("multiple_detected"),
        ratio(F.count_if(n > 0), total).alias("detection_rate"),
        ratio(F.count_if(F.coalesce("aligned", F.lit(False))), total).alias("alignment_rate"),
    )
    return with_rounding(audit, {"detection_rate": 4, "alignment_rate": 4})


def metric_distributions(scored: DataFrame) -> DataFrame:
    """Distribution summary of each quality metric."""
    doubles = scored.select(*[F.col(m).cast("double").alias(m) for m in q.METRICS])
    return distribution_summary(doubles.unpivot([], q.METRICS, "metric", "value"), "value", ["metric"])


def pair_quality(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Pairs with the lesser of both sides' quality metrics; unscored sides drop the pair."""
    columns = list(dict.fromkeys(PAIR_MINIMA.values()))
    left = scored.select(F.col("key").alias("key1"), F.struct(*columns).alias("_q1"))
    right = scored.select(F.col("key").alias("key2"), F.struct(*columns).alias("_q2"))
    joined = pairs.join(left, "key1").join(right, "key2")
    return joined.select(
        *pairs.columns,
        *[F.least(F.col(f"_q1.{src}"), F.col(f"_q2.{src}")).alias(name) for name, src in PAIR_MINIMA.items()],
    )


def quality_correlations(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of each pair minimum with the score of genuine pairs, long form."""
    genuine = pairs.where(F.col("is_same") == 1)
    names = [n for n in PAIR_MINIMA if n != "min_pose"]
    enough = F.count(F.lit(1)) >= 2
    facts = genuine.agg(*[F.when(enough, F.corr(n, "raw_score")).otherwise(0.0).alias(n) for n in names])
    return facts.unpivot([], names, "metric", "correlation").withColumn(
        "correlation", round_half_even("correlation", 4)
    )


def quality_trend(pairs: DataFrame, metric: str) -> DataFrame:
    """Straight-line fit of score on one pair minimum over genuine pairs, NULL up to 10 pairs."""
    enough = F.count(F.lit(1)) > 10
    return pairs.where(F.col("is_same") == 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.regr_slope("raw_score", metric)).alias("slope"),
        F.when(enough, F.regr_intercept("raw_score", metric)).alias("intercept"),
    )


def mode_comparison(pairs: DataFrame, scored: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """Rejection rate and verification rates of the pairs each gate lets through.

    Gates are decided once per image, so the pair joins carry one flag per mode instead of
    the metrics.
    """
    modes = list(QUALITY)
    flags = F.array(*[q.passes(QUALITY[m]) for m in modes])
    judged = scored.select("key", flags.alias("_f"))
    joined = (
        pairs.select("key1", "key2", "is_same", "raw_score")
        .join(judged.select(F.col("key").alias("key1"), F.col("_f").alias("_f1")), "key1")
        .join(judged.select(F.col("key").alias("key2"), F.col("_f").alias("_f2")), "key2")
    )
    entries = [F.struct(F.lit("baseline").alias("mode"), F.lit(True).alias("kept"))]
    for at, mode in enumerate(modes):
        entries.append(F.struct(F.lit(mode).alias("mode"), (F.col("_f1")[at] & F.col("_f2")[at]).alias("kept")))
    accepted, genuine, kept = F.col("raw_score") >= threshold, F.col("is_same") == 1, F.col("kept")
    counts = (
        joined.select("is_same", "raw_score", F.explode(F.array(*entries)).alias("_m"))
        .select("is_same", "raw_score", "_m.*")
        .groupBy("mode")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(kept).alias("n"),
            F.count_if(kept & accepted & genuine).alias("tp"),
            F.count_if(kept & accepted & ~genuine).alias("fp"),
            F.count_if(kept & ~accepted & ~genuine).alias("tn"),
            F.count_if(kept & ~accepted & genuine).alias("fn"),
        )
    )
    c = F.col
    far = ratio(c("fp"), c("fp") + c("tn"))
    rates = counts.select(
        "mode",
        c("n").alias("total_pairs_evaluated"),
        (c("total") - c("n")).alias("rejected_pairs"),
        ratio(c("total") - c("n"), c("total")).alias("rejection_rate"),
        ratio(c("tp") + c("tn"), c("n")).alias("accuracy"),
        far.alias("far"),
        ratio(c("fn"), c("fn") + c("tp")).alias("frr"),
        ratio(c("tp"), c("fn") + c("tp")).alias("genuine_acceptance_rate"),
        far.alias("impostor_acceptance_rate"),
    )
    places = dict.fromkeys(["rejection_rate", "accuracy", "genuine_acceptance_rate"], 4)
    return with_rounding(rates, places | dict.fromkeys(["far", "frr", "impostor_acceptance_rate"], 6))
