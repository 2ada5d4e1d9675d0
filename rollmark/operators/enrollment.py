"""Batch enrolment: the outcome of every request, and what an accepted one changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollmark.functions.scalars import clean_identity
from rollmark.operators.attendance import upsert_identities
from rollmark.operators.gallery import add_templates, template_counts
from rollmark.operators.ordering import positions
from rollmark.operators.quality import primary_detections, quality_gate
from rollmark.session import materialize

#: Outcome codes in the order they are checked.
OUTCOMES = [
    "invalid_identity",
    "invalid_image",
    "no_face_detected",
    "quality_rejected",
    "missing_landmarks",
    "alignment_failed",
    "embedding_failed",
]


def enrollment_outcomes(requests: DataFrame, detections: DataFrame, mode: str = "balanced") -> DataFrame:
    """Requests (request_id, identity, image_id, valid) with an ``error_code``, NULL if accepted.

    The first detection of the image counts. ``aligned`` and ``embedding`` on it say whether
    alignment and the vector succeeded.
    """
    first = quality_gate(primary_detections(detections, by="first"), mode).select(
        "image_id",
        "n_detections",
        "overall_quality",
        "quality_status",
        "rejection_reasons",
        F.col("landmarks").isNotNull().alias("_landmarks"),
        "aligned",
        "embedding",
    )
    checks = [
        F.col("identity").isNull(),
        ~F.coalesce("valid", F.lit(False)),
        F.col("n_detections").isNull(),
        F.col("quality_status") == "poor",
        ~F.col("_landmarks"),
        ~F.coalesce("aligned", F.lit(True)),
        F.col("embedding").isNull(),
    ]
    code = F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in zip(checks, OUTCOMES)])
    named = requests.withColumn("identity", clean_identity(F.col("identity")))
    joined = named.join(first, "image_id", "left").withColumn("error_code", code)
    judged = F.col("error_code").isNull() | (F.col("error_code") == "quality_rejected")
    quality = F.when(judged, F.col("overall_quality"))
    status = F.when(F.col("error_code").isNull(), "accepted").when(F.col("error_code") == "quality_rejected", "rejected")
    message = F.when(
        F.col("error_code") == "quality_rejected",
        F.concat(
            F.lit("Enrollment image rejected by Face Quality Assessment: "),
            F.array_join("rejection_reasons", ", "),
            F.lit("."),
        ),
    )
    return joined.select(
        "request_id",
        "identity",
        "image_id",
        F.col("error_code").isNull().alias("success"),
        "error_code",
        quality.alias("quality_score"),
        status.alias("quality_status"),
        message.alias("message"),
        F.when(F.col("error_code").isNull(), F.col("embedding")).alias("embedding"),
    )


def enroll(
    outcomes: DataFrame, templates: DataFrame, identities: DataFrame, dim: int, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Gallery and identity metadata after the accepted requests, in request order.

    The accepted requests are written once: judging them carries vectors through shuffles.
    """
    accepted = materialize(outcomes.where("success").select("request_id", "identity", "embedding"))
    numbered = positions(accepted, (), "request_id", "template_id", ()).select("template_id", "identity", "embedding")
    gallery = add_templates(templates, numbered, dim)
    touched = template_counts(gallery).join(accepted.select("identity").distinct(), "identity", "left_semi")
    changes = touched.select(
        "identity",
        "template_count",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(None).cast("string").alias("notes"),
    )
    return gallery, upsert_identities(identities, changes)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Requests per outcome, 'enrolled' for the accepted ones."""
    return outcomes.groupBy(F.coalesce("error_code", F.lit("enrolled")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def extraction_tally(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Scanned, extracted, faceless, multi-face and invalid images of a labelled folder."""
    best = primary_detections(detections, by="area").select(
        "image_id", "n_detections", F.col("embedding").isNotNull().alias("_vector")
    )
    valid, found = F.coalesce("valid", F.lit(False)), F.coalesce("n_detections", F.lit(0))
    return images.join(best, "image_id", "left").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(valid & F.coalesce("_vector", F.lit(False))).alias("extracted"),
        F.count_if(valid & (found == 0)).alias("no_face"),
        F.count_if(valid & (found > 1)).alias("multiple_faces"),
        F.count_if(~valid).alias("invalid"),
    )
