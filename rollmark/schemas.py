"""Declared schemas of the tables as DDL text; inputs are never inferred."""

from __future__ import annotations

TEMPLATES = "template_id BIGINT, identity STRING, embedding ARRAY<FLOAT>, source_path STRING"
SPLITS = (
    "image_id BIGINT, identity STRING, split STRING, image_name STRING, relative_path STRING, "
    "file_hash STRING, width INT, height INT"
)
IDENTITY_COUNTS = (
    "identity STRING, total_images INT, enrollment_count INT, validation_count INT, test_count INT"
)
VERIFICATION_PAIRS = (
    "pair_id BIGINT, fold INT, identity1 STRING, image1_rel_path STRING, image1_exists BOOLEAN, "
    "identity2 STRING, image2_rel_path STRING, image2_exists BOOLEAN, is_same INT"
)
EMBEDDING_CACHE = "key STRING, embedding ARRAY<FLOAT>"
OBSERVATIONS = (
    "stream_id STRING, frame_index BIGINT, ts TIMESTAMP, identity STRING, best_candidate STRING, "
    "similarity DOUBLE, threshold DOUBLE, recognized BOOLEAN, quality_status STRING, quality_score DOUBLE"
)
DETECTION_LOG = "name STRING, time STRING"


def column_names(schema: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in schema.split(", ")]
