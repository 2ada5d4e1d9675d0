"""Detection geometry, quality scores and the quality gate as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

#: Weights and targets of the composite score.
ALIGNMENT_WEIGHTS = {"roll": 0.5, "vertical": 0.3, "containment": 0.2}
COMPOSITE_WEIGHTS = {
    "blur": 0.30,
    "confidence": 0.20,
    "alignment": 0.15,
    "pose": 0.15,
    "brightness": 0.10,
    "contrast": 0.10,
}
TARGET_BLUR = 250.0
MID_BRIGHTNESS = 128.0
FULL_CONTRAST = 60.0
BOX_PADDING = 0.25

METRICS = [
    "blur_score",
    "face_width",
    "face_height",
    "face_area_ratio",
    "brightness_score",
    "contrast_score",
    "detection_confidence",
    "alignment_quality",
    "pose_quality",
    "overall_quality",
]


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp_box(bbox: Column, image_w: Column, image_h: Column) -> Column:
    """Box pulled inside the image, at least one pixel wide and high."""
    top = F.greatest(F.lit(0), F.least(bbox["top"], image_h - 1))
    left = F.greatest(F.lit(0), F.least(bbox["left"], image_w - 1))
    return F.struct(
        top.alias("top"),
        F.greatest(left + 1, F.least(bbox["right"], image_w)).alias("right"),
        F.greatest(top + 1, F.least(bbox["bottom"], image_h)).alias("bottom"),
        left.alias("left"),
    )


def box_from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(x, y, width, height) to a (top, right, bottom, left) box."""
    return F.struct(y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"), x.alias("left"))


def ordered_landmarks(points: Column) -> Column:
    """Five points with the eyes, and the mouth corners, in left-to-right order."""

    def pair(a: int, b: int) -> tuple[Column, Column]:
        swap = points[a][0] > points[b][0]
        return F.when(swap, points[b]).otherwise(points[a]), F.when(swap, points[a]).otherwise(points[b])

    left_eye, right_eye = pair(0, 1)
    left_mouth, right_mouth = pair(3, 4)
    return F.array(left_eye, right_eye, points[2], left_mouth, right_mouth)


def face_width(bbox: Column) -> Column:
    return F.greatest(F.lit(1), bbox["right"] - bbox["left"])


def face_height(bbox: Column) -> Column:
    return F.greatest(F.lit(1), bbox["bottom"] - bbox["top"])


def face_area_ratio(bbox: Column, image_w: Column, image_h: Column) -> Column:
    return face_width(bbox) * face_height(bbox) / F.greatest(F.lit(1), image_w * image_h)


def _usable(points: Column) -> Column:
    return F.coalesce(F.size(points) >= 5, F.lit(False))


def _xy(points: Column, index: int) -> tuple[Column, Column]:
    return points[index][0].cast("double"), points[index][1].cast("double")


def alignment_quality(points: Column, bbox: Column) -> Column:
    """Plausibility of five landmarks: level eyes, vertical order, inside the padded box."""
    (lx, ly), (rx, ry), (_, ny), (_, ml), (_, mr) = (_xy(points, i) for i in range(5))
    tilt = F.degrees(F.atan2(F.abs(ry - ly), F.greatest(F.abs(rx - lx), F.lit(1e-5))))
    level = F.greatest(F.lit(0.0), 1.0 - tilt / 45.0)
    eyes, mouth = (ly + ry) / 2.0, (ml + mr) / 2.0
    upright = F.when((eyes < ny) & (ny < mouth), F.lit(1.0)).otherwise(F.lit(0.3))
    pad_x, pad_y = face_width(bbox) * BOX_PADDING, face_height(bbox) * BOX_PADDING
    inside = F.forall(
        F.slice(points, 1, 5),
        lambda p: p[0].between(bbox["left"] - pad_x, bbox["right"] + pad_x)
        & p[1].between(bbox["top"] - pad_y, bbox["bottom"] + pad_y),
    )
    held = F.when(inside, F.lit(1.0)).otherwise(F.lit(0.4))
    weights = ALIGNMENT_WEIGHTS
    combined = clip(weights["roll"] * level + weights["vertical"] * upright + weights["containment"] * held)
    eye_distance = F.hypot(rx - lx, ry - ly)
    return F.when(~_usable(points), F.lit(0.0)).when(eye_distance < 2.0, F.lit(0.1)).otherwise(combined)


def pose_quality(points: Column) -> Column:
    """Frontal symmetry: shorter over longer distance from the nose to the eyes."""
    (lx, ly), (rx, ry), (nx, ny) = (_xy(points, i) for i in range(3))
    left, right = F.hypot(nx - lx, ny - ly), F.hypot(nx - rx, ny - ry)
    ratio = F.least(left, right) / F.greatest(left, right)
    degenerate = (left <= 1e-5) | (right <= 1e-5)
    return F.when(~_usable(points), F.lit(0.0)).when(degenerate, F.lit(0.1)).otherwise(clip(ratio))


def composite_quality(
    blur: Column,
    brightness: Column,
    contrast: Column,
    confidence: Column,
    alignment: Column,
    pose: Column,
    min_blur: float,
) -> Column:
    """Weighted overall quality in [0, 1]; sharpness rises linearly from ``min_blur``."""
    parts = {
        "blur": clip((blur - min_blur) / max(1.0, TARGET_BLUR - min_blur)),
        "confidence": clip(confidence),
        "alignment": clip(alignment),
        "pose": clip(pose),
        "brightness": F.greatest(F.lit(0.0), 1.0 - F.abs(brightness - MID_BRIGHTNESS) / MID_BRIGHTNESS),
        "contrast": clip(contrast / FULL_CONTRAST),
    }
    total = F.lit(0.0)
    for name, weight in COMPOSITE_WEIGHTS.items():
        total = total + weight * parts[name]
    return clip(total)


def _checks(settings: Mapping[str, float]) -> list[tuple[Column, str]]:
    """Failure conditions on the metric columns with their names, in fixed order."""
    c = F.col
    too_dark = c("brightness_score") < settings["min_brightness"]
    return [
        (
            (c("face_width") < settings["min_face_width"]) | (c("face_height") < settings["min_face_height"]),
            "low_resolution",
        ),
        (c("face_area_ratio") < settings["min_face_area_ratio"], "face_too_small"),
        (c("blur_score") < settings["min_blur_score"], "blurry"),
        (too_dark, "underexposed"),
        (~too_dark & (c("brightness_score") > settings["max_brightness"]), "overexposed"),
        (c("contrast_score") < settings["min_contrast"], "low_contrast"),
        (c("detection_confidence") < settings["min_detection_confidence"], "low_detection_confidence"),
        (c("alignment_quality") < settings["min_alignment_quality"], "poor_alignment"),
        (c("pose_quality") < settings["min_pose_quality"], "extreme_pose"),
    ]


def rejection_reasons(settings: Mapping[str, float]) -> Column:
    """Names of the failed checks, in fixed order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in _checks(settings)]))


def passes(settings: Mapping[str, float]) -> Column:
    """Whether the metric columns satisfy every limit of a mode."""
    failed = F.lit(False)
    for check, _ in _checks(settings):
        failed = failed | F.coalesce(check, F.lit(False))
    return ~failed


def rejection_text(reasons: Column) -> Column:
    return F.concat(F.lit("quality_rejected: "), F.array_join(reasons, ", "))
