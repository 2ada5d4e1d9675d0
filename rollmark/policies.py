"""Operating presets and their resolution against overrides.

All numbers here are fixed values: they define the named modes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_MODE = "balanced"

#: Temporal smoothing. Durations are in seconds.
TEMPORAL = {
    "fast": {
        "window_size": 4,
        "min_observations": 3,
        "min_stable_ratio": 0.65,
        "max_unknown_observations": 2,
        "challenger_switch_threshold": 2,
        "max_gap_seconds": 2.0,
    },
    "balanced": {
        "window_size": 7,
        "min_observations": 4,
        "min_stable_ratio": 0.70,
        "max_unknown_observations": 3,
        "challenger_switch_threshold": 3,
        "max_gap_seconds": 2.0,
    },
    "stable": {
        "window_size": 10,
        "min_observations": 6,
        "min_stable_ratio": 0.80,
        "max_unknown_observations": 4,
        "challenger_switch_threshold": 5,
        "max_gap_seconds": 2.5,
    },
}

#: Presence sessions. Durations are in seconds.
PRESENCE = {
    "fast": {
        "min_entry_observations": 2,
        "entry_window_seconds": 3.0,
        "grace_period_seconds": 5.0,
        "max_session_duration_seconds": 28800.0,
    },
    "balanced": {
        "min_entry_observations": 3,
        "entry_window_seconds": 5.0,
        "grace_period_seconds": 10.0,
        "max_session_duration_seconds": 28800.0,
    },
    "strict": {
        "min_entry_observations": 5,
        "entry_window_seconds": 8.0,
        "grace_period_seconds": 20.0,
        "max_session_duration_seconds": 28800.0,
    },
}

#: Quality gates.
QUALITY = {
    "lenient": {
        "min_face_width": 25,
        "min_face_height": 25,
        "min_face_area_ratio": 0.008,
        "min_blur_score": 20.0,
        "min_brightness": 20.0,
        "max_brightness": 240.0,
        "min_contrast": 12.0,
        "min_detection_confidence": 0.45,
        "min_alignment_quality": 0.35,
        "min_pose_quality": 0.25,
    },
    "balanced": {
        "min_face_width": 40,
        "min_face_height": 40,
        "min_face_area_ratio": 0.015,
        "min_blur_score": 40.0,
        "min_brightness": 35.0,
        "max_brightness": 225.0,
        "min_contrast": 18.0,
        "min_detection_confidence": 0.60,
        "min_alignment_quality": 0.50,
        "min_pose_quality": 0.40,
    },
    "strict": {
        "min_face_width": 60,
        "min_face_height": 60,
        "min_face_area_ratio": 0.03,
        "min_blur_score": 75.0,
        "min_brightness": 50.0,
        "max_brightness": 205.0,
        "min_contrast": 25.0,
        "min_detection_confidence": 0.80,
        "min_alignment_quality": 0.65,
        "min_pose_quality": 0.55,
    },
}

Presets = Mapping[str, Mapping[str, float]]


def preset(presets: Presets, mode: str = DEFAULT_MODE, scale: float = 1.0, **overrides: float) -> dict[str, float]:
    """Settings of a mode (unknown modes mean the default) with overrides.

    ``scale`` stretches durations for data whose frames lie further apart.
    """
    settings = dict(presets.get(mode.lower(), presets[DEFAULT_MODE]))
    unknown = set(overrides) - set(settings)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    for name in settings:
        if name.endswith("_seconds"):
            settings[name] = settings[name] * scale
    settings.update({k: v for k, v in overrides.items() if v is not None})
    return settings


def setting(presets: Presets, mode: Column, name: str) -> Column:
    """The preset value for a mode column; unknown or missing modes get the default."""
    value = F.lit(presets[DEFAULT_MODE][name])
    for known, settings in presets.items():
        if known != DEFAULT_MODE:
            value = F.when(F.lower(mode) == known, F.lit(settings[name])).otherwise(value)
    return value


def resolve(configs: DataFrame, presets: Presets, mode_col: str = "mode") -> DataFrame:
    """Fill every setting of a config table: its own column where given, else the preset."""
    known = F.lower(F.col(mode_col)).isin(*presets)
    columns = {mode_col: F.when(known, F.lower(F.col(mode_col))).otherwise(F.lit(DEFAULT_MODE))}
    for name in presets[DEFAULT_MODE]:
        chosen = setting(presets, F.col(mode_col), name)
        columns[name] = F.coalesce(F.col(name), chosen) if name in configs.columns else chosen
    return configs.withColumns(columns)
