"""Tunable parameters and the published constants they default to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

# --- Fixed values: physical limits, thresholds and model settings ---------------------------
MAX_SPEED = 380.0
MAX_RPM = 15000.0
MAX_THROTTLE = 100.0
MAX_BRAKE = 100.0
PEDAL_THRESHOLD = 5.0
SPEED_DELTA_LIMIT = 50.0
GEAR_CHANGE_LIMIT = 4.0
DEFAULT_GEAR = 8
UNKNOWN_DRIVER = "UNKNOWN"
CONTAMINATIONS = (0.05, 0.08, 0.10, 0.12, 0.15, 0.20)
FOLDS = 5
TREES = 200
TREE_SAMPLE = 256
SEED = 42
CHART_POINTS = 5000
MAP_POINTS = 8000
SEASON_FALLBACK_ROUNDS = 24
SEASONS = ("2023", "2024")
TARGET_FPS = 5
FRAMES_PER_VIDEO = 11
HIT_THRESHOLD = 130
NEAR_THRESHOLD = 250
LEFT_WHEEL_X = 0.18
RIGHT_WHEEL_X = 0.85
WHEEL_Y = 0.60
MIN_CONFIDENCE = 0.25
CURB_CLASS = 0
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Settings a deployment may override from a JSON document; absent keys keep the default."""

    seasons: tuple[str, ...] = SEASONS
    target_fps: int = TARGET_FPS
    frames_per_video: int = FRAMES_PER_VIDEO
    hit_threshold: float = HIT_THRESHOLD
    near_threshold: float = NEAR_THRESHOLD
    left_wheel_x_pct: float = LEFT_WHEEL_X
    right_wheel_x_pct: float = RIGHT_WHEEL_X
    wheel_y_pct: float = WHEEL_Y
    circuits: tuple[dict, ...] = field(default=())

    @classmethod
    def from_document(cls, doc: dict) -> "Settings":
        """Flatten the sections of a config document onto the known setting names."""
        flat = dict(doc)
        for section in doc.values():
            if isinstance(section, dict):
                flat.update(section)
        known = {f.name for f in fields(cls)}
        picked = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known}
        return cls(**picked)

    @classmethod
    def from_file(cls, path: str) -> "Settings":
        with open(path, encoding="utf-8") as handle:
            return cls.from_document(json.load(handle))
