"""The record table, and settings with their ranges."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import types as T

# Type flags of a record, and weights of the scoring criteria.
TYPE_FLAGS = ("screenshot", "screen_recording", "selfie", "burst", "live_photo", "slow_mo", "time_lapse", "panorama", "raw")
WEIGHTS = {"sharpness": 0.35, "faces": 0.35, "exposure": 0.15, "horizon": 0.10, "framing": 0.05, "facing": 0.0, "capture_quality": 0.0, "smiling": 0.0}

RECORDS = T.StructType(
    [T.StructField("uuid", T.StringType(), False), T.StructField("date", T.TimestampType()), T.StructField("date_local", T.TimestampNTZType())]
    + [T.StructField(f"is_{x}", T.BooleanType()) for x in ("video", *TYPE_FLAGS, "favorite", "hidden", "shared")]
    + [
        T.StructField("filesize", T.LongType()), T.StructField("duration_seconds", T.DoubleType()), T.StructField("album_count", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("device", T.StringType()), T.StructField("burst_key", T.StringType()),
        T.StructField("mod_date", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("derivative_path", T.StringType()), T.StructField("display_path", T.StringType()), T.StructField("fingerprint", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ClusterSettings:
    gap_seconds: float = 90.0
    similarity_threshold: float = 0.40
    ambiguity_margin: float = 0.05
    gps_reinforce_metres: float = 50.0
    sharpness_size_tolerance: float = 1.0
    include_shared: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


@dataclass(frozen=True)
class SweepSettings:
    screenshot_age_months: float = 12
    short_video_seconds: float = 5.0
    screenshots: bool = True
    short_videos: bool = True
    exact_duplicates: bool = True


@dataclass(frozen=True)
class AlbumSettings:
    trip_gap_hours: float = 48.0
    min_size: int = 3
    spread_km: float = 150.0


#: What a setting may lie between.
RANGES = {"gap_seconds": (0, 86400), "similarity_threshold": (0, 4), "ambiguity_margin": (0, 1), "gps_reinforce_metres": (0, 100_000), "sharpness_size_tolerance": (1, 4)}


def load_settings(path: str | Path | None = None, **overrides: object) -> ClusterSettings:
    """Defaults, then a TOML file, then overrides that are not None; anything unknown, of a wrong type or out of range raises."""
    given = tomllib.loads(Path(path).read_text()) if path else {}
    given |= {k: v for k, v in overrides.items() if v is not None}
    known = {f.name for f in fields(ClusterSettings)}
    if unknown := given.keys() - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name, (low, high) in RANGES.items():
        if name in given and (isinstance(given[name], bool) or not isinstance(given[name], (int, float))):
            raise ValueError(f"{name} must be a number")
        if name in given and not low <= given[name] <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")
    if not isinstance(given.get("include_shared", False), bool):
        raise ValueError("include_shared must be true or false")
    if "weights" in given:
        weights = WEIGHTS | dict(given["weights"])
        if strange := weights.keys() - WEIGHTS.keys():
            raise ValueError(f"unknown weights: {', '.join(sorted(strange))}")
        if any(isinstance(w, bool) or not isinstance(w, (int, float)) or w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
            raise ValueError("weights must be numbers of at least 0 that sum to 1")
        given["weights"] = weights
    return replace(ClusterSettings(), **given)


def settings_document(settings: ClusterSettings, source: str | None = None) -> dict[str, object]:
    return asdict(settings) | {"source": source}


def settings_digest(document: dict[str, object]) -> str:
    """Names a set of settings; where they came from does not count."""
    return hashlib.sha256(json.dumps({k: v for k, v in document.items() if k != "source"}, sort_keys=True).encode()).hexdigest()


def settings_changes(old: dict[str, object], new: dict[str, object], prefix: str = "") -> list[tuple[str, object, object]]:
    """(dotted name, before, after) of what differs; absent is None."""
    out: list[tuple[str, object, object]] = []
    for name in sorted(old.keys() | new.keys()):
        a, b = old.get(name), new.get(name)
        if isinstance(a, dict) or isinstance(b, dict):
            out += settings_changes(a or {}, b or {}, f"{prefix}{name}.")
        elif a != b:
            out.append((prefix + name, a, b))
    return out
