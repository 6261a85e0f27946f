"""Opening a library, and mapping its rows to records."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.schema import RECORDS
from fernsieve.sources.library import derivative_choice, video_duration

#: A record's column and what it is called in the source.
NAMES = {
    "uuid": "uuid", "date": "date", "is_video": "ismovie", "filesize": "original_filesize", "is_screenshot": "screenshot", "is_screen_recording": "screen_recording", "is_selfie": "selfie",
    "is_burst": "burst", "is_live_photo": "live_photo", "is_slow_mo": "slow_mo", "is_time_lapse": "time_lapse", "is_panorama": "panorama", "is_raw": "israw", "is_favorite": "favorite",
    "is_hidden": "hidden", "is_shared": "shared", "latitude": "latitude", "longitude": "longitude", "mod_date": "date_modified", "width": "width", "height": "height", "fingerprint": "fingerprint",
}
SETTINGS_FILE = "fernsieve.toml"


def open_library(spark: SparkSession, path: str | None = None, last: str | None = None) -> dict[str, DataFrame]:
    """The tables ``photos`` and ``albums`` of the library at ``path``, or at the path that was opened last."""
    where = path or last
    if not where:
        raise FileNotFoundError("no library is given, and none was opened before")
    return {name: spark.read.parquet(f"{where.rstrip('/')}/{name}.parquet") for name in ("photos", "albums")}


def records_of(photos: DataFrame, bursts: DataFrame | None = None, with_derivatives: bool = False) -> DataFrame:
    """Records, in the columns and kinds of RECORDS, of a source's ``photos``.

    ``bursts`` is what ``expand_bursts`` gives; its uuids and burst keys are taken where it is given. A missing column
    is null, except that nothing is shared unless it says so. Rasters are picked only on demand, both in one pass.
    """
    there = dict(photos.dtypes)
    kinds = {f.name: f.dataType for f in RECORDS}
    if bursts is not None:
        photos = photos.join(bursts.select("uuid", F.col("burst_key").alias("_burst")), "uuid")
    value = {name: F.col(source) for name, source in NAMES.items() if source in there}
    value["is_shared"] = F.coalesce(value.get("is_shared", F.lit(False)), F.lit(False))
    exif = there.get("exif_info", "")
    if "duration" in exif:
        value["duration_seconds"] = video_duration(F.col("ismovie"), F.col("exif_info.duration"))
    if "camera_model" in exif:
        value["device"] = F.col("exif_info.camera_model")
    if "albums" in there:
        value["album_count"] = F.when(F.col("albums").isNotNull(), F.size("albums")).otherwise(0)
    if bursts is not None:
        value["burst_key"] = F.col("_burst")
    if with_derivatives and "derivatives" in there:
        photos = photos.withColumn("_picks", derivative_choice(F.col("derivatives")))
        value |= {"derivative_path": F.col("_picks.analysis"), "display_path": F.col("_picks.display")}
    if "date" in there and "date_local" not in value:
        value["date_local"] = F.col("date_local") if "date_local" in there else F.col("date")
    return photos.select(*[value.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])


def find_settings(path: str | Path | None = None, cwd: str | Path = ".", home: str | Path | None = None) -> Path | None:
    """The settings file that counts: the named one, which must be there, else that of the folder, else that of the user."""
    if path is not None:
        if not Path(path).is_file():
            raise FileNotFoundError(f"settings not found: {path}")
        return Path(path)
    user = Path(home) if home is not None else Path.home()
    return next((p for p in (Path(cwd) / SETTINGS_FILE, user / ".config" / SETTINGS_FILE) if p.is_file()), None)
