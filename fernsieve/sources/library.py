"""From a photo library's raw tables to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_duration(is_movie: Column, exif_seconds: Column) -> Column:
    """Only movies have one, and only if it was recorded."""
    return F.when(is_movie, exif_seconds)


def expand_bursts(photos: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Records of photos and of their bursts' other members, each uuid once: the one that comes first.

    ``photos`` has uuid, burst, burst_photos (array of structs with uuid and intrash) and an ordinal. All members of
    a burst have the uuid of its key photo as burst_key. Members in the trash are left out.
    """
    row = photos.withColumn("burst_key", F.when(F.col("burst"), F.col("uuid")))
    own = row.select(F.struct(F.col(ordinal).alias("a"), F.lit(-1).alias("b")).alias("at"), "uuid", "burst_key")
    siblings = row.where("burst").select(F.col(ordinal), "burst_key", F.posexplode("burst_photos").alias("b", "s")).where("not coalesce(s.intrash, false)").select(F.struct(F.col(ordinal).alias("a"), "b").alias("at"), F.col("s.uuid").alias("uuid"), "burst_key")
    return own.union(siblings).groupBy("uuid").agg(F.min_by("burst_key", "at").alias("burst_key"), F.min("at").alias("at"))


def album_members(albums: DataFrame, title: str = "Keepers", folders: tuple[str, ...] = ("Cull",)) -> DataFrame:
    """uuids of the first album with this title in exactly these folders."""
    there = albums.where((F.col("title") == title) & (F.col("folder_names") == F.array(*map(F.lit, folders))))
    return there.orderBy("ordinal").limit(1).select(F.explode("uuids").alias("uuid")).distinct()


def derivative_choice(candidates: Column) -> Column:
    """(analysis, display): paths of the smallest and the largest raster of an array of (w, h, path).

    Rasters without a size count for neither; a single candidate is taken for analysis unmeasured. Area, then width,
    height and path decide; of equally large ones the lowest path is displayed.
    """
    measured = F.array_sort(F.transform(F.filter(candidates, lambda c: c["w"].isNotNull() & c["h"].isNotNull()), lambda c: F.struct((c["w"].cast("bigint") * c["h"]).alias("area"), c["w"].alias("w"), c["h"].alias("h"), c["path"].alias("path"))))
    top = F.try_element_at(measured, F.lit(-1))
    ties = F.filter(measured, lambda c: (c["area"] == top["area"]) & (c["w"] == top["w"]) & (c["h"] == top["h"]))
    small = F.when(F.size(candidates) == 1, F.try_element_at(candidates, F.lit(1))["path"]).otherwise(F.try_element_at(measured, F.lit(1))["path"])
    return F.struct(small.alias("analysis"), F.try_element_at(ties, F.lit(1))["path"].alias("display"))
