"""Sequences of album drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def move_before(sequence: Column, dragged: Column, target: Column) -> Column:
    """The sequence with one entry moved before another; unchanged if they are equal or one is missing."""
    without = F.array_remove(sequence, dragged)
    moved = F.array_insert(without, F.greatest(F.array_position(without, target), F.lit(1)).cast("int"), dragged)
    able = (dragged != target) & F.array_contains(sequence, dragged) & F.array_contains(sequence, target)
    return F.when(able, moved).otherwise(sequence)


def unknown_entries(albums: DataFrame, pool: DataFrame) -> DataFrame:
    """(album_id, uuid) of sequences' entries that the pool does not have: such a save is refused."""
    return albums.select("album_id", F.explode("sequence").alias("uuid")).distinct().join(pool.select("uuid"), "uuid", "left_anti").select("album_id", "uuid")


def export_plan(albums: DataFrame, photos: DataFrame, width: int, height: int) -> DataFrame:
    """(album_id, place, uuid, status, crop): every entry in order; entries without a photo have failed."""
    from fernsieve.functions.scalar import crop_rect

    entries = albums.select("album_id", F.posexplode("sequence").alias("place", "uuid"), F.col("offsets").alias("_offsets"))
    at = F.try_element_at("_offsets", F.col("uuid"))
    joined = entries.join(photos.select("uuid", "width", "height").withColumn("_in", F.lit(True)), "uuid", "left")
    crop = crop_rect(F.col("width"), F.col("height"), width, height, F.coalesce(at["x"], F.lit(0.5)), F.coalesce(at["y"], F.lit(0.5)))
    return joined.select("album_id", "place", "uuid", F.when(F.col("_in"), "planned").otherwise("failed").alias("status"), F.when(F.col("_in"), crop).alias("crop"))


def needs_crop(width: Column, height: Column, crop: Column) -> Column:
    return (crop["width"] != width) | (crop["height"] != height)
