"""Keepers for albums: their pool, and how far trips spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsieve.functions.scalar import haversine_km, trip_title
from fernsieve.operators import vectors
from fernsieve.plans.staging import sent_if_few, stage_table

#: Cells of the grids in turn, for each unit; the first has some 4,800 cells on the sphere. Cells of a trip that one task compares.
GRIDS, MOST_CELLS = (16, 128, 1024, 8192), 8192


def keeper_pool(records: DataFrame, keepers: DataFrame, order: Column | None = None) -> DataFrame:
    """Photos that are keepers or favorites, each uuid once (the first along ``order``); videos never."""
    marked = records.join(keepers.select("uuid").distinct().withColumn("_kept", F.lit(True)), "uuid", "left")
    chosen = marked.where(~F.col("is_video") & (F.coalesce("_kept", F.lit(False)) | F.col("is_favorite"))).drop("_kept")
    row = F.struct(*[F.col(c) for c in records.columns])
    first = chosen.groupBy("uuid").agg(F.min_by(row, order if order is not None else F.col("uuid")).alias("row"))
    return first.select("row.*")


def outer_places(places: DataFrame) -> DataFrame:
    """Of ``places(trip_ord, place, x, y, z)``, points of the unit sphere, those that may be an end of their trip's longest way.

    Trips of more places than a block are put on a grid in space. A cell is a row whatever it holds: the box of its
    points, and one of them. Boxes that cannot be as far from any other box as two of the points are apart are dropped
    with all they hold; what is left goes on to a finer grid. A trip whose cells are too many for one task stays as it is.
    """
    for cells in GRIDS:
        counted = places.groupBy("trip_ord").agg((F.count("*") > vectors.BLOCK).alias("many")).where("many").select("trip_ord")
        wide = places.join(sent_if_few(stage_table(counted, "wide")), "trip_ord").withColumns({f"c_{c}": F.floor(F.col(c) * cells).cast("int") for c in "xyz"})
        boxes = wide.groupBy("trip_ord", "c_x", "c_y", "c_z").agg(F.min_by(F.struct("x", "y", "z"), "place").alias("one"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
        boxes = stage_table(boxes, "boxes")
        if boxes.isEmpty():
            break
        fit = sent_if_few(stage_table(boxes.groupBy("trip_ord").count().where(F.col("count") <= MOST_CELLS).select("trip_ord"), "fit"))
        flat = boxes.join(fit, "trip_ord").select("trip_ord", "c_x", "c_y", "c_z", "one.*", *[f"{n}_{c}" for c in "xyz" for n in ("low", "high")])
        kind = dict(places.dtypes)["trip_ord"]
        dropped = stage_table(flat.groupBy("trip_ord").applyInPandas(inner_boxes, f"trip_ord {kind}, c_x int, c_y int, c_z int"), "inner")
        grid = places.withColumns({f"c_{c}": F.floor(F.col(c) * cells).cast("int") for c in "xyz"})
        places = stage_table(grid.join(sent_if_few(dropped), ["trip_ord", "c_x", "c_y", "c_z"], "left_anti").drop("c_x", "c_y", "c_z"), "outer")
    return places


def inner_boxes(boxes: pd.DataFrame) -> pd.DataFrame:
    """The boxes of one trip, MOST_CELLS at most, that hold no end of its longest way."""
    one = boxes[["x", "y", "z"]].to_numpy()
    low, high = boxes[["low_x", "low_y", "low_z"]].to_numpy(), boxes[["high_x", "high_y", "high_z"]].to_numpy()
    parts = np.array_split(np.arange(len(boxes)), -(-len(boxes) // 256))
    apart = max(float(((one[p][:, None] - one[None]) ** 2).sum(axis=2).max()) for p in parts)
    apart = max(apart, float(((high - low) ** 2).max(axis=1).max()) if len(boxes) else 0.0)  # a box's side is some two points' difference
    reach = np.concatenate([(np.maximum(high[p][:, None] - low[None], high[None] - low[p][:, None]) ** 2).sum(axis=2).max(axis=1) for p in parts])
    return boxes.loc[reach < apart - 1e-12, ["trip_ord", "c_x", "c_y", "c_z"]]


def trip_spread(members: DataFrame, limit_km: float = 150.0) -> DataFrame:
    """For each trip its size, title, the largest distance between located members (null with fewer than two) and a flag.

    Equal places count once. Places are points of the unit sphere, where the farthest pair by chord is the farthest by
    way, over poles and the date line too. Trips of many places first lose those that lie inside; the rest are compared in
    cells of two blocks, of which each hands on one pair.
    """
    trips = members.groupBy("trip_ord").agg(F.count("*").alias("size"), F.min("date").alias("start"), F.max("date").alias("end"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located"))
    lat, lon = F.radians("latitude"), F.radians("longitude")
    places = members.where("latitude is not null and longitude is not null").select("trip_ord", F.concat_ws("|", F.col("latitude").cast("double").cast("string"), F.col("longitude").cast("double").cast("string")).alias("place"), (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    outer = outer_places(stage_table(places.dropDuplicates(["trip_ord", "place"]), "places"))
    points = outer.select("trip_ord", F.col("place").alias("uuid"), F.lit(0).alias("member_ord"), F.array("x", "y", "z").alias("embedding"))
    ends = vectors.farthest_pairs(points, "trip_ord")
    at = lambda c, k: F.element_at(F.split(c, r"\|"), k).cast("double")
    far = ends.select("trip_ord", haversine_km(at("uuid_a", 1), at("uuid_a", 2), at("uuid_b", 1), at("uuid_b", 2)).alias("far"))
    spread = F.when(F.col("located") >= 2, F.coalesce("far", F.lit(0.0)))
    return trips.join(far, "trip_ord", "left").select("trip_ord", "size", trip_title(F.col("start"), F.col("end")).alias("title"), spread.alias("spread_km"), F.coalesce(spread > limit_km, F.lit(False)).alias("wide"))
