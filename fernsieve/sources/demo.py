"""Made-up clusters and photos with set shares, as many as there are keys: for trying surfaces out, and for load."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First date, sizes of rasters and photos, and what scores a take has.
FIRST_DAY = "2026-03-01 09:00:00"
SMALL, LARGE, PHOTO = (480, 360), (1024, 768), (4032, 3024)
BEST_TOTAL, GAP_CLEAR, GAP_CLOSE = 0.70, 0.09, 0.004
SPREAD_CLEAR, SPREAD_CLOSE = 2600, 200  # ten-thousandths of sharpness between the best take and the farthest
MEASURES = {"faces": 0.44, "framing": 0.58, "horizon": 0.81}
MATCHING, CROPPED = (1800, 1200), (1600, 1200)
DRAW = 1 << 32


@dataclass(frozen=True)
class DemoShares:
    """Shares of all clusters, each between 0 and 1; those of sizes sum to 1.

    ``low`` has small rasters only, ``mixed`` at least one of either kind; ``evicted`` lacks its last take's file;
    ``unmeasured`` has no sharpness. Cases are dealt independently of each other, so they meet.
    """

    sizes: dict[int, float] = field(default_factory=lambda: {2: 17 / 24, 3: 2 / 24, 4: 2 / 24, 5: 1 / 24, 9: 1 / 24, 20: 1 / 24})
    ambiguous: float = 10 / 24
    unmeasured: float = 2 / 24
    low: float = 6 / 24
    mixed: float = 2 / 24
    evicted: float = 1 / 24
    no_horizon: float = 22 / 24
    no_faces: float = 5 / 24

    def __post_init__(self) -> None:
        shares = [self.ambiguous, self.unmeasured, self.low + self.mixed, self.evicted, self.no_horizon, self.no_faces, *self.sizes.values()]
        if any(not 0 <= s <= 1 for s in shares) or abs(sum(self.sizes.values()) - 1) > 1e-9 or min(self.sizes, default=0) < 2:
            raise ValueError("shares lie between 0 and 1, those of sizes sum to 1, and a cluster has at least two takes")


def _draw(digest: Column, k: int) -> Column:
    """The k-th of eight numbers from 0 to 2**32 - 1 that a sha256 in hex holds."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _digest(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def demo_clusters(keys: DataFrame, shares: DemoShares | None = None, seed: int = 0) -> DataFrame:
    """One cluster for each ``cluster_ord`` (a whole number of 0 or more): what it is, from seed and number alone.

    (cluster_ord, size, best, winner, ambiguous, sharpness_available, dropped, n_small, evicted, diameter,
    median_distance). ``best`` is the winner's place, never 0. Null and negative numbers give no cluster, repeated
    ones repeat. Nothing is shuffled, so rows do not depend on how ``keys`` is partitioned.
    """
    s = shares or DemoShares()
    under = lambda k, share: _draw(F.col("_d"), k) < round(share * DRAW)
    size, low = F.lit(max(s.sizes)), 0.0
    steps = []
    for n, share in sorted(s.sizes.items()):
        low += share
        steps.append((n, low))
    for n, bound in reversed(steps[:-1]):
        size = F.when(under(0, bound), n).otherwise(size)
    base = keys.where("cluster_ord >= 0").select(F.col("cluster_ord").cast("bigint").alias("cluster_ord")).withColumn("_d", _digest(seed, "cluster_ord")).withColumn("size", size.cast("int"))
    small = F.when(under(3, s.low), F.col("size")).when(under(3, s.low + s.mixed), (1 + _draw(F.col("_d"), 4) % (F.col("size") - 1)).cast("int")).otherwise(0)
    dealt = base.withColumns({"best": (1 + F.col("cluster_ord") * 7 % (F.col("size") - 1)).cast("int"), "ambiguous": under(1, s.ambiguous), "sharpness_available": ~under(2, s.unmeasured), "n_small": small, "evicted": under(5, s.evicted)})
    lost = [("faces", under(6, s.no_faces)), ("framing", under(6, s.no_faces)), ("horizon", under(7, s.no_horizon)), ("sharpness", ~F.col("sharpness_available"))]
    return dealt.select(
        "cluster_ord", "size", "best", take_uuid(F.col("cluster_ord"), F.col("best")).alias("winner"), "ambiguous", "sharpness_available",
        F.array_compact(F.array(*[F.when(c, n) for n, c in lost])).alias("dropped"), "n_small", "evicted",
        F.round(0.11 + 0.02 * F.col("size"), 4).alias("diameter"), F.round(0.09 + 0.01 * F.col("size"), 4).alias("median_distance"),
    )


def take_uuid(cluster: Column, place: Column) -> Column:
    return F.format_string("demo-%02d-%03d", cluster, place)


def demo_members(clusters: DataFrame) -> DataFrame:
    """The takes of ``demo_clusters``: records, scores that agree with what the cluster says, and distances to the winner.

    Total and sharpness fall with the distance from the best place, whose sharpness is 1; what the cluster dropped is
    null. An evicted cluster's last take has a path but no raster (display_width is null); a take with a small raster
    has one file for both uses.
    """
    row = clusters.withColumn("member_ord", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    away, span = F.abs(F.col("member_ord") - F.col("best")), F.greatest(F.col("best"), F.col("size") - 1 - F.col("best"))
    spread = F.when(F.col("ambiguous"), SPREAD_CLOSE).otherwise(SPREAD_CLEAR)
    lost = F.floor((2 * spread * away + span) / (2 * span))  # rounded in whole numbers
    small, gone = F.col("member_ord") < F.col("n_small"), F.col("evicted") & (F.col("member_ord") == F.col("size") - 1)
    uuid = take_uuid(F.col("cluster_ord"), F.col("member_ord"))
    kept = lambda name, value: F.when(~F.array_contains("dropped", name), value)
    made = {
        "uuid": uuid, "date": F.timestamp_add("SECOND", F.col("cluster_ord") * 86400 + F.col("member_ord") * 3, F.lit(FIRST_DAY).cast("timestamp")),
        "width": F.lit(PHOTO[0]), "height": F.lit(PHOTO[1]), "display_path": F.concat(uuid, F.lit(".png")),
        "derivative_path": F.concat(uuid, F.when(small, ".png").otherwise("-analysis.png")),
        "display_width": F.when(~gone, F.when(small, SMALL[0]).otherwise(LARGE[0])), "display_height": F.when(~gone, F.when(small, SMALL[1]).otherwise(LARGE[1])),
        "sharpness": kept("sharpness", (10_000 - lost) / 10_000.0), "exposure": F.round(0.61 + F.col("member_ord") * 0.01, 4),
    }
    made |= {name: kept(name, F.lit(value)) for name, value in MEASURES.items()}
    made |= {"total": F.round(BEST_TOTAL - away * F.when(F.col("ambiguous"), GAP_CLOSE).otherwise(GAP_CLEAR), 6), "distance_to_winner": F.when(away > 0, F.round(0.11 + 0.02 * F.col("member_ord"), 4))}
    return row.select("cluster_ord", "member_ord", *[c.alias(n) for n, c in made.items()], "winner", "ambiguous", "dropped")


def demo_pool(keys: DataFrame, per_trip: int = 4, cropped: float = 0.8, seed: int = 0) -> DataFrame:
    """A favorite photo for each ``photo_ord``: trips a week apart of ``per_trip`` photos two hours apart, this share of them needing a crop.

    (photo_ord, trip_ord, uuid, date, width, height, is_favorite, display_path). Null and negative numbers give none.
    """
    row = keys.where("photo_ord >= 0").select(F.col("photo_ord").cast("bigint").alias("photo_ord")).withColumn("trip_ord", F.floor(F.col("photo_ord") / per_trip))
    off = _draw(_digest(seed, "photo_ord"), 0) < round(cropped * DRAW)
    uuid = F.format_string("demo-album-%d-%02d", F.col("trip_ord"), F.col("photo_ord"))
    hours = F.col("trip_ord") * 168 + F.col("photo_ord") % per_trip * 2
    return row.select(
        "photo_ord", "trip_ord", uuid.alias("uuid"), F.timestamp_add("HOUR", hours, F.lit(FIRST_DAY).cast("timestamp")).alias("date"),
        F.when(off, CROPPED[0]).otherwise(MATCHING[0]).alias("width"), F.when(off, CROPPED[1]).otherwise(MATCHING[1]).alias("height"), F.lit(True).alias("is_favorite"), F.concat(uuid, F.lit(".png")).alias("display_path"),
    )
