"""From records to ranked clusters in one call, with what has been measured before read from a cache."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsieve.functions.scalar import mod_key
from fernsieve.operators import exports, scoring, sessions, vectors
from fernsieve.plans.progress import Progress, watched
from fernsieve.plans.staging import drop_staged, stage_table
from fernsieve.schema import ClusterSettings
from fernsieve.sources import cache

#: What is measured of a photo besides its vector.
ANALYSIS = "uuid string, mod_key string, analysis_key string, laplacian double, width int, height int, exposure double, faces double, framing double, horizon double, capture_quality double, smiling double"
VECTOR = "uuid string, mod_key string, analysis_key string, embedding array<float>"
VERSION = 1
Measure = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Clusters:
    """members: (cluster_id, member_ord, uuid, criteria, total, dropped, rank, winner, ambiguous, distance_to_winner);
    clusters: (cluster_id, size, winner, ambiguous, diameter, median_distance, sharpness_available, dropped)."""

    members: DataFrame
    clusters: DataFrame


def measured(wanted: DataFrame, kind: str, schema: str, measure: Measure, folder: str | None) -> DataFrame:
    """``wanted(uuid, mod_key, analysis_key, ...)`` measured: from the cache where all three keys are there, else anew.

    ``measure`` gets only what the cache lacks and returns the three keys and what it measured; that is added to the
    cache. Without a folder everything is measured. Photos that it returns no row for are left out. A table.
    """
    spark = wanted.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    if folder is None:
        return stage_table(measure(wanted).select(*names), kind)
    at = cache.cache_folder(folder, kind, VERSION)
    hits, misses = cache.hits_and_misses(wanted, cache.get(spark, at, schema, wanted))
    fresh = stage_table(measure(misses).select(*names), kind)
    known = stage_table(hits.select(*names), kind)
    if not fresh.isEmpty():
        cache.put(fresh, at)
    out = stage_table(known.union(fresh), kind)
    drop_staged(fresh, known)
    return out


def run_pipeline(records: DataFrame, vectors_of: Measure, analyse: Measure, settings: ClusterSettings | None = None, cache_folder: str | None = None, progress: Progress | None = None) -> Clusters:
    """Group records into ranked near-duplicate clusters.

    ``records`` are those of ``schema.RECORDS`` that bucketing reads. Vectors are measured of the members of buckets of
    two or more, all else of the members of clusters alone. Both measures get (uuid, mod_key, analysis_key, bucket or
    cluster columns) and return the columns of VECTOR and ANALYSIS. Clusters are numbered along capture order: by bucket,
    then by their first member. Empty records give empty tables. ``progress`` hears of the stages buckets, vectors, groups,
    scores and ranks, in this order.
    """
    cfg = settings or ClusterSettings()
    stage = lambda name: watched(records.sparkSession, name, progress)
    with stage("buckets"):
        buckets = stage_table(sessions.candidate_buckets(records, cfg.gap_seconds, cfg.include_shared), "buckets")
    key = mod_key(F.col("mod_date")) if "mod_date" in records.columns else F.lit("")
    photos = buckets.select("uuid", key.alias("mod_key"), F.col("derivative_path").alias("analysis_key"), F.col("bucket_ord").alias("bucket_id"), "member_ord")
    with stage("vectors"):
        photos = stage_table(photos, "photos")
        prints = measured(photos, "vectors", VECTOR, vectors_of, cache_folder)
    usable = photos.join(prints.select("uuid", "embedding"), "uuid")
    with stage("groups"):
        groups = stage_table(vectors.linkage_clusters(usable, cfg.similarity_threshold), "groups")
        named = groups.withColumn("cluster_id", F.concat_ws("-", F.lpad(F.col("bucket_id").cast("string"), 12, "0"), F.lpad(F.col("cluster_ord").cast("string"), 6, "0"))).select("cluster_id", "member_ord", "uuid")
        members = stage_table(named.join(photos.select("uuid", "mod_key", "analysis_key"), "uuid").join(prints.select("uuid", "embedding"), "uuid"), "members")
    with stage("scores"):
        analysis = measured(members.select("uuid", "mod_key", "analysis_key", "cluster_id"), "scores", ANALYSIS, analyse, cache_folder)
    one = members.select("cluster_id", "member_ord", "uuid", "embedding").join(analysis.drop("mod_key", "analysis_key"), "uuid", "left")
    sharp = scoring.relative_sharpness(one, cfg.sharpness_size_tolerance)
    full = sharp.withColumn("facing", F.lit(None).cast("double")).drop("laplacian", "width", "height")
    ranked = scoring.rank_members(scoring.common_criteria(full, cfg.weights), cfg.ambiguity_margin)
    with stage("ranks"):
        placed = stage_table(exports.winner_distances(ranked), "ranked")
        out = Clusters(placed.drop("embedding"), assessed(placed))
    drop_staged(buckets, photos, prints, groups, members, analysis)
    return out


def assessed(members: DataFrame) -> DataFrame:
    """What each cluster knows of itself: size, winner, diameter and median of its distances, whether sharpness counted. A table.

    ``members`` has cluster_id, member_ord, uuid, embedding, sharpness, winner, ambiguous and dropped.
    """
    apart = vectors.pair_statistics(members.select("cluster_id", "uuid", "member_ord", "embedding"), "cluster_id").select("cluster_id", "diameter", F.col("median").alias("median_distance"))
    of = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.first("winner").alias("winner"), F.first("ambiguous").alias("ambiguous"), (F.count("sharpness") > 0).alias("sharpness_available"), F.first("dropped").alias("dropped"))
    return stage_table(of.join(apart, "cluster_id", "left").select("cluster_id", "size", "winner", "ambiguous", "diameter", "median_distance", "sharpness_available", "dropped"), "assessed")
