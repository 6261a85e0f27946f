"""Why a member stands where it does, and what deserves attention in a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernsieve.operators.scoring import common_criteria, rank_members
from fernsieve.schema import WEIGHTS

#: The least difference that is told, how many are, and bounds of annotations.
MIN_DELTA, MAX_REASONS = 0.005, 3
LOW_DETAIL, MIXED_RATIO, LARGE, BARELY = 640, 1.35, 10, 1.05


def reasons(scores: DataFrame, weights: dict[str, float] = WEIGHTS, margin: float = 0.05) -> DataFrame:
    """(cluster_id, uuid, place, criterion, delta, text): up to MAX_REASONS differences from the partner.

    The partner is the winner; the winner's own is the runner-up. Differences are ordered by weight times size (to nine decimals), then name.
    """
    used = [n for n in weights if n in scores.columns]
    ranked = rank_members(common_criteria(scores, weights), margin)
    first_two = ranked.where("rank <= 2")
    partner = first_two.select("cluster_id", F.when(F.col("rank") == 1, F.lit(False)).otherwise(F.lit(True)).alias("_for_winner"), *[F.col(n).alias(f"p_{n}") for n in used])
    joined = ranked.withColumn("_for_winner", F.col("rank") == 1).join(partner, ["cluster_id", "_for_winner"])
    entry = lambda n: F.struct(F.lit(n).alias("criterion"), F.lit(float(weights[n])).alias("weight"), F.when(~F.array_contains("dropped", n), F.col(n) - F.col(f"p_{n}")).alias("delta"))
    told = joined.select("cluster_id", "uuid", F.inline(F.array(*[entry(n) for n in used if weights[n] > 0]))).where(F.abs("delta") >= MIN_DELTA)
    order = Window.partitionBy("cluster_id", "uuid").orderBy(F.desc(F.round(F.abs(F.col("weight") * F.col("delta")), 9)), "criterion")
    text = F.format_string("%s on %s by %.3f", F.when(F.col("delta") > 0, "ahead").otherwise("behind"), F.col("criterion"), F.abs("delta"))
    return told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_REASONS).select("cluster_id", "uuid", "place", "criterion", "delta", text.alias("text"))


def standing(ranked: DataFrame) -> DataFrame:
    """(cluster_id, uuid, standing): how far a member is from the winner, or the winner from the next."""
    top = ranked.where("rank <= 2").groupBy("cluster_id").agg(F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("total"))).alias("two"))
    gap = F.when(F.col("rank") == 1, F.col("one") - F.col("two")).otherwise(F.col("one") - F.col("total"))
    close = F.col("ambiguous") & (F.col("rank") <= 2)
    words = F.when(close, F.format_string("a close call, %.3f apart", F.col("one") - F.col("two"))).when(F.col("rank") == 1, F.format_string("first by %.3f", gap)).otherwise(F.format_string("%.3f behind the first", gap))
    return ranked.join(top, "cluster_id").where("two is not null").select("cluster_id", "uuid", words.alias("standing"))


def sharpness_words(mine: Column, best: Column, softest: Column, n: Column) -> Column:
    """A member's sharpness against its cluster's, as a ratio."""
    return (
        F.when(mine < best, F.format_string("%.2f of the sharpest", mine / best)).when(softest <= 0, F.format_string("sharpest of %d, the softest has no detail", n))
        .when(best / softest < BARELY, F.format_string("sharpest of %d, barely: %.2f times the softest", n, best / softest)).otherwise(F.format_string("sharpest of %d: %.2f times the softest", n, best / softest))
    )


def ranking_basis(scored: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(cluster_id, basis): which criteria ranked a cluster, where some could not; null where all did."""
    weighed = F.array(*[F.lit(n) for n, w in weights.items() if w > 0])
    rest = F.array_except(weighed, F.col("dropped"))
    words = F.when(F.size("dropped") == 0, F.lit(None)).when(F.size(rest) == 0, F.lit("nothing could be measured for all")).otherwise(F.concat(F.lit("ranked on "), F.array_join(rest, ", "), F.lit("; not measured for all: "), F.array_join("dropped", ", ")))
    return scored.select("cluster_id", "dropped").distinct().select("cluster_id", words.cast("string").alias("basis"))


def annotations(members: DataFrame) -> DataFrame:
    """(cluster_id, notes) from members(cluster_id, long_side, sharpness, ambiguous); notes come in a fixed order."""
    of = members.groupBy("cluster_id").agg(
        F.bool_or("ambiguous").alias("ambiguous"), F.bool_or(F.col("long_side").isNull()).alias("blind"), F.count("sharpness").alias("sharp"),
        F.max(F.when(F.col("long_side") > 0, F.col("long_side"))).alias("high"), F.min(F.when(F.col("long_side") > 0, F.col("long_side"))).alias("low"), F.count("*").alias("n"),
    )
    notes = (
        ("ambiguous", F.col("ambiguous")), ("no-display", F.col("blind")), ("no-sharpness", F.col("sharp") == 0), ("low-detail", F.col("high") <= LOW_DETAIL),
        ("mixed-resolution", F.col("high") > F.col("low") * F.lit(MIXED_RATIO)), ("large-cluster", F.col("n") >= LARGE),
    )
    return of.select("cluster_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes])).alias("notes"))


def proposed_marks(ranked: DataFrame) -> DataFrame:
    """keep for a cluster's winner, cull for the others, unset for all where there is no winner."""
    return ranked.select("cluster_id", "uuid", F.when(F.col("winner").isNull(), "unset").when(F.col("uuid") == F.col("winner"), "keep").otherwise("cull").alias("mark"))
