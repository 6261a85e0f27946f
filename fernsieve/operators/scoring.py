"""Scores inside clusters: relative sharpness, totals over what all members have, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernsieve.functions.scalar import weighted_total
from fernsieve.schema import WEIGHTS


def relative_sharpness(members: DataFrame, tolerance: float = 1.0, cluster: str = "cluster_id") -> DataFrame:
    """Add sharpness, a member's detail by the cluster's best; null for all if the cluster cannot be compared.

    It cannot if a member's detail or size is unknown, the sides differ by more than ``tolerance``, or none has detail.
    """
    long = F.greatest("width", "height")
    of = members.groupBy(cluster).agg(F.max("laplacian").alias("_best"), F.min(long).alias("_low"), F.max(long).alias("_high"), F.bool_or(F.col("laplacian").isNull() | F.col("width").isNull() | F.col("height").isNull()).alias("_unknown"))
    fair = ~F.col("_unknown") & (F.col("_low") > 0) & (F.col("_high") <= F.col("_low") * F.lit(float(tolerance))) & (F.col("_best") > 0)
    return members.join(of, cluster).withColumn("sharpness", F.when(fair, F.col("laplacian") / F.col("_best"))).drop("_best", "_low", "_high", "_unknown")


def common_criteria(scores: DataFrame, weights: dict[str, float] = WEIGHTS, cluster: str = "cluster_id") -> DataFrame:
    """Add total over the criteria that every member of the cluster has, and ``dropped``: weighted ones that some lack."""
    used = {n: w for n, w in weights.items() if n in scores.columns}
    has = [(F.count(n) == F.count("*")).alias(f"_has_{n}") for n in used]
    whole = scores.join(scores.groupBy(cluster).agg(*has), cluster)
    total = weighted_total(used, {n: F.col(n) for n in used}, {n: F.col(f"_has_{n}") for n in used})
    missing = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"_has_{n}") if n in used else F.lit(True), F.lit(n)) for n, w in weights.items() if w > 0])))
    return whole.select(*scores.columns, total.alias("total"), missing.alias("dropped"))


def rank_members(scored: DataFrame, margin: float = 0.05, cluster: str = "cluster_id") -> DataFrame:
    """Add rank (best total first, then uuid), winner and ambiguous: the first two lie less than ``margin`` apart."""
    by = Window.partitionBy(cluster).orderBy(F.desc("total"), "uuid")
    ranked = scored.withColumn("rank", F.row_number().over(by))
    top = ranked.where("rank <= 2").groupBy(cluster).agg(F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("_one"), F.max(F.when(F.col("rank") == 2, F.col("total"))).alias("_two"), F.max(F.when(F.col("rank") == 1, F.col("uuid"))).alias("winner"))
    return ranked.join(top, cluster).withColumn("ambiguous", F.coalesce(F.col("_one") - F.col("_two") < margin, F.lit(False))).drop("_one", "_two")
