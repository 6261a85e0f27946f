"""Deterministic samples that give every stratum its share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernsieve.functions.scalar import half_even, size_band
from fernsieve.operators.sessions import number_runs
from fernsieve.plans.staging import stage_table


def quartile_cuts(values: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row of cuts by the same rule; counts of distinct values are summed in order, so no list is built."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    return exact_cuts(counts, shares)


def exact_cuts(counts: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Cuts from (v, count): places are looked up in ranges of the sorted values, whose sums alone are put in order."""
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    dealt = counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id())
    dealt = stage_table(dealt, "values")
    sums = dealt.groupBy("_part").agg(F.sum("count").alias("_sum"), F.min("v").alias("_low"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each task
    upto = dealt.join(F.broadcast(before), "_part").select("v", "count", (F.col("_before") + F.sum("count").over(Window.partitionBy("_part").orderBy("v"))).alias("upto")).crossJoin(F.broadcast(n))
    return upto.agg(*[F.min(F.when(F.col("upto") > F.floor(F.lit(s) * F.col("n")), F.col("v"))).alias(f"q{k + 1}") for k, s in enumerate(shares)])


def strata(population: DataFrame, size: str = "size", spread: str = "diameter") -> DataFrame:
    """Add stratum: the band of the size and the quarter of the spread; an unknown spread is in the first quarter."""
    cuts = quartile_cuts(population, spread)
    quarter = F.lit(1) + sum((F.when(F.col(spread) >= F.col(f"q{k}"), 1).otherwise(0) for k in (1, 2, 3)), F.lit(0))
    return population.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.concat(size_band(F.col(size)), F.lit("/d"), quarter.cast("string"))).drop("q1", "q2", "q3")


def allocate(pools: dict[str, int], limit: int) -> dict[str, int]:
    """Equal shares of ``limit``; what small strata cannot fill goes to the others, an uneven rest to the first names."""
    given = dict.fromkeys(pools, 0)
    left = min(limit, sum(pools.values()))
    while left:
        hungry = sorted(k for k in pools if given[k] < pools[k])
        each = left // len(hungry)
        for k in hungry if each else hungry[:left]:
            more = min(max(each, 1), pools[k] - given[k])
            given[k] += more
            left -= more
        if not each:
            break
    return given


def even_places(count: Column, take: Column) -> Column:
    """``take`` places among ``count``, spread evenly, the first and the last among them; one is the first."""
    spaced = F.transform(F.sequence(F.lit(0), F.greatest(take, F.lit(1)) - 1), lambda i: half_even(i * (count - 1) / F.greatest(take - 1, F.lit(1))))
    return F.when(count < 1, F.array().cast("array<bigint>")).when(take >= count, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).when(take > 0, spaced).otherwise(F.array().cast("array<bigint>"))


def stratified_sample(population: DataFrame, limit: int = 200, order: str = "ord") -> DataFrame:
    """The sampled rows of ``population`` with their stratum; strata are sixteen at most, so their counts go to the driver."""
    marked = strata(population)
    pools = {r["stratum"]: r["count"] for r in marked.groupBy("stratum").count().collect()}
    if not pools:
        return marked
    shares = population.sparkSession.createDataFrame([(k, pools[k], v) for k, v in allocate(pools, limit).items()], "stratum string, n bigint, take bigint")
    placed = number_runs(marked, ["stratum", order], F.lit(True), ["stratum"], "_row")
    first = placed.groupBy("stratum").agg(F.min("_row").alias("_first"))
    wanted = shares.select("stratum", F.explode(even_places(F.col("n"), F.col("take"))).alias("_place")).join(first, "stratum").select((F.col("_first") + F.col("_place")).alias("_row"))
    return placed.join(F.broadcast(wanted.distinct()), "_row").drop("_row")


def population_totals(population: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: clusters, how many of them are sampled, their photos, and photos beyond one for each; zeros if empty."""
    sizes = population.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("photos"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("culled"))
    return sizes.join(F.broadcast(sample.agg(F.count("*").alias("sampled"))))  # two single rows
