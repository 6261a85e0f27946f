"""Runs along a global order, without ever bringing the order into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernsieve.operators.components import connected_components
from fernsieve.plans.staging import stage_table


def number_runs(df: DataFrame, order: Sequence[str], starts: Column, before: Sequence[str], name: str = "run") -> DataFrame:
    """Number the runs of ``df`` along ``order``: a row whose ``starts`` is true begins one; adds ``name`` from 0.

    ``starts`` may use the previous row's ``before`` columns as ``_before.<column>``, null on the first row.
    Rows are dealt to ranges of the order; each range numbers its own runs, and what one row for each range says about
    its ends (as many rows as there are tasks) joins them. Ranges hold whole rows, so equal keys can be split.
    """
    columns = df.columns
    dealt = stage_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    edge = F.struct(*before)
    inside = Window.partitionBy("_part").orderBy(*order)
    local = dealt.withColumn("_lag", F.lag(F.struct(F.lit(True).alias("there"), edge.alias("row"))).over(inside))
    ends = dealt.groupBy("_part").agg(F.max_by(edge, F.struct(*order)).alias("_last"), F.min(F.struct(*order)).alias("_low"))
    # as many rows as ranges
    across = ends.select("_part", F.lag("_last").over(Window.orderBy("_low")).alias("_carried"))
    flagged = local.join(F.broadcast(across), "_part").withColumn("_before", F.when(F.col("_lag").isNotNull(), F.col("_lag.row")).otherwise(F.col("_carried"))).withColumn("_new", F.coalesce(starts, F.lit(True)).cast("long"))
    flagged = flagged.withColumn("_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = flagged.groupBy("_part").agg(F.sum("_new").alias("_news"), F.min(F.struct(*order)).alias("_low"))
    offsets = sums.select("_part", F.coalesce(F.sum("_news").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return flagged.join(F.broadcast(offsets), "_part").select(*columns, (F.col("_offset") + F.col("_local") - 1).alias(name))


def micros(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def time_buckets(records: DataFrame, gap_seconds: float = 90.0) -> DataFrame:
    """Add bucket_ord and member_ord to the dated records, in order of (date, uuid).

    A record stays in its predecessor's bucket if less than ``gap_seconds`` have passed, or both have the same burst.
    """
    close = (micros("date") - micros(F.col("_before.date"))) < int(gap_seconds * 1_000_000)
    same = F.coalesce(F.col("burst_key") == F.col("_before.burst_key"), F.lit(False))
    runs = number_runs(records.where("date is not null"), ["date", "uuid"], F.when(F.col("_before").isNull(), True).otherwise(~(close | same)), ["date", "burst_key"], "bucket_ord")
    return runs.withColumn("member_ord", F.row_number().over(Window.partitionBy("bucket_ord").orderBy("date", "uuid")) - 1)


def merge_bursts(buckets: DataFrame) -> DataFrame:
    """Join buckets that share a burst, over any number of steps; a joined bucket has the number of its earliest one."""
    keys = buckets.where("burst_key is not null").select("burst_key", "bucket_ord").distinct()
    first = keys.groupBy("burst_key").agg(F.min("bucket_ord").alias("a"))
    edges = keys.join(first, "burst_key").where("bucket_ord <> a").select("a", F.col("bucket_ord").alias("b"))
    roots = connected_components(edges)
    merged = buckets.join(roots, buckets["bucket_ord"] == roots["node"], "left").withColumn("bucket_ord", F.coalesce("root", "bucket_ord")).drop("node", "root")
    return merged.withColumn("member_ord", F.row_number().over(Window.partitionBy("bucket_ord").orderBy("date", "uuid")) - 1)


def candidate_buckets(records: DataFrame, gap_seconds: float = 90.0, include_shared: bool = False) -> DataFrame:
    """Buckets of two or more records that can be compared.

    Shared records go before bucketing; records without a raster only afterwards, so that they still bridge a gap.
    """
    buckets = merge_bursts(time_buckets(records if include_shared else records.where("not is_shared"), gap_seconds))
    usable = buckets.where("derivative_path is not null").withColumn("bucket_size", F.count("*").over(Window.partitionBy("bucket_ord")))
    return usable.where("bucket_size >= 2").withColumn("member_ord", F.row_number().over(Window.partitionBy("bucket_ord").orderBy("date", "uuid")) - 1)


def gap_run_count(records: DataFrame, gap_seconds: float = 90.0) -> DataFrame:
    """How many runs of two or more dated records have less than ``gap_seconds`` between neighbours."""
    close = (micros("date") - micros(F.col("_before.date"))) < int(gap_seconds * 1_000_000)
    runs = number_runs(records.where("date is not null").select("uuid", "date"), ["date", "uuid"], F.when(F.col("_before").isNull(), True).otherwise(~close), ["date"])
    return runs.groupBy("run").count().where("count >= 2").agg(F.count("*").alias("n_runs"))


def trips(pool: DataFrame, gap_hours: float = 48.0, min_size: int = 3) -> DataFrame:
    """trip_ord and member_ord of the pool's records: a gap of more than ``gap_hours``, or a missing date, splits."""
    near = (micros("date") - micros(F.col("_before.date"))) <= int(gap_hours * 3_600_000_000)
    order = pool.withColumn("_dated", F.col("date").isNotNull())
    runs = number_runs(order, ["_dated", "date", "uuid"], F.when(F.col("_before").isNull(), True).otherwise(~F.coalesce(near, F.lit(False))), ["date"], "trip_ord").drop("_dated")
    sized = runs.withColumn("trip_size", F.count("*").over(Window.partitionBy("trip_ord")))
    return sized.where(F.col("trip_size") >= min_size).withColumn("member_ord", F.row_number().over(Window.partitionBy("trip_ord").orderBy(F.col("date").asc_nulls_first(), "uuid")) - 1)
