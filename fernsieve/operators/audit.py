"""What a library holds: totals, and breakdowns by year, type and duration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsieve.functions.scalar import DURATION_BANDS, duration_band
from fernsieve.schema import TYPE_FLAGS


def totals(records: DataFrame) -> DataFrame:
    """One row, zeros on an empty table."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return records.agg(
        F.count("*").alias("items"),
        F.count_if(~F.col("is_video")).alias("photos"),
        F.count_if("is_video").alias("videos"),
        whole("filesize").alias("size_bytes"),
        F.count_if("is_favorite").alias("favorites"),
        F.count_if(F.col("album_count") == 0).alias("no_album"),
        F.count_if("is_hidden").alias("hidden"),
    )


def by_year(records: DataFrame, date: str = "date_local") -> DataFrame:
    """Count and bytes of each year that has records; undated ones are left out."""
    return records.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("count"), F.sum("filesize").cast("bigint").alias("size_bytes"))


def by_type(records: DataFrame, types: tuple[str, ...] = TYPE_FLAGS) -> DataFrame:
    """Count and bytes by type flag; a record counts for every flag it has, and a flag that none has gives zeros."""
    flag = lambda t: F.coalesce(F.col(f"is_{t}"), F.lit(False)) if f"is_{t}" in records.columns else F.lit(False)
    sums = [x for t in types for x in (F.count_if(flag(t)).alias(f"{t}_n"), F.coalesce(F.sum(F.when(flag(t), F.col("filesize"))), F.lit(0)).cast("bigint").alias(f"{t}_b"))]
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"{t}_n").alias("count"), F.col(f"{t}_b").alias("size_bytes")) for t in types])
    return records.agg(*sums).select(F.inline(pairs))


def by_duration(records: DataFrame) -> DataFrame:
    """Count and bytes of videos in every band of duration, empty ones included."""
    band = F.when(F.col("is_video"), duration_band(F.col("duration_seconds")))
    names = [name for _, name in DURATION_BANDS]
    sums = [x for k, n in enumerate(names) for x in (F.count_if(band == n).alias(f"n{k}"), F.coalesce(F.sum(F.when(band == n, F.col("filesize"))), F.lit(0)).cast("bigint").alias(f"b{k}"))]
    rows = F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"n{k}").alias("count"), F.col(f"b{k}").alias("size_bytes")) for k, n in enumerate(names)])
    return records.agg(*sums).select(F.inline(rows))


def summary_json(records: DataFrame, near_duplicate_runs: DataFrame) -> DataFrame:
    """The whole audit as one JSON document; years are keys in order."""
    one = lambda df, key, name: df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.struct("count", "size_bytes")))))).alias(name))
    parts = [totals(records).select(F.to_json(F.struct("*")).alias("totals")), one(by_year(records), "year", "by_year"), one(by_type(records), "type", "by_type"), one(by_duration(records), "band", "by_duration"), near_duplicate_runs]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of one row each
