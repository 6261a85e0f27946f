"""Bulk categories for culling: old screenshots, short videos, exact duplicates; each record in one at most."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsieve.schema import SweepSettings

#: Categories in order of precedence, their albums, days of a month.
CATEGORIES = ("screenshots", "short_videos", "exact_duplicates")
ALBUMS = {"screenshots": "Old Screenshots", "short_videos": "Short Videos", "exact_duplicates": "Exact Duplicates"}
MONTH_DAYS = 30.44


def eligible() -> Column:
    return ~(F.col("is_shared") | F.col("is_favorite") | F.col("is_hidden"))


def old_screenshots(records: DataFrame, now: dt.datetime, months: float = 12) -> DataFrame:
    """Dated screenshots and screen recordings from before ``now`` less so many months."""
    cutoff = (now - dt.timedelta(days=MONTH_DAYS * months)).isoformat(sep=" ")
    return records.where((F.col("is_screenshot") | F.col("is_screen_recording")) & eligible() & (F.col("date") < F.lit(cutoff).cast(records.schema["date"].dataType)))


def short_videos(records: DataFrame, seconds: float = 5.0) -> DataFrame:
    return records.where(F.col("is_video") & eligible() & (F.col("duration_seconds") < seconds))


def exact_duplicates(records: DataFrame) -> DataFrame:
    """All but the earliest of records with one fingerprint, unless any of them is ineligible; undated ones are latest.

    The group's size, eligibility and survivor are a partial aggregate, joined back: a fingerprint with a third of all
    records is never sorted in one task.
    """
    named = records.where("fingerprint <> ''")
    order = F.struct(F.col("date").isNull().alias("undated"), F.col("date"), F.col("uuid"))
    groups = named.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.bool_and(eligible()).alias("_all"), F.min(order).alias("_first"))
    doomed = groups.where("_n >= 2 and _all").select("fingerprint", F.col("_first.uuid").alias("_keep"))
    return named.join(doomed, "fingerprint").where(F.col("uuid") != F.col("_keep")).select(*records.columns)


def build_sweep(records: DataFrame, now: dt.datetime, settings: SweepSettings = SweepSettings()) -> DataFrame:
    """(category, uuid) with first match winning."""
    found = [
        old_screenshots(records, now, settings.screenshot_age_months) if settings.screenshots else None,
        short_videos(records, settings.short_video_seconds) if settings.short_videos else None,
        exact_duplicates(records) if settings.exact_duplicates else None,
    ]
    union = reduce(DataFrame.union, [x.select(F.lit(k).alias("rank"), "uuid") for k, x in enumerate(found) if x is not None], records.select(F.lit(0).alias("rank"), "uuid").limit(0))
    first = union.groupBy("uuid").agg(F.min("rank").alias("rank"))
    return first.select(F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("rank") + 1).alias("category"), "uuid")


def sweep_counts(sweep: DataFrame) -> DataFrame:
    """Every category with its size, empty ones included."""
    return sweep.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("count")) for c in CATEGORIES])))


def sweep_actions(sweep: DataFrame, overrides: dict[str, str] | None = None, keyword: str = "cull") -> DataFrame:
    """What would carry a sweep out: for each record its category's album (or the uuid's override) and a keyword."""
    album = F.element_at(F.create_map(*[F.lit(x) for kv in ALBUMS.items() for x in kv]), F.col("category"))
    if overrides:
        album = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), F.col("uuid")), album)
    pair = F.array(F.struct(F.lit("album").alias("kind"), F.concat(F.lit("Cull/"), album).alias("target")), F.struct(F.lit("keyword").alias("kind"), F.lit(keyword).alias("target")))
    return sweep.select("uuid", "category", F.inline(pair))


def sweep_keys(sweep: DataFrame) -> DataFrame:
    """A key for each category's content: it names the sorted uuids. A category is one document for people to confirm."""
    lines = F.array_join(F.array_sort(F.collect_list("uuid")), "\n")
    return sweep.groupBy("category").agg(F.concat(F.lit("sweep:"), F.first("category"), F.lit(":"), F.substring(F.sha2(lines, 256), 1, 16)).alias("sweep_key"))


