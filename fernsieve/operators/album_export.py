"""Carrying albums out: every entry from the best rendition of its photo, each failing by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsieve.functions.scalar import crop_rect
from fernsieve.plans.staging import let_workers_import, stage_table

#: Gets album, photo, the rendition's path and the crop (x, y, width, height); raises if the entry can't be written.
Sink = Callable[[object, object, str, dict], None]
CENTRE = 0.5


def entries_of(albums: DataFrame) -> DataFrame:
    """(album_id, place, uuid, offset_x, offset_y) of albums' sequences; ``offsets`` maps uuid to a struct of x and y."""
    entries = albums.select("album_id", F.posexplode("sequence").alias("place", "uuid"), F.col("offsets").alias("_offsets"))
    at = F.try_element_at("_offsets", F.col("uuid"))
    return entries.select("album_id", "place", "uuid", at["x"].alias("offset_x"), at["y"].alias("offset_y"))


def chosen_renditions(photos: DataFrame, renditions: DataFrame) -> DataFrame:
    """(uuid, path, width, height, crop_not_applied): an adjusted photo's edited rendition, else the original.

    ``photos`` is (uuid, adjusted), null meaning not adjusted; a uuid given twice is adjusted if one row says so.
    ``renditions`` is (uuid, edited, path, width, height) of what could be made; a row without a path counts as none,
    of several of a kind the lowest path is taken. A photo that is adjusted but has only its original is flagged;
    one with neither has a null path.
    """
    kind = lambda edited: F.min(F.when(F.col("edited") == edited, F.struct("path", "width", "height")))
    made = renditions.where("path is not null").groupBy("uuid").agg(kind(True).alias("_edited"), kind(False).alias("_original"))
    known = photos.groupBy("uuid").agg(F.coalesce(F.bool_or("adjusted"), F.lit(False)).alias("_adjusted"))
    best = F.when(F.col("_adjusted") & F.col("_edited").isNotNull(), F.col("_edited")).otherwise(F.col("_original"))
    flagged = F.col("_adjusted") & F.col("_edited").isNull() & F.col("_original").isNotNull()
    one = known.join(made, "uuid", "left").withColumn("_best", best)
    return one.select("uuid", F.col("_best.path").alias("path"), F.col("_best.width").alias("width"), F.col("_best.height").alias("height"), flagged.alias("crop_not_applied"))


def plan_export(entries: DataFrame, photos: DataFrame, renditions: DataFrame, width: int, height: int) -> DataFrame:
    """(album_id, place, uuid, status, reason, crop_not_applied, path, crop) of every entry; nothing is written.

    Failed are entries whose photo is gone (``no-photo``, null uuids too), that no rendition was made of
    (``no-rendition``) or whose rendition has no size (``unreadable``); all others are ``planned``. The crop has the
    proportions of ``width`` to ``height``, from the middle where an offset is null. Repeated entries all stay.
    """
    chosen = chosen_renditions(photos, renditions).select("uuid", F.lit(True).alias("_in"), F.col("path").alias("_path"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("crop_not_applied").alias("_flag"))
    joined = entries.select("album_id", "place", "uuid", "offset_x", "offset_y").join(chosen, "uuid", "left")
    reason = F.when(F.col("_in").isNull(), "no-photo").when(F.col("_path").isNull(), "no-rendition").when(~F.coalesce((F.col("_w") > 0) & (F.col("_h") > 0), F.lit(False)), "unreadable")
    middle = lambda c: F.coalesce(F.col(c), F.lit(CENTRE))
    crop = crop_rect(F.col("_w"), F.col("_h"), width, height, middle("offset_x"), middle("offset_y"))
    row = joined.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return row.select("album_id", "place", "uuid", F.when(ok, "planned").otherwise("failed").alias("status"), "reason", F.coalesce("_flag", F.lit(False)).alias("crop_not_applied"), F.when(ok, F.col("_path")).alias("path"), F.when(ok, crop).alias("crop"))


def carry_out(plan: DataFrame, sink: Sink) -> DataFrame:
    """The plan's rows after ``sink`` got each planned photo of an album: ``exported``, or ``failed`` with what it raised. A table.

    A photo that stands in an album several times is written once, with the crop of its first place; all its entries
    share the outcome. The sink must write the same when called again, as a task that Spark repeats calls it again.
    """
    spark, types = plan.sparkSession, dict(plan.dtypes)
    plan = stage_table(plan, "export-plan")
    keys = ["album_id", "uuid"]
    todo = plan.where("status = 'planned'").groupBy(*keys).agg(F.min_by("path", "place").alias("path"), F.min_by("crop", "place").alias("crop"))

    def write(album: object, photo: object, path: str, crop: dict) -> str | None:
        try:
            sink(album, photo, path, crop)
        except Exception as e:  # noqa: BLE001  one failure must not stop the others
            return f"{type(e).__name__}: {e}"
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [write(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], names=[*keys, "error"])

    let_workers_import(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows are short but writing is not: AQE shall not merge them
    spread = todo.select(*keys, "path", "crop").repartition(tasks, *keys)
    done = stage_table(spread.mapInArrow(work, f"album_id {types['album_id']}, uuid {types['uuid']}, error string"), "export-done")
    joined = plan.join(done.withColumn("_done", F.lit(True)), keys, "left")
    tried = (F.col("status") == "planned") & F.col("_done")
    status = F.when(tried & F.col("error").isNull(), "exported").when(tried, "failed").otherwise(F.col("status"))
    return stage_table(joined.select(*keys, "place", status.alias("status"), F.coalesce("reason", "error").alias("reason"), "crop_not_applied", "path", "crop"), "exported")


def export_report(rows: DataFrame) -> DataFrame:
    """(album_id, exported, failed, crop_not_applied) for each album; rows of the same entries name them."""
    of = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("album_id").agg(of("exported").alias("exported"), of("failed").alias("failed"), F.count_if("crop_not_applied").alias("crop_not_applied"))


def exported_order(rows: DataFrame) -> DataFrame:
    """(album_id, place, uuid) of what was exported, albums and places in order: the pages of each album."""
    return rows.where("status = 'exported'").select("album_id", "place", "uuid").orderBy("album_id", "place")
