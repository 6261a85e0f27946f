"""A sample of clusters as one JSON document that any number of tasks write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsieve.operators import exports, sampling
from fernsieve.operators.sessions import number_runs
from fernsieve.plans.staging import stage_table
from fernsieve.schema import ClusterSettings, settings_digest, settings_document

#: Where settings come from if no file gave them: a fixed value.
BUILT_IN = "built-in defaults"


def document_lines(clusters: DataFrame, members: DataFrame, settings: ClusterSettings | None = None, source: str | None = None, limit: int | None = 200) -> DataFrame:
    """(place, line): lines that in order of place are one JSON document, a cluster in each but the first and the last.

    ``clusters`` has cluster_id, size, winner, ambiguous, diameter, median_distance, sharpness_available, dropped; ids sort
    by capture. ``members`` has cluster_id, member_ord, uuid, date, derivative_path, winner, distance_to_winner, total and a
    struct sub_scores. The document holds config (settings, their source and digest), population, strata (how many
    clusters each gives) and clusters, sampled by ``limit``, or all of them without one. No clusters give an empty list.
    """
    settings = settings or ClusterSettings()
    document = settings_document(settings, source or BUILT_IN)
    clusters = stage_table(clusters, "clusters")
    strata: dict[str, int] = {}
    if limit is None:
        sampled = clusters
    else:
        sampled = stage_table(sampling.stratified_sample(clusters, limit, "cluster_id"), "sample")
        strata = {r["stratum"]: r["count"] for r in sampled.groupBy("stratum").count().orderBy("stratum").collect()} if "stratum" in sampled.columns else {}  # sixteen at most
    counts = exports.population(clusters.select("cluster_id", "size"), sampled).first().asDict()
    head = {"config": document | {"digest": settings_digest(document)}, "population": counts, "strata": strata}
    told = members.select(
        "cluster_id", "member_ord", "uuid", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), "derivative_path", (F.col("uuid") == F.col("winner")).alias("is_winner"),
        F.when(F.col("uuid") != F.col("winner"), F.col("distance_to_winner")).alias("distance_to_winner"), "total", "sub_scores",
    )
    nested = exports.nested_members(told).withColumn("members", F.transform("members", lambda m: m.dropFields("member_ord")))
    of = sampled.select("cluster_id", "size", F.col("winner").alias("winner_uuid"), F.col("ambiguous").alias("is_ambiguous"), "diameter", "median_distance", "sharpness_available", F.col("dropped").alias("dropped_criteria"))
    rows = of.join(nested, "cluster_id").select("cluster_id", F.to_json(F.struct(*of.drop("cluster_id").columns, "members"), exports.WHOLE).alias("line"))
    placed = stage_table(number_runs(rows, ["cluster_id"], F.lit(True), ["cluster_id"], "place"), "lines")
    last = placed.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))
    body = placed.crossJoin(F.broadcast(last)).select((F.col("place") + 1).alias("place"), F.when(F.col("place") < F.col("last"), F.concat("line", F.lit(","))).otherwise(F.col("line")).alias("line"))  # one row
    opening = json.dumps(head, sort_keys=True)[:-1] + ', "clusters": ['
    ends = clusters.sparkSession.createDataFrame([(0, opening), ((1 << 62), "]}")], "place bigint, line string")
    return body.unionByName(ends)


def write_calibration(lines: DataFrame, path: str) -> None:
    """Write the lines of a document, in order, as parts of a folder, which is replaced: joined by name the parts are the JSON."""
    lines.orderBy("place").select("line").write.mode("overwrite").text(path)
