"""What an audit and a clustering look like outside: documents, tables, and payloads that are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsieve.functions.scalar import human_size, l2_distance
from fernsieve.operators import audit, sessions
from fernsieve.schema import WEIGHTS

#: JSON keeps what is null.
WHOLE = {"ignoreNullFields": "false"}


def audit_document(records: DataFrame, gap_seconds: float = 90.0, date: str = "date_local") -> DataFrame:
    """One row, ``document``: the whole audit as JSON; years are sorted text. Every part is an aggregate of a few rows."""

    def by(table: DataFrame, key: str, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.struct("count", "size_bytes").alias("value"))))
        return table.where(F.col(key).isNotNull()).agg(F.map_from_entries(rows).alias(name))

    runs = sessions.gap_run_count(records, gap_seconds).select(F.col("n_runs").alias("near_duplicate_runs"))
    one = audit.totals(records)
    for part in (by(audit.by_year(records, date), "year", "by_year"), by(audit.by_type(records), "type", "by_type"), by(audit.by_duration(records), "band", "by_duration"), runs):
        one = one.crossJoin(part)  # of one row each
    return one.select(F.to_json(F.struct("*"), WHOLE).alias("document"))


def audit_tables(records: DataFrame, gap_seconds: float = 90.0, date: str = "date_local") -> dict[str, DataFrame]:
    """What a console shows of an audit: four small tables of text, in their order."""
    shown = lambda df, key: df.select(F.col(key).cast("string").alias(key), "count", human_size(F.col("size_bytes")).alias("size"))
    one = audit.totals(records).crossJoin(sessions.gap_run_count(records, gap_seconds))  # of one row each
    lines = [("Total items", "items"), ("Photos", "photos"), ("Videos", "videos"), ("Total size", None), ("Favorites", "favorites"), ("Items in no album", "no_album"), ("Hidden", "hidden"), (f"Est. near-duplicate clusters (gap<{gap_seconds:g}s)", "n_runs")]
    overview = F.array(*[F.struct(F.lit(name).alias("what"), (F.col(c).cast("string") if c else human_size(F.col("size_bytes"))).alias("value")) for name, c in lines])
    return {
        "overview": one.select(F.inline(overview)),
        "by_year": shown(audit.by_year(records, date).orderBy("year"), "year"),
        "by_type": shown(audit.by_type(records), "type"),
        "by_duration": shown(audit.by_duration(records), "band"),
    }


def write_document(document: DataFrame, path: str) -> None:
    """Write a table's column ``document`` as lines of text in a folder, which is replaced."""
    document.select("document").write.mode("overwrite").text(path)


def score_photo(criteria: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """All criteria of a photo as one struct; what was not measured is null, and ``facing`` never is measured."""
    return F.struct(*[(F.lit(None) if n == "facing" else criteria.get(n, F.lit(None))).cast("double").alias(n) for n in weights])


def encode_payload(record: Column) -> Column:
    """A struct as JSON that ``decode_payload`` reads back whole."""
    return F.to_json(record, WHOLE)


def decode_payload(payload: Column, schema: str) -> Column:
    """The struct that was encoded; null for null, a text that is no such JSON raises."""
    return F.from_json(payload, schema, {"mode": "FAILFAST"})


def without_paths(members: DataFrame) -> DataFrame:
    """Members without the columns that name files of one machine."""
    return members.drop(*(c for c in members.columns if c.endswith("_path")))


def public_members(members: DataFrame, displays: DataFrame, evidence: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Members as another program may see them: no paths, but ``display`` (available, long_side) and ``evidence``, sentences in order.

    ``displays`` is (uuid, long_side), null where there is nothing to show; ``evidence`` is (cluster, uuid, place, text).
    """
    told = evidence.groupBy(cluster, "uuid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("evidence"))  # a handful for each member
    shown = displays.select("uuid", F.col("long_side").alias("_side"))
    joined = without_paths(members).join(shown, "uuid", "left").join(told, [cluster, "uuid"], "left")
    display = F.struct(F.col("_side").isNotNull().alias("available"), F.col("_side").alias("long_side"))
    return joined.withColumn("display", display).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).drop("_side")


def winner_distances(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Add distance_to_winner to ``members(cluster, uuid, winner, embedding)``; null for the winner itself.

    Null as well where either has no vector or the cluster has no winner. One row of each cluster is joined, not all pairs.
    """
    best = members.where("uuid = winner").select(cluster, F.col("embedding").alias("_best"))
    known = F.col("embedding").isNotNull() & F.col("_best").isNotNull() & (F.col("uuid") != F.col("winner"))
    distance = l2_distance(F.coalesce("embedding", "_best"), F.coalesce("_best", "embedding"))
    return members.join(best, cluster, "left").withColumn("distance_to_winner", F.when(known, distance)).drop("_best")


def nested_members(members: DataFrame, cluster: str = "cluster_id", order: str = "member_ord") -> DataFrame:
    """One row for each cluster with ``members``: its rows as structs in capture order. A cluster is a few photos of one moment."""
    rest = [c for c in members.columns if c not in (cluster, order)]
    return members.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("members"))


def cluster_documents(clusters: DataFrame, members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, document): all that ``clusters`` says of a cluster and its nested members as JSON, a row for each.

    A document for each cluster rather than one for all: any number can be written, by any number of tasks.
    """
    return clusters.join(nested_members(members, cluster), cluster).select(cluster, F.to_json(F.struct("*"), WHOLE).alias("document"))


def population(sizes: DataFrame, sampled: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row that says what a sample is a sample of: clusters, photos and culls, in all and sampled."""
    known = sizes.join(sampled.select(cluster).distinct().withColumn("_in", F.lit(True)), cluster, "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    culls = F.col("size") - 1
    return known.agg(F.count("*").alias("clusters"), F.count("_in").alias("sampled"), total(F.col("size"), "photos_in_clusters"), total(culls, "culled_photos"), total(F.when(F.col("_in"), culls), "culled_photos_sampled"))
