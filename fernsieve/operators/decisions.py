"""An append-only log of decisions: its state, its history, and what a new scan makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("keep", "cull", "unset")


def current_state(batches: DataFrame, undos: DataFrame) -> DataFrame:
    """The newest batch of each cluster that has not been undone; age is the id, never a time."""
    return batches.join(undos.select("batch_id").distinct(), "batch_id", "left_anti").groupBy("cluster_key").agg(F.max("batch_id").alias("batch_id"))


def history(batches: DataFrame, undos: DataFrame) -> DataFrame:
    """All batches, newest first, with whether they were undone."""
    gone = undos.select("batch_id").distinct().withColumn("undone", F.lit(True))
    return batches.join(gone, "batch_id", "left").withColumn("undone", F.coalesce("undone", F.lit(False))).orderBy(F.desc("batch_id"))


def append_batch(batches: DataFrame, path: str) -> None:
    """Logs only grow."""
    batches.write.mode("append").parquet(path)


def invalid_marks(marks: DataFrame) -> DataFrame:
    """(batch_id, photo_id, problem) of what may not be logged: no id, an unknown mark, two verdicts for one photo, a favorite that is not kept."""
    n = marks.groupBy("batch_id", "photo_id").agg(F.count("*").alias("n"), F.bool_or(~F.coalesce(F.col("mark").isin(*MARKS), F.lit(False))).alias("odd"), F.bool_or(F.col("favorite") & (F.col("mark") != "keep")).alias("fav"))
    blank = F.col("photo_id").isNull() | (F.col("photo_id").cast("string") == "")
    problem = F.array_compact(F.array(F.when(blank, "no-id"), F.when(F.col("odd"), "unknown-mark"), F.when(F.col("n") > 1, "two-verdicts"), F.when(F.col("fav"), "favorite-not-kept")))
    return n.select("batch_id", "photo_id", F.explode(problem).alias("problem"))


def member_mismatch(marks: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_key, photo_id, problem): marked photos that are no members, and members without a mark."""
    keys = ["cluster_key", "photo_id"]
    unknown = marks.select(*keys).distinct().join(members.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unknown"))
    return unknown.union(members.select(*keys).distinct().join(marks.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing")))


def dashboard(clusters: DataFrame, state_marks: DataFrame) -> DataFrame:
    """One row: clusters in all, decided and remaining, and photos by mark, undecided ones included.

    ``clusters`` is (cluster_key, size); ``state_marks`` holds the marks of decisions that stand.
    """
    decided = state_marks.select("cluster_key").distinct()
    counted = clusters.join(decided.withColumn("_d", F.lit(True)), "cluster_key", "left").agg(F.count("*").alias("clusters"), F.count("_d").alias("decided"), F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("size"))), F.lit(0)).cast("bigint").alias("undecided"))
    marks = state_marks.agg(*[F.count_if(F.col("mark") == m).alias(m) for m in MARKS])
    return counted.crossJoin(marks).select("clusters", "decided", (F.col("clusters") - F.col("decided")).alias("remaining"), *MARKS, "undecided")  # of one row each


def largest_staged(state_marks: DataFrame, order: DataFrame, n: int = 10) -> DataFrame:
    """The clusters with the most culls; equally many keep the order of capture."""
    staged = state_marks.where("mark = 'cull'").groupBy("cluster_key").agg(F.count("*").alias("staged"))
    return staged.join(order, "cluster_key").orderBy(F.desc("staged"), "ord").limit(n)


def next_undecided(order: DataFrame, state: DataFrame) -> DataFrame:
    return order.join(state.select("cluster_key"), "cluster_key", "left_anti").agg(F.min("ord").alias("next_ord"))


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 200) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` along ``order``."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("offset must be at least 0, limit between 1 and 1000")
    return rows.orderBy(*order).offset(offset).limit(limit)


def ordered_digest(lines: DataFrame, order: list[str], line: Column) -> DataFrame:
    """sha256 of all lines in order, joined by newlines: the document that a person confirms before anything is written."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")
    return lines.agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("n_rows"))


def reconcile(state_marks: DataFrame, fresh: DataFrame, library: DataFrame | None, digest: str, config: DataFrame | None = None, new_session: bool = False) -> DataFrame:
    """(cluster_key, status) of every stored decision against a fresh scan.

    superseded: made under other settings, or a new session was asked for; orphaned: no such cluster any more; requeued: a
    photo has gone from the library or was modified since; else applied. ``state_marks`` is (cluster_key,
    photo_id, mod_key), ``fresh`` the scan's (cluster_key, photo_id, mod_key), ``config`` (cluster_key, config_digest).
    Without ``library`` nothing counts as gone.
    """
    scan = fresh.select("cluster_key", "photo_id", F.coalesce("mod_key", F.lit("")).alias("_now"))
    there = fresh.select("cluster_key").distinct().withColumn("_there", F.lit(True))
    marks = state_marks.join(scan, ["cluster_key", "photo_id"], "left").withColumn("_changed", F.coalesce("mod_key", F.lit("")) != F.coalesce("_now", F.lit("")))
    if library is not None:
        marks = marks.join(library.select("photo_id").distinct().withColumn("_in", F.lit(True)), "photo_id", "left").withColumn("_gone", F.col("_in").isNull())
    else:
        marks = marks.withColumn("_gone", F.lit(False))
    judged = marks.groupBy("cluster_key").agg(F.bool_or("_gone").alias("_gone"), F.bool_or("_changed").alias("_changed")).join(there, "cluster_key", "left")
    judged = judged.join(config, "cluster_key", "left") if config is not None else judged.withColumn("config_digest", F.lit(digest))
    other = F.lit(new_session) | (F.coalesce("config_digest", F.lit("")) != digest)
    status = F.when(other, "superseded").when(F.col("_there").isNull(), "orphaned").when(F.col("_gone") | F.col("_changed"), "requeued").otherwise("applied")
    return judged.select("cluster_key", status.alias("status"))


def resume_allowed(statuses: DataFrame, new_session: bool = False) -> bool:
    """False where decisions are stored but none of them was made under the present settings."""
    row = statuses.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "superseded").alias("same")).first()
    return new_session or not row["n"] or row["same"] > 0


def voided_marks(state_marks: DataFrame, library: DataFrame) -> DataFrame:
    return state_marks.join(library.select("photo_id").distinct(), "photo_id", "left_anti").select("cluster_key", "photo_id", "mark")


def content_keys(members: DataFrame, cluster: str = "cluster_id", uuid: str = "uuid") -> DataFrame:
    """A key for each cluster that names its members: the start of the sha256 of their sorted uuids.

    A cluster is one document for a person to look through, so its members fit in a row.
    """
    lines = F.array_join(F.array_sort(F.collect_list(uuid)), "\n")
    return members.groupBy(cluster).agg(F.substring(F.sha2(lines, 256), 1, 16).alias("cluster_key"))
