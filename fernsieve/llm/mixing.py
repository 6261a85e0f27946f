"""Mixing sources to target weights by weighted fair queueing.

DataFrame functions only. Documents of a source are shuffled by a hash of their id and queued; the words queued so far,
divided by the source's target, are a document's virtual finish time. Copies of all sources are range-sorted by that
time and cut where their words reach the budget. Queues and the mix are summed in ranges (``running_sums``), so neither
a source with a third of all rows nor the whole mix ever lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernsieve.llm.common import n_words, running_sums, table
from fernsieve.plans.staging import sent_if_few, stage_table

#: How often a document may be taken, and so how many times its size a source's target may be.
REPEATS = 3
#: Steps of virtual time by which copies that surely lie beyond the budget are left out before the sort, for each unit and at most.
STEPS, MOST_STEPS = 64, 4096


def cycling_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add rank and weight to the distinct ``sources(source, ...)``: by code point, null last, the weights repeating."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))


def with_targets(sources: DataFrame, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """Add budget and target to ``sources(rank, weight, source_size)``: ``share`` of all words, dealt by weight.

    A target stops at ``repeats`` times its source's size and the excess is dealt again: with sources in order of cap by
    weight, those before the first whose cap is not reached are capped, and the rest share what is left.
    """
    cap = F.col("source_size") * repeats
    whole = Window.partitionBy()  # a row for each source
    placed = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    budget = F.floor(F.sum("source_size").over(whole) * F.lit(float(share)))
    shared = sources.withColumn("cap", cap).withColumn("budget", budget.cast("bigint"))
    capped = F.coalesce(F.sum("cap").over(placed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("budget") - capped).cast("double") / F.sum("weight").over(placed.rowsBetween(0, Window.unboundedFollowing))
    levelled = shared.withColumn("level", level).withColumn("open", F.col("level") < F.col("cap") / F.col("weight"))
    top = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    return levelled.withColumn("target", F.coalesce(F.least(top * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))).drop("cap", "level", "open")


def queue_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, in the shuffled queues of their sources: adds ``at``, the words queued before each.

    ``sized`` has rank, size and shuffled; documents without words queue nowhere.
    """
    queued = running_sums(sized.where("size > 0"), "rank", ["shuffled", "size"], {"upto": F.col("size")}, "queue")
    targets = sources.select("rank", F.col("source_size"), "target", "budget")
    return queued.withColumn("at", F.col("upto") - F.col("size")).drop("upto").join(sent_if_few(targets), "rank")


def schedule(queued: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Copies in the mix, with copy, finish (virtual time), place (words of the mix before it) and taken (its words).

    ``queued`` comes from ``queue_documents``. Its copies are range-sorted by (finish, rank, copy, at), a total order;
    the one that crosses the budget gives the words that are left of it, so that the mix has the budget's words exactly.
    Copies that cannot be reached are left out before the sort: the words of every sixty-fourth of virtual time say where
    the budget surely is used up.
    """
    finish = (F.col("at") + F.col("size") + F.col("copy") * F.col("source_size")).cast("double") / F.col("target")
    copies = queued.where("target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("finish", finish)
    step = F.least(F.floor(F.col("finish") * STEPS), F.lit(MOST_STEPS)).alias("step")
    steps = copies.groupBy(step).agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))  # MOST_STEPS rows at most
    past, words = MOST_STEPS, 0
    for row in sorted(steps.collect()):
        words += row["words"]
        if words >= row["budget"]:
            past = row["step"]
            break
    reachable = copies.where(F.least(F.floor(F.col("finish") * STEPS), F.lit(MOST_STEPS)) <= past).withColumn("_all", F.lit(0))
    placed = running_sums(reachable, "_all", ["finish", "rank", "copy", "at"], {"upto": F.col("size")}, "mix").drop("_all")
    place = F.col("upto") - F.col("size")
    return placed.withColumn("place", place).withColumn("taken", F.least(F.col("size"), F.col("budget") - place)).where("taken > 0").drop("upto")


def size_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", size: Column | None = None) -> DataFrame:
    """key, source, size (words) and shuffled (a hash of seed and key) of each row, staged: texts are read once and moved nowhere."""
    size = n_words(F.col(text)) if size is None else size
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return stage_table(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), shuffled.alias("shuffled")), "sized")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, repeats: int = REPEATS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """How much of each document the mix takes, and the mix itself as an ordered schedule.

    The first table has a row for each row of ``docs``: key, source, size, source_size, target, taken. The second has a
    row for each copy in the mix, by ``place``: join it to ``docs`` on the key to write the texts in that order. Null
    texts have size 0 and are not taken, nor are sources without words; a null source is a source of its own, last; null
    keys are shuffled together, and repeated rows are queued each for itself (which of them is taken is not told apart).
    An empty table gives empty results. Other columns of ``docs`` are not read, whatever their names.
    """
    sized = size_documents(docs, key, text, source, seed)
    sources = stage_table(with_targets(cycling_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), share, repeats), "sources")
    one = sent_if_few(sources.withColumnRenamed("source", "_source"))
    ranked = sized.join(one, F.col("source").eqNullSafe(F.col("_source"))).select("key", "source", "size", "shuffled", "rank", "source_size", "target")
    queued = stage_table(queue_documents(ranked.drop("source_size", "target"), sources), "queued")
    plan = stage_table(schedule(queued, repeats), "schedule")
    used = plan.groupBy("rank", "at").agg(F.sum("taken").alias("taken"))
    columns = ["key", "source", "size", "source_size", "target"]
    with_words = queued.join(used, ["rank", "at"], "left").select(*columns, F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
    without = ranked.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    return with_words.unionByName(without), plan


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of all ``documents``, sources weighing 1, 2, 3 in turn."""
    taken, _ = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS budget FROM s),
v AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (
  SELECT source, rank, source_size, budget, coalesce(least(max(level) FILTER (level < cap::DOUBLE / weight) OVER () * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM v),
q AS (
  SELECT doc_id, d.source, size, rank, source_size, budget, target, row_number() OVER () AS row_id,
         (sum(size) OVER (PARTITION BY rank ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (ahead + size + copy * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1), (2)) AS k(copy) WHERE size > 0 AND target > 0),
p AS (
  SELECT *, (sum(size) OVER (ORDER BY finish, rank, copy, ahead ROWS UNBOUNDED PRECEDING))::BIGINT - size AS place FROM c),
u AS (
  SELECT row_id, sum(greatest(0, least(size, budget - place)))::BIGINT AS taken FROM p GROUP BY row_id)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN u USING (row_id)
"""
