"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernsieve.plans.staging import drop_staged, stage_table

#: Nodes that a task joins among themselves before it hands out what it has.
MOST_NODES = 200_000
#: Edges, counted first, up to which one task joins all at once; more of them take rounds of stars, with ten stages each.
FEW_EDGES = 20_000


def local_stars(edges: DataFrame) -> DataFrame:
    """What the edges of a stretch of each partition join, as (node, least node): never more rows than edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars(kinds: pa.Schema) -> pa.RecordBatch:
            others = [x for x in parent if parent[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(x, kinds.field(0).type) for x in (others, [root(x) for x in others])], names=["a", "b"])

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = (root(parent.setdefault(x, x)) for x in (u, v))
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) > MOST_NODES:
                yield stars(kinds)
                parent.clear()
        if kinds is not None:
            yield stars(kinds)

    kind = dict(edges.dtypes)["a"]
    return edges.mapInArrow(work, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach.

    Returns ``(node, root)``, one row for each node that an edge joins to another; self-edges and rows with a null end
    are ignored and an empty input gives an empty result. Nodes may be of any ordered kind. Every round writes a table
    to the shared folder. The stars only ever regroup existing edges, so their number never grows, and each
    neighbourhood minimum is a partial aggregate followed by a join that adaptive execution may split; no neighbourhood
    is gathered anywhere. Before the first step, edges that lie in one partition are joined there, a bounded number of
    nodes at a time. If FEW_EDGES or fewer are left, one task joins these, and no round follows.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a.isNotNull() & b.isNotNull())
    current = stage_table(local_stars(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))), "edges")
    before = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    if not before[0]:
        return current.select(a.alias("node"), b.alias("root"))
    if before[0] <= min(FEW_EDGES, MOST_NODES // 2):
        joined = stage_table(local_stars(current.coalesce(1)), "edges")
        drop_staged(current)
        return joined.select(a.alias("node"), b.alias("root")).union(joined.select(b.alias("node"), b.alias("root")).distinct())
    first = current
    nodes = current.select(a.alias("node")).union(current.select(b.alias("node"))).distinct()
    for _ in range(max_rounds):
        both = current.union(current.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("low").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(b.alias("a"), F.col("low").alias("b")).union(joined.select(a, F.col("low").alias("b")))
        last, current = current, stage_table(small.where(a != b).distinct(), "edges")
        if last is not first:
            drop_staged(last)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
