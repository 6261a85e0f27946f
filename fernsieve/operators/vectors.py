"""Distances inside groups, their exact order statistics, and complete-linkage clustering, for groups of any size.

Members of a group are dealt to blocks, and pairs of blocks are cells: a task holds one cell, whatever the group. Groups
that fit a block share cells, so that many small ones cost no more than their pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernsieve.operators.components import connected_components
from fernsieve.operators.sessions import number_runs
from fernsieve.plans.staging import drop_staged, let_workers_import, sent_if_few, stage_table

#: Members of a block; a cell holds two blocks of them, and distances of one member at a time.
BLOCK = 1024
#: Members of a group that one task links with a matrix of all of them, and pairs that a task takes.
MATRIX, TASK_PAIRS = 1_000, 250_000
#: Blocks of BLOCK members on one side of a cell of clusters, clusters that a step's cut is chosen by, rows of a product of representatives, and pairs of members that are compared at once.
WIDE, SAMPLE, TILE, AT_ONCE = 16, 1024, 128, 16_384
#: Bits of a distance that each pass over the pairs settles, from the highest.
SETTLED = (24, 20, 20)


def in_cells(vectors: DataFrame, group: str, work: Callable[[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray]]], pa.Table], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """Apply ``work`` to every cell of ``vectors(group, uuid, member_ord, embedding)``.

    It gets the cell's rows and an iterator of (row, others, distances): each unordered pair of a group is in one cell,
    once. Rows with a null group or vector are in no pair; vectors of one group have one length,
    or the job fails. ``extra(group, ...)`` is joined to the rows.
    """
    let_workers_import(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # half the shuffle; cells compute in doubles
    usable = vectors.where(F.col(group).isNotNull() & F.col("embedding").isNotNull()).select(group, "uuid", F.col("member_ord").cast("bigint").alias("member_ord"), F.col("embedding").cast(kind).alias("embedding"))
    if extra is not None:
        usable = usable.join(sent_if_few(extra), group)
    sizes = stage_table(usable.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows, n_large = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > BLOCK)).first()
    shared = max(1, -(-rows // BLOCK))
    sized = usable.join(sent_if_few(sizes), group)
    small = sized.where(F.col("n") <= BLOCK).withColumns({"_x": F.lit(-1), "_y": F.pmod(F.xxhash64(group), F.lit(shared)).cast("int"), "_b": F.lit(False), "_of": F.lit(None).cast(dict(vectors.dtypes)[group])})
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = sized.where(F.col("n") > BLOCK).withColumn("_s", F.pmod(F.xxhash64("uuid"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumns({"_x": F.least("_s", "_o"), "_y": F.greatest("_s", "_o"), "_b": F.col("_s") > F.col("_o"), "_of": F.col(group)}).drop("_s", "_o")
    dealt = small.unionByName(large) if n_large else small

    def cell(rows: pa.Table) -> pa.Table:
        return work(rows, pairs_of(rows, group))

    return dealt.drop("n").groupBy("_of", "_x", "_y").applyInArrow(cell, schema)


def pairs_of(rows: pa.Table, group: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, others, distances) for the rows of a cell: within a block or small groups all pairs, else those across."""
    order, across = np.asarray(rows["member_ord"]), np.asarray(rows["_b"])
    vectors = rows["embedding"].combine_chunks()
    lengths = np.asarray(vectors.value_lengths())
    values, starts = np.asarray(vectors.flatten()).astype(np.float64), np.concatenate([[0], np.cumsum(lengths)])
    codes = np.unique(np.asarray(rows[group].to_pandas().astype(str)), return_inverse=True)[1]
    whole = bool((np.asarray(rows["_x"]) != np.asarray(rows["_y"])).all() and np.asarray(rows["_x"])[0] >= 0)
    by = np.lexsort((order, codes))
    for own in np.split(by, np.flatnonzero(np.diff(codes[by])) + 1):
        if len(set(lengths[own].tolist())) > 1:
            raise ValueError("vectors of one group differ in length")
        x = np.stack([values[starts[k] : starts[k + 1]] for k in own])
        if whole:  # a row of the first block against all of the second
            first, second = own[~across[own]], own[across[own]]
            others = x[across[own]]
            for k, row in zip(first, x[~across[own]]):
                if len(second):
                    yield k, second, np.sqrt(((others - row) ** 2).sum(axis=1))
        else:
            for at in range(len(own) - 1):
                yield own[at], own[at + 1 :], np.sqrt(((x[at + 1 :] - x[at]) ** 2).sum(axis=1))


def pair_distances(vectors: DataFrame, group: str = "bucket_id", below: float = np.inf, places: bool = False) -> DataFrame:
    """Every unordered pair of a group nearer than ``below``: group, uuid_a, uuid_b (in member_ord) and distance.

    ``places`` adds ord_a and ord_b. The pairs of a group come from many tasks.
    """

    def work(rows: pa.Table, pairs: Iterator) -> pa.Table:
        order, a, b, d = np.asarray(rows["member_ord"]), [], [], []
        for k, others, distances in pairs:
            near = distances < below
            b.append(others[near])
            a.append(np.full(near.sum(), k))
            d.append(distances[near])
        a, b, d = (np.concatenate(c) if c else np.array([], kind) for c, kind in ((a, np.int64), (b, np.int64), (d, np.float64)))
        a, b = np.where(order[a] <= order[b], a, b), np.where(order[a] <= order[b], b, a)
        at = lambda c, k: rows[c].combine_chunks().take(pa.array(k))
        return pa.table({group: at(group, a), "uuid_a": at("uuid", a), "uuid_b": at("uuid", b), "distance": d} | ({"ord_a": order[a], "ord_b": order[b]} if places else {}))

    kinds = dict(vectors.dtypes)
    return in_cells(vectors, group, work, f"{group} {kinds[group]}, uuid_a {kinds['uuid']}, uuid_b {kinds['uuid']}, distance double" + (", ord_a bigint, ord_b bigint" if places else ""))


def farthest_pairs(vectors: DataFrame, group: str = "bucket_id") -> DataFrame:
    """group, uuid_a, uuid_b and distance of a farthest pair of each group of two vectors or more; a cell hands on one row for each of its groups."""

    def work(rows: pa.Table, pairs: Iterator) -> pa.Table:
        codes = np.unique(np.asarray(rows[group].to_pandas().astype(str)), return_inverse=True)[1]
        best: dict[int, tuple] = {}
        for k, others, distances in pairs:
            at = int(distances.argmax())
            if distances[at] > best.get(int(codes[k]), (-1.0,))[0]:
                best[int(codes[k])] = (float(distances[at]), int(k), int(others[at]))
        d, a, b = zip(*best.values()) if best else ((), (), ())
        at = lambda c, k: rows[c].combine_chunks().take(pa.array(k, pa.int64()))
        return pa.table({group: at(group, a), "uuid_a": at("uuid", a), "uuid_b": at("uuid", b), "distance": pa.array(d, pa.float64())})

    kinds = dict(vectors.dtypes)
    found = in_cells(vectors, group, work, f"{group} {kinds[group]}, uuid_a {kinds['uuid']}, uuid_b {kinds['uuid']}, distance double")
    return found.groupBy(group).agg(F.max_by(F.struct("uuid_a", "uuid_b"), "distance").alias("pair"), F.max("distance").alias("distance")).select(group, "pair.*", "distance")


def pair_statistics(vectors: DataFrame, group: str = "bucket_id") -> DataFrame:
    """pairs, diameter (largest distance) and median of each group of two or more vectors, exactly.

    No distances are kept: their bits order as they do, so a pass over the pairs counts them by their highest 24 bits, and
    two more settle 20 bits each of the one or two values in the middle. A group costs three passes over its pairs.
    """
    kinds = dict(vectors.dtypes)
    if vectors.isEmpty():
        return vectors.sparkSession.createDataFrame([], f"{group} {kinds[group]}, pairs bigint, diameter double, median double")
    wanted, totals, shift = None, None, 64
    for bits in SETTLED:
        shift -= bits
        counts = stage_table(in_cells(vectors, group, bit_counts(group, shift, bits), f"{group} {kinds[group]}, parent bigint, bin bigint, n bigint, most double", wanted and wanted.groupBy(group).agg(F.collect_set("parent").alias("parents"))), "bits")
        counts = counts.groupBy(group, "parent", "bin").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        if totals is None:
            counts = stage_table(counts, "bins")
            totals = stage_table(counts.groupBy(group).agg(F.sum("n").alias("pairs"), F.max("most").alias("diameter")), "totals")
            ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2))))
            wanted = totals.select(group, ranks.alias("rank"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("below"))
        upto = Window.partitionBy(group, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = wanted.join(counts.drop("most"), [group, "parent"]).withColumn("upto", F.col("below") + F.sum("n").over(upto)).where("upto > rank")
        first = placed.groupBy(group, "rank").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("below")), "bin").alias("at"))
        wanted = stage_table(first.select(group, "rank", F.col("at.bin").alias("parent"), F.col("at.below").alias("below")), "ranks")

    def as_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(b.column(1)).view(np.float64))], names=[group, "value"])

    values = wanted.select(group, "parent").mapInArrow(as_distance, f"{group} {kinds[group]}, value double")
    middle = values.groupBy(group).agg(F.avg("value").alias("median"))  # of one value or two
    return totals.join(middle, group).select(group, "pairs", "diameter", "median")


def bit_counts(group: str, shift: int, bits: int) -> Callable[[pa.Table, Iterator], pa.Table]:
    """Counts of a cell's distances by their bits from ``shift`` up, of those whose bits further up are a parent of the group."""

    def work(rows: pa.Table, pairs: Iterator) -> pa.Table:
        names, parents = rows[group].combine_chunks(), rows["parents"].to_pylist() if "parents" in rows.column_names else None
        codes = np.unique(np.asarray(names.to_pandas().astype(str)), return_inverse=True)[1]
        seen: dict[int, list] = {}  # a block's square of distances at most
        for k, _, distances in pairs:
            seen.setdefault(int(codes[k]), []).append((int(k), distances))
        out = []
        for lists in seen.values():
            k, distances = lists[0][0], np.concatenate([d for _, d in lists])
            at = distances.view(np.int64) >> shift
            above = at >> bits if parents else None
            for parent in parents[k] if parents else (0,):
                bins, n = np.unique(at[above == parent] if parents else at, return_counts=True)
                out += [(k, parent, b, c, 0.0) for b, c in zip(bins.tolist(), n.tolist())]
            if not parents:
                out[-1] = (*out[-1][:4], float(distances.max()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        of, parent, bins, n, most = (pa.array(c, t) for c, t in zip(columns, kinds))
        return pa.table({group: names.take(of), "parent": parent, "bin": bins, "n": n, "most": most})

    return work


def complete_linkage(uuids: list[str], distances: np.ndarray, cut: float) -> list[list[int]]:
    """Clusters of two or more members, by place: the closest pair of clusters merges while it is closer than ``cut``.

    A cluster's distance from another is that of their farthest members. Equal distances are settled by the pair of
    the clusters' earliest members' uuids, sorted. Each cluster remembers its nearest other one, so that a merge
    costs one pass over those and the rows that pointed to what has gone.
    """
    n = len(uuids)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.array(uuids, object), kind="stable")] = np.arange(n)
    alive = np.ones(n, bool)
    members = {i: [i] for i in range(n)}

    def nearest(i: int) -> tuple[float, int, int, int]:
        low = d[i].min()
        others = np.flatnonzero(d[i] == low)
        j = min(others, key=lambda k: (min(rank[i], rank[k]), max(rank[i], rank[k])))
        return (low, min(rank[i], rank[j]), max(rank[i], rank[j]), int(j))

    near = {i: nearest(i) for i in range(n)} if n > 1 else {}
    while near:
        i = min(near, key=lambda k: near[k][:3])
        low, _, _, j = near[i]
        if not low < cut:
            break
        i, j = min(i, j), max(i, j)  # the earlier member names the cluster
        members[i] += members.pop(j)
        row = np.maximum(d[i], d[j])
        row[[i, j]] = np.inf
        d[i] = row
        d[:, i] = row
        d[j] = np.inf
        d[:, j] = np.inf
        alive[j] = False
        del near[j]
        if alive.sum() < 2:
            break
        for k in list(near):
            if k == i or near[k][3] in (i, j):
                near[k] = nearest(k)
    return sorted((sorted(m) for m in members.values() if len(m) > 1), key=lambda m: m[0])


def linked_pairs(rank: list[int], a: list[int], b: list[int], distances: list[float]) -> list[int]:
    """For each place the place of its cluster, as ``complete_linkage`` merges, from all pairs (a < b) under the cut alone.

    What is not among the pairs is too far. A merged cluster is near what both parts were near, at the farther distance.
    """
    near: list[dict[int, float]] = [{} for _ in rank]
    queue = []
    for i, j, d in zip(a, b, distances):
        near[i][j] = near[j][i] = d
        queue.append((d, min(rank[i], rank[j]), max(rank[i], rank[j]), i, j))
    heapq.heapify(queue)
    label = list(range(len(rank)))
    while queue:
        d, _, _, i, j = heapq.heappop(queue)
        if near[i].get(j) != d:  # one is gone, or they have moved apart
            continue
        label[j], mine, others, both = i, near[i], near[j], {}
        near[j] = {}
        for k, far in mine.items():
            if k == j:
                continue
            other = others.get(k)
            if other is None:
                del near[k][i]
                continue
            if other > far:
                far = near[k][i] = other
                heapq.heappush(queue, (far, min(rank[i], rank[k]), max(rank[i], rank[k]), min(i, k), max(i, k)))
            both[k] = far
        for k in others:
            if k != i:
                del near[k][j]
        near[i] = both
    for k in range(len(label)):  # a cluster has the place of its earliest member
        label[k] = label[label[k]]
    return label


def linked_in_tasks(pairs: DataFrame) -> DataFrame:
    """(gone, keep, ord) for each cluster of ``pairs(root, a, b, ...)`` that is merged into an earlier one; a root has few pairs."""
    chunks = max(1, -(-pairs.count() // TASK_PAIRS))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("root"):
            names = pd.concat([part[["ord_a", "a"]].set_axis(["o", "i"], axis=1), part[["ord_b", "b"]].set_axis(["o", "i"], axis=1)]).drop_duplicates("i").sort_values("o").reset_index(drop=True)
            place, names, orders = {i: k for k, i in enumerate(names["i"])}, names["i"].tolist(), names["o"].tolist()
            rank = {i: k for k, i in enumerate(sorted(names))}
            x, y = part["a"].map(place).to_numpy(), part["b"].map(place).to_numpy()
            label = linked_pairs([rank[i] for i in names], np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), part["distance"].tolist())
            out += [(names[k], names[i], orders[i]) for k, i in enumerate(label) if i != k]
        return pd.DataFrame(out, columns=["gone", "keep", "ord"])

    return pairs.withColumn("_chunk", F.pmod(F.xxhash64("root"), F.lit(chunks * 4))).groupBy("_chunk").applyInPandas(work, "gone string, keep string, ord bigint")


def merged_once(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge all pairs of clusters that are each other's nearest: (gone, keep, ord), and the pairs of what there is then. Tables.

    Complete linkage is reducible, with ties too: a cluster that is nearest to neither of two cannot, merged with another,
    come nearer than they are to each other. So these merges are among those that going from the closest pair upwards
    makes. A merged cluster is near another only if all their parts were, at the farthest of the distances.
    """
    key = F.struct("distance", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    ends = pairs.select(F.col("a").alias("x"), key.alias("key"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("x"), key.alias("key"), F.col("a").alias("other")))
    best = stage_table(ends.groupBy("x").agg(F.min_by("other", "key").alias("other")), "nearest")
    mutual = best.alias("p").join(best.alias("q"), (F.col("p.x") == F.col("q.other")) & (F.col("p.other") == F.col("q.x"))).select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))
    merges = stage_table(pairs.join(mutual, ["a", "b"]).select(F.col("b").alias("gone"), F.col("a").alias("keep"), F.col("ord_a").alias("ord")), "merges")
    moved = stage_table(merges.select(F.col("gone").alias("old"), F.col("keep").alias("new"), F.col("ord").alias("o")).unionByName(merges.select(F.col("keep").alias("old"), F.col("keep").alias("new"), F.col("ord").alias("o"))), "moved")
    sent, named = sent_if_few(moved), pairs
    for side in ("a", "b"):
        one = sent.select(F.col("old").alias(side), F.col("new").alias("_n"), F.col("o").alias("_o"))
        named = named.join(one, side, "left").withColumns({f"w_{side}": F.when(F.col("_n").isNull(), 1).otherwise(2), f"ord_{side}": F.coalesce("_o", f"ord_{side}"), side: F.coalesce("_n", side)}).drop("_n", "_o")
    turned = F.col("ord_a") > F.col("ord_b")
    part = lambda c, first: F.when(turned if first else ~turned, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(f"{c}{'a' if first else 'b'}")
    named = named.where("a <> b").select("of", *[part(c, first) for c in ("", "ord_") for first in (True, False)], "distance", (F.col("w_a") * F.col("w_b")).alias("need"))
    kept = named.groupBy("of", "a", "b", "ord_a", "ord_b").agg(F.max("distance").alias("distance"), F.count("*").alias("have"), F.max("need").alias("need")).where("have = need")
    kept = stage_table(kept.drop("have", "need"), "pairs")
    drop_staged(best, moved)
    return merges, kept


def merged_all(pairs: DataFrame) -> DataFrame:
    """(node, label, ord) of all that is in ``pairs(of, a, b, ord_a, ord_b, distance)``, a table, which is dropped.

    ``label`` is the earliest of a node's cluster, with its place, once all pairs that stay near are merged. A group of
    MATRIX * MATRIX / 2 pairs at most is linked in one task. Clusters lie within the components of the graph of near pairs,
    so a group of more of them is taken apart; of components of more all mutually nearest clusters merge at once, by joins, until what is left
    falls into small ones. Of the tables of pairs only the last stays, and the next while it is written.
    """
    most = MATRIX * MATRIX // 2
    every = stage_table(pairs.select(F.col("a").alias("node"), F.col("ord_a").alias("ord")).unionByName(pairs.select(F.col("b").alias("node"), F.col("ord_b").alias("ord"))).distinct().select("node", F.col("node").alias("label"), "ord"), "labels")
    left, split_from, held = pairs.count(), None, pairs
    while left:
        before = held
        if split_from is None or left * 2 <= split_from:  # looked for again once half of the pairs are gone
            split_from = left
            rooted = pairs.withColumn("root", F.col("of"))
            large = stage_table(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root"), "large")
            if not large.isEmpty():
                roots = stage_table(connected_components(rooted.join(sent_if_few(large), "root", "left_semi").select("a", "b")), "roots")
                held = stage_table(pairs.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "of")), "parted")
                drop_staged(roots, before, large)
                rooted, large = held, stage_table(held.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root"), "large")
            sent = sent_if_few(large)
            merges, pairs = stage_table(linked_in_tasks(rooted.join(sent, "root", "left_anti")), "merged"), rooted.join(sent, "root", "left_semi").drop("root")
        else:
            merges, held = merged_once(pairs)
            drop_staged(before)
            pairs = held
        done = sent_if_few(merges.select(F.col("gone").alias("label"), "keep", F.col("ord").alias("_o")))
        last, every = every, stage_table(every.join(done, "label", "left").select("node", F.coalesce("keep", "label").alias("label"), F.coalesce("_o", "ord").alias("ord")), "labels")
        drop_staged(last, merges)
        left = pairs.count()
    drop_staged(held)
    return every


def linked_by_steps(clusters: DataFrame, cut: float) -> DataFrame:
    """``clusters(of, node, label, ord, embedding)``, each node its own cluster, with the labels that complete linkage gives. A table.

    Merging goes from the closest pair upwards, so to merge up to a lower cut first and go on from there with a higher one
    is to do the same merges. Each step takes the cut that leaves about TASK_PAIRS pairs of clusters (four for each cluster, if
    those are more) under it, finds all of these, by comparing all clusters, and merges them; the next has fewer clusters, that are
    farther apart. So the near pairs of all vectors, whose number grows with the square of a group, are never there at once.
    The cut is chosen by a sample of the clusters; the clusters that come out do not depend on it.
    """
    clusters = stage_table(clusters, "clusters")
    going = clusters
    while True:
        cuts = stage_table(next_cuts(going, cut), "cuts")
        sent = sent_if_few(cuts)
        near = stage_table(cluster_pairs(going.join(sent, "of"), cut), "near")
        labels = merged_all(near)
        moved = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("_l"), F.col("ord").alias("_o"))
        last, clusters = clusters, stage_table(clusters.join(sent_if_few(moved), "label", "left").select("of", "node", F.coalesce("_l", "label").alias("label"), F.coalesce("_o", "ord").alias("ord"), "embedding"), "clusters")
        drop_staged(last, labels)
        rest = cuts.where(F.col("upto") < float("inf")).select("of")
        if rest.isEmpty():
            return clusters
        going = clusters.join(sent_if_few(rest), "of", "left_semi")


def next_cuts(clusters: DataFrame, cut: float) -> DataFrame:
    """(of, upto) for each group: the distance up to which there are about as many pairs of clusters as a step takes; infinite if those under the cut are no more.

    It is a distance of two of the sampled clusters, so the next step merges at least one pair.
    """
    counts = clusters.groupBy("of").agg(F.count_if(F.col("node") == F.col("label")).alias("n"))
    counts = stage_table(counts.withColumn("every", F.ceil(F.col("n") / SAMPLE)), "counts")
    sampled = clusters.join(sent_if_few(counts), "of").where(F.pmod(F.xxhash64("label"), F.col("every")) == 0)
    found = sampled.groupBy("of").agg(F.count_if(F.col("node") == F.col("label")).alias("s"))
    share = F.pow(F.col("s") / F.col("n"), 2)
    wanted = counts.join(found, "of").select("of", F.greatest(F.lit(1), F.floor(F.greatest(F.lit(TASK_PAIRS), 4 * F.col("n")) * share)).alias("rank"))
    pairs = cluster_pairs(sampled.select("of", "node", "label", "ord", "embedding", F.lit(float("inf")).alias("upto")), cut)
    ranked = pairs.select("of", "distance", F.row_number().over(Window.partitionBy("of").orderBy("distance")).alias("rank"))
    # one pair more than that has to be there, or the step takes all
    reached = ranked.join(wanted.select("of", F.col("rank").alias("wanted")), "of").where("rank in (wanted, wanted + 1)").groupBy("of").agg(F.min("distance").alias("upto"), F.count("*").alias("both")).where("both = 2")
    return counts.select("of").join(reached.select("of", "upto"), "of", "left").select("of", F.coalesce("upto", F.lit(float("inf"))).alias("upto"))


def cluster_pairs(clusters: DataFrame, cut: float) -> DataFrame:
    """All pairs of clusters of a group that are nearer than ``cut`` and no farther than ``upto``, by their farthest members.

    ``clusters(of, node, label, ord, embedding, upto)`` has a row for each member. Clusters are dealt to blocks and those to cells, as in
    ``in_cells``, by parts of about BLOCK members: clusters of several parts are near if all of these are.
    """
    let_workers_import(clusters.sparkSession)
    counts = stage_table(clusters.groupBy("of").agg(F.count("*").alias("n")), "sizes")
    blocks = F.greatest(F.ceil(F.col("n") / (WIDE * BLOCK)), F.least(F.lit(4), F.ceil(F.col("n") / BLOCK))).cast("int")
    parted = stage_table(clusters.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("label", F.ceil(F.col("n") / BLOCK).alias("parts")), "parts")
    of_parts = not parted.isEmpty()
    dealt = clusters.join(sent_if_few(parted), "label", "left") if of_parts else clusters.withColumn("parts", F.lit(1).cast("bigint"))
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint"))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.join(sent_if_few(counts.select("of", blocks.alias("_n"))), "of").withColumn("_s", F.pmod(F.xxhash64("label", "part"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("of", "label", "ord", "parts", "part", "embedding", "upto", F.least("_s", "_o").alias("_x"), F.greatest("_s", "_o").alias("_y"), (F.col("_s") > F.col("_o")).alias("_b"))

    def work(rows: pa.Table) -> pa.Table:
        return near_parts(rows, cut)

    pairs = dealt.groupBy("of", "_x", "_y").applyInArrow(work, "of string, a string, b string, ord_a bigint, ord_b bigint, distance double, need bigint")
    if of_parts:
        pairs = pairs.groupBy("of", "a", "b", "ord_a", "ord_b").agg(F.max("distance").alias("distance"), F.count("*").alias("_have"), F.max("need").alias("need")).where("_have = need")
    return pairs.drop("_have", "need")


def near_parts(rows: pa.Table, cut: float) -> pa.Table:
    """The pairs of a cell's parts of clusters of which all members are nearer than ``cut`` and no farther than ``upto``.

    Products of one member of each part leave out nearly all pairs; a bound on what such a product can be wrong by is
    added, and the distances of what is left are those of ``pairs_of``, to the last bit.
    """
    vectors = rows["embedding"].combine_chunks()
    lengths = np.asarray(vectors.value_lengths())
    if lengths.min() != lengths.max():
        raise ValueError("vectors of one group differ in length")
    x = np.asarray(vectors.flatten()).astype(np.float64).reshape(len(lengths), -1)
    names = rows["label"].combine_chunks().dictionary_encode()
    code, part, across = np.asarray(names.indices), np.asarray(rows["part"]), np.asarray(rows["_b"])
    by = np.lexsort((part, code, across))
    by = by[np.isfinite(x[by]).all(axis=1)]  # others are near nothing
    x, code, part, across, order, parts = x[by], code[by], part[by], across[by], np.asarray(rows["ord"])[by], np.asarray(rows["parts"])[by]
    upto, two = float(rows["upto"][0].as_py()), rows["_x"][0].as_py() != rows["_y"][0].as_py()
    start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (across[1:] != across[:-1])])[: len(x)])
    size = np.diff(np.append(start, len(x)))
    found: list[tuple[np.ndarray, ...]] = []
    with np.errstate(all="ignore"):
        y = x - x.mean(axis=0) if len(x) else x
        top, limit = float((y * y).sum(axis=1).max()) if len(x) else 0.0, min(cut, upto) ** 2
        slack = lambda kind: 8 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * top
        kind = np.float32 if slack(np.float32) < 0.02 * limit and top < 1e30 else np.float64
        limit, y = limit + slack(kind), y.astype(kind)
        norm = (y * y).sum(axis=1)
        of = np.repeat(np.arange(len(start)), size)
        away = ((y - y[start[of]]) ** 2).sum(axis=1)
        far = np.lexsort((away, of))[start + size - 1] if len(x) else start  # of each part, the member farthest from its first
        one = np.ones((len(start), 1), kind)
        left, right = np.hstack([-2 * y[start], norm[start, None], one]), np.hstack([y[start], one, norm[start, None]])
        split = int((~across[start]).sum()) if two else 0  # parts of the first block come first
        for at in range(0, split if two else len(start), TILE):
            end, low = min(at + TILE, split if two else len(start)), split if two else at
            i, j = np.nonzero(~(left[at:end] @ right[low:].T > limit))
            i, j = i + at, j + low
            keep = (j > i) & (code[start[i]] != code[start[j]])
            i, j = i[keep], j[keep]
            for p, q in ((far, start), (start, far), (far, far)):
                again = np.flatnonzero((size[i] > 1) | (size[j] > 1))
                drop = [k[((y[p[i[k]]] - y[q[j[k]]]) ** 2).sum(axis=1) > limit] for k in np.split(again, range(AT_ONCE, len(again), AT_ONCE))]
                keep = np.ones(len(i), bool)
                keep[np.concatenate(drop)] = False
                i, j = i[keep], j[keep]
            distance = farthest_members(x, start, size, i, j, min(cut, upto))
            near = (distance < cut) & (distance <= upto)
            found.append((i[near], j[near], distance[near]))
    i, j, distance = (np.concatenate(c) if c else np.array([], k) for c, k in zip(list(zip(*found)) or [()] * 3, (np.int64, np.int64, np.float64)))
    i, j = start[i], start[j]
    i, j = np.where(order[i] <= order[j], i, j), np.where(order[i] <= order[j], j, i)
    label = lambda k: names.dictionary.take(pa.array(code[k], pa.int64()))
    group = pa.array([rows["of"][0].as_py()] * len(i), pa.string())
    return pa.table({"of": group, "a": label(i), "b": label(j), "ord_a": order[i], "ord_b": order[j], "distance": distance, "need": parts[i] * parts[j]})


def farthest_members(x: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, enough: float) -> np.ndarray:
    """Largest distance of a member of part i from one of part j, for each pair of (i, j); of large parts, the first over ``enough``."""
    out, pairs = np.empty(len(i)), size[i] * size[j]
    for k in np.flatnonzero(pairs > AT_ONCE):
        others, most = x[start[j[k]] : start[j[k]] + size[j[k]]], 0.0
        for row in x[start[i[k]] : start[i[k]] + size[i[k]]]:
            most = max(most, float(np.sqrt(((others - row) ** 2).sum(axis=1)).max()))
            if most > enough:
                break
        out[k] = most
    few = np.flatnonzero(pairs <= AT_ONCE)
    ends = np.cumsum(pairs[few])
    at = 0
    while at < len(few):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own, n = few[at:end], pairs[few[at:end]]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        k = np.repeat(own, n)
        place = np.arange(len(k)) - np.repeat(first, n)
        a, b = start[i[k]] + place // size[j[k]], start[j[k]] + place % size[j[k]]
        out[own] = np.maximum.reduceat(np.sqrt(((x[b] - x[a]) ** 2).sum(axis=1)), first)
        at = end
    return out


def linkage_clusters(vectors: DataFrame, cut: float, group: str = "bucket_id") -> DataFrame:
    """Complete linkage of each group's vectors; rows are (group, cluster_ord, member_ord, uuid) of clusters of two or more.

    The closest pair of clusters merges while nearer than ``cut``, as in ``complete_linkage``. Groups of MATRIX members at
    most are linked by the matrix, many of them in a task. Larger ones are taken apart first (``linked_apart``), so that
    what a task holds is bounded; of equal vectors there only one is compared. Uuids are distinct in a group, null vectors and rows of a null group are in no cluster,
    and an empty table gives an empty result.
    """
    usable = vectors.where(F.col(group).isNotNull() & F.col("embedding").isNotNull()).select(group, "uuid", "member_ord", "embedding")
    large = stage_table(usable.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > MATRIX).select(group), "large")
    if large.isEmpty():
        return linked_whole(usable, cut, group)
    sent = sent_if_few(large)
    apart = linked_apart(usable.join(sent, group, "left_semi"), cut, group)
    return linked_whole(usable.join(sent, group, "left_anti"), cut, group).unionByName(apart)


def linked_whole(vectors: DataFrame, cut: float, group: str) -> DataFrame:
    """Complete linkage by the matrices of small groups; a cell holds many of them."""

    def work(rows: pa.Table, pairs: Iterator) -> pa.Table:
        names, order, uuids = rows[group].combine_chunks(), np.asarray(rows["member_ord"]), rows["uuid"].to_pylist()
        codes = np.unique(np.asarray(names.to_pandas().astype(str)), return_inverse=True)[1]
        by = np.lexsort((order, codes))
        of = np.split(by, np.flatnonzero(np.diff(codes[by])) + 1)
        place = np.empty(len(by), np.int64)
        matrix = {}
        for own in of:
            place[own] = np.arange(len(own))
            matrix[int(codes[own[0]])] = np.zeros((len(own), len(own)))
        for k, others, distances in pairs:
            d = matrix[int(codes[k])]
            d[place[k], place[others]] = d[place[others], place[k]] = distances
        out = [(int(own[i]), c, k) for own in of for c, m in enumerate(complete_linkage([uuids[i] for i in own], matrix[int(codes[own[0]])], cut)) for k, i in enumerate(m)]
        at, cluster, member = zip(*out) if out else ((), (), ())
        take = pa.array(at, pa.int64())
        return pa.table({group: names.take(take), "cluster_ord": pa.array(cluster, pa.int32()), "member_ord": pa.array(member, pa.int32()), "uuid": rows["uuid"].combine_chunks().take(take)})

    kinds = dict(vectors.dtypes)
    return in_cells(vectors, group, work, f"{group} {kinds[group]}, cluster_ord int, member_ord int, uuid {kinds['uuid']}")


def with_first_copy(vectors: DataFrame, cut: float, group: str) -> DataFrame:
    """Each of ``vectors(group, uuid, member_ord, embedding)`` and first, the (member_ord, uuid) of its earliest equal one. A table.

    Equal vectors are 0 apart, so complete linkage merges them before all else if 0 is under the cut, and their cluster
    is as far from others as each of them, by the name of the earliest. Those that are not finite are near nothing,
    not even their equals.
    """
    values = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")  # half the shuffle; floats are equal as doubles are
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keyed = vectors.withColumns({"_e": values, "_own": F.when(odd if cut > 0 else F.lit(True), F.col("uuid"))})
    firsts = keyed.groupBy(group, "_e", "_own").agg(F.min(F.struct("member_ord", "uuid")).alias("first"))
    same = keyed.alias("v").join(firsts.alias("f"), (F.col(f"v.{group}") == F.col(f"f.{group}")) & (F.col("v._e") == F.col("f._e")) & F.col("v._own").eqNullSafe(F.col("f._own")))
    return stage_table(same.select(*[F.col(f"v.{c}") for c in (group, "uuid", "member_ord", "embedding")], "first"), "copies")


def linked_apart(vectors: DataFrame, cut: float, group: str) -> DataFrame:
    """Complete linkage of groups of any size, of which no task holds one.

    Of equal vectors the earliest stands for all. Groups that have TASK_PAIRS pairs at most then are linked by all of their
    near pairs, others in steps of a growing cut (``linked_by_steps``), whose pairs are few at a time. Names of one
    group's members order as their uuids do.
    """
    name = lambda u: F.concat(F.col(group).cast("string"), F.lit("\x01"), F.col(u).cast("string"))
    copies = with_first_copy(vectors, cut, group)
    distinct = copies.where(F.col("uuid") == F.col("first.uuid")).drop("first")
    pairs_of_all = F.count("*") * (F.count("*") - 1) / 2
    many = stage_table(distinct.groupBy(group).agg((pairs_of_all > TASK_PAIRS).alias("many")), "many")
    n_many, n = many.agg(F.count_if("many"), F.count("*")).first()
    every = []
    if n_many < n:
        few = distinct.join(sent_if_few(many.where("not many").select(group)), group, "left_semi")
        near = pair_distances(few, group, cut, places=True).select(F.col(group).cast("string").alias("of"), name("uuid_a").alias("a"), name("uuid_b").alias("b"), "ord_a", "ord_b", "distance")
        every.append(merged_all(stage_table(near, "near")).select("node", "label"))
    if n_many:
        clusters = distinct.join(sent_if_few(many.where("many").select(group)), group, "left_semi").withColumns({"node": name("uuid"), "ord": F.col("member_ord").cast("bigint"), "of": F.col(group).cast("string")})
        every.append(linked_by_steps(clusters.select("of", "node", F.col("node").alias("label"), "ord", "embedding"), cut).select("node", "label"))
    every = every[0] if len(every) == 1 else every[0].unionByName(every[1])
    members = copies.select(group, "uuid", "member_ord", name("first.uuid").alias("node")).join(every, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = members.groupBy("label").agg(F.min("member_ord").alias("_first"), F.count("*").alias("_size")).where("_size > 1")
    placed = stage_table(members.join(firsts, "label").select(group, "uuid", "member_ord", "_first"), "members")
    rows = number_runs(placed, [group, "_first", "member_ord"], F.lit(True), ["member_ord"], "_row")
    clusters = number_runs(placed.where("member_ord = _first").select(group, "_first"), [group, "_first"], F.lit(True), ["_first"], "_cluster")
    starts = clusters.groupBy(group).agg(F.min("_cluster").alias("_low"))
    first_row = rows.where("member_ord = _first").select(group, "_first", F.col("_row").alias("_at"))
    numbered = rows.join(first_row, [group, "_first"]).join(clusters, [group, "_first"]).join(starts, group)
    return numbered.select(group, (F.col("_cluster") - F.col("_low")).cast("int").alias("cluster_ord"), (F.col("_row") - F.col("_at")).cast("int").alias("member_ord"), "uuid")
