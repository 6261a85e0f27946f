"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits agree, in at least one part of the bits, up to that part's own
threshold, if the thresholds plus one sum to radius + 1. Correlated bits share a part. Each fingerprint gets its own
thresholds: dynamic programming picks those with the fewest estimated candidates, from counts of all fingerprints. It
probes the other fingerprints in every part within its threshold, and candidates are verified on all 64 bits.

Only distinct fingerprints are compared, and a part's value that many of them share is worked through in cells of
bounded size that give the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import bytes_of, map_batches, table, work_begins
from fernsieve.operators.components import connected_components
from fernsieve.plans.staging import stage_table

SHINGLE, SEED, RADIUS = 3, 42, 3
GROUPS, WIDTH = 4, 16
#: Beyond so many distinct fingerprints two groups make one part: wider values keep the lists of equal ones short.
WIDE_FROM = 1 << 21
#: Fingerprints of one value of a part, from which on it is worked through in cells, and of one side of a cell.
HOT, CELL = 16, 2048
PROBE_COST = 1.0


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if over half of the hashes of word shingles have it; no words: zero."""
    words = data.lower().split()  # of bytes: lower case of A-Z alone, six white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(64, np.int64), partial(xxhash.xxh64_intdigest, seed=seed)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(digest, grams), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``key`` and fp, the fingerprint as a signed long, of each row."""

    def work(cols: dict[str, list]) -> dict[str, list]:
        work_begins("simhash")
        got = np.array([fingerprint(bytes_of(t), shingle, seed) for t in cols["text"]], np.uint64)
        return {key: cols[key], "fp": got.view(np.int64).tolist()}

    return map_batches(docs.select(key, "text"), work, f"{key} {dict(docs.dtypes)[key]}, fp bigint")


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """GROUPS groups of WIDTH bits; each grows by the bit that correlates most with what it holds."""
    p = np.diag(both) / max(1, n)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(r, 0)
    free, groups = set(range(64)), []
    while free:
        group = [max(free, key=lambda b: (r[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < WIDTH:
            group.append(max(free, key=lambda b: (r[b, group].sum(), -b)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def values_of(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(fingerprint, group) -> the WIDTH bits of the group."""
    b = bits_of(fp)
    return np.stack([b[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], axis=1) if len(fp) else np.zeros((0, len(groups)), np.int64)


def masks(width: int, most: int) -> list[np.ndarray]:
    """For each distance up to ``most`` the values of ``width`` bits with so many set."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)] or [0], np.int64) for d in range(most + 1)]


class Allocation:
    """Thresholds of a fingerprint's parts, from counts of all fingerprints by value of each group."""

    def __init__(self, counts: np.ndarray, groups: list[list[int]], n: int, radius: int) -> None:
        self.groups, self.radius, self.n = groups, radius, n
        self.merge = 2 if n > WIDE_FROM else 1
        self.parts = GROUPS // self.merge
        flips = masks(WIDTH, radius)
        index = np.arange(1 << WIDTH)
        # rings[d, g, v]: fingerprints whose value of group g lies d bits from v
        self.rings = np.zeros((radius + 1, GROUPS, 1 << WIDTH), np.float32)
        for d in range(radius + 1):
            for m in flips[d]:
                self.rings[d] += counts[:, index ^ m]

    def estimates(self, values: np.ndarray) -> np.ndarray:
        """(fingerprint, part, threshold + 1) -> estimated candidates and the cost of probing; threshold -1: nothing."""
        r = np.stack([self.rings[:, g, values[:, g]] for g in range(GROUPS)])  # group, distance, fingerprint
        if self.merge == 2:  # for the estimate the two groups of a part are taken as independent
            r = np.stack([np.stack([sum(r[2 * p, a] * r[2 * p + 1, d - a] for a in range(d + 1)) for d in range(self.radius + 1)]) for p in range(self.parts)]) / max(1, self.n)
        probes = np.cumsum([len(m) for m in masks(WIDTH * self.merge, self.radius)])
        cost = np.cumsum(r, axis=1) + PROBE_COST * probes[None, :, None]
        return np.concatenate([np.zeros((self.parts, 1, values.shape[0])), cost], axis=1).transpose(2, 0, 1)

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """(fingerprint, part) -> threshold; those of a fingerprint, plus one each, sum to radius + 1."""
        cost, goal = self.estimates(values), self.radius + 1
        n = len(values)
        best = np.full((n, goal + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((self.parts, n, goal + 1), np.int64)
        for p in range(self.parts):
            new = np.full((n, goal + 1), np.inf)
            for total in range(goal + 1):
                for t in range(total + 1):
                    c = best[:, total - t] + cost[:, p, t]
                    better = c < new[:, total]
                    new[better, total] = c[better]
                    choice[p, better, total] = t
            best = new
        out, left, rows = np.zeros((n, self.parts), np.int64), np.full(n, goal), np.arange(n)
        for p in range(self.parts - 1, -1, -1):
            out[:, p] = choice[p, rows, left]
            left -= out[:, p]
        return out - 1

    def part_values(self, values: np.ndarray) -> np.ndarray:
        return values if self.merge == 1 else values[:, ::2] | values[:, 1::2] << WIDTH

    def sides(self, part: int, value: np.ndarray) -> np.ndarray | None:
        """Into how many blocks each side of a value is dealt; 0 where HOT fingerprints or fewer have it.

        Of single groups the counts are known; of wide parts they have to be taken from the probes (None).
        """
        if self.merge == 2:
            return None
        have, near = self.rings[0][part, value], self.rings[0][part, value] + self.rings[1][part, value]
        return np.where(have > HOT, -(-near.astype(np.int64) // CELL), 0).astype(np.int32)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and in how many each two bits are set: 4096 sums, whatever the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            b = bits_of(numbers(batch)).astype(np.float32)
            both += b.T @ b
            n += len(b)
        yield pa.RecordBatch.from_pydict({"cell": list(range(4097)), "n": [*both.astype(np.int64).ravel().tolist(), n]})

    out = np.zeros(4097, np.int64)
    for r in distinct.select("fp").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(64, 64).astype(float)


def value_counts(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many rows have each value of each group: GROUPS << WIDTH numbers at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GROUPS << WIDTH, np.int64)
        for batch in batches:
            v = values_of(numbers(batch), groups)
            for g in range(GROUPS):
                np.add.at(counts, (g << WIDTH) + v[:, g], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": counts[at]})

    got = distinct.select("fp").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GROUPS << WIDTH, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(GROUPS, 1 << WIDTH)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct(fp)``, a table without repeated or null rows.

    Two are linked if they differ in up to ``radius`` bits. Every link between the fingerprints of a value is given, or,
    where many share the value, a spanning forest of them: enough for components, and never more rows than probes.
    """
    spark = distinct.sparkSession
    n, both = bit_statistics(distinct)
    groups = group_bits(both, n)
    plan = Allocation(value_counts(distinct, groups), groups, n, radius)
    shared = spark.sparkContext.broadcast(plan)  # radius + 1 tables of GROUPS << WIDTH numbers: 4 MB, whatever the corpus

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        flips = masks(WIDTH * plan.merge, radius)
        work_begins("simhash")
        for batch in batches:
            fp = numbers(batch)
            values = values_of(fp, groups)
            parts, limits = plan.part_values(values), plan.thresholds(values)
            for k in range(plan.parts if len(fp) else 0):
                out = [(parts[:, k], np.arange(len(fp)), False)]
                for d in range(radius + 1):
                    mine = np.flatnonzero(limits[:, k] >= d)
                    out += [(parts[mine, k] ^ m, mine, True) for m in (flips[d] if len(mine) else ())]
                value, at = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                probe = np.concatenate([np.full(len(x[0]), x[2]) for x in out])
                sides = plan.sides(k, value)
                columns = [np.full(len(value), k, np.int32), value, fp[at], probe, np.zeros(len(value), np.int32) if sides is None else sides]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "value", "fp", "probe", "sides"])

    rows = stage_table(distinct.select("fp").mapInArrow(probe_rows, "part int, value bigint, fp bigint, probe boolean, sides int"), "probes")
    if plan.merge == 2:  # real counts of each value, of which only those that many have are kept
        have, asked = F.sum(F.when(F.col("probe"), 0).otherwise(1)), F.sum(F.when(F.col("probe"), 1).otherwise(0))
        many = rows.groupBy("part", "value").agg(have.alias("have"), asked.alias("asked")).where(F.col("have") > HOT)
        many = stage_table(many.select("part", "value", F.ceil(F.greatest("have", "asked") / CELL).cast("int").alias("dealt")), "many")
        rows = rows.join(many, ["part", "value"], "left").select("part", "value", "fp", "probe", F.coalesce("dealt", F.lit(0)).alias("sides"))
        rows = stage_table(rows, "probes")
    cold, hot = rows.where("sides = 0"), rows.where("sides > 0")
    # hot values: each side is dealt to blocks by a hash; a cell holds one block of each side
    side = F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    cells = hot.where("sides = 1").select("part", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "probe")
    cells = cells.union(hot.where("sides > 1 and probe").select("part", "value", side.alias("x"), every.alias("y"), "fp", "probe")).union(hot.where("sides > 1 and not probe").select("part", "value", every.alias("x"), side.alias("y"), "fp", "probe"))
    cell = ["part", "value", "x", "y"]

    def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def linked(c: list[np.ndarray], start: int, stop: int) -> list[tuple[int, int]]:
            fp, probe = (x[start:stop] for x in c[4:])
            return spanning_links(fp[probe], fp[~probe], radius)

        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if kept is not None:
                c = [np.concatenate(x) for x in zip(kept, c)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c[:4]], axis=0)) + 1
            bounds = [0, *cut.tolist()]
            found = [e for a, b in zip(bounds, bounds[1:]) for e in linked(c, a, b)]
            kept = [x[bounds[-1] :] for x in c]  # the last cell may go on in the next batch
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [x for _, x in found]})
        found = linked(kept, 0, len(kept[0])) if kept is not None else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return cold_links(cold, radius).union(cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(cell_links, "a bigint, b bigint"))


def cold_links(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs that agree on a value which few have: HOT at most for each probe."""
    q = rows.where("probe").select("part", "value", F.col("fp").alias("a"))
    d = rows.where("not probe").select("part", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return q.join(d, (q["part"] == d["part"]) & (q["value"] == d["value"]) & near & (F.col("a") < F.col("b"))).select("a", "b")


def spanning_links(fp_a: np.ndarray, fp_b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """What the links between two sets of fingerprints join, as (least, other): a star for each component."""
    nodes, place = np.unique(np.concatenate([fp_a, fp_b]), return_inverse=True)
    left, right = place[: len(fp_a)], place[len(fp_a) :]
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(fp_b)))
    for at in range(0, len(fp_a), step):
        i, j = np.nonzero(np.bitwise_count((fp_a[at : at + step, None] ^ fp_b[None, :]).view(np.uint64)) <= radius)
        i = i + at
        apart = label[left[i]] != label[right[j]]
        for u, v in zip(left[i[apart]], right[j[apart]]):
            p, q = label[u], label[v]
            if p != q:
                label[label == max(p, q)] = min(p, q)
    return [(int(nodes[label[k]]), int(nodes[k])) for k in np.flatnonzero(label != np.arange(len(nodes)))]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed long) and component_id of each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach; equal fingerprints are linked, and texts without words have
    fingerprint zero like any other. A null doc_id counts only where no other is reached. Repeated rows are members of
    one component; an empty table gives an empty result; other columns are not read. ``key`` names another column, of
    any ordered kind, that stands in for doc_id.
    """
    found = stage_table(fingerprints(docs, shingle, seed, key), "fingerprints")
    distinct = stage_table(found.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = connected_components(links(distinct, radius)).withColumnRenamed("node", "linked")
    rooted = distinct.join(roots, F.col("fp") == F.col("linked")).select("fp", "root", "first")
    least = stage_table(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = stage_table(rooted.join(least, "root").select("fp", "least"), "linked")
    classes = stage_table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return found.join(classes, "fp").select(key, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
