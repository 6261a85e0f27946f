import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernsieve.operators import pool, vectors
from fernsieve.operators.vectors import complete_linkage

SCHEMA = "bucket_id int, uuid string, member_ord int, embedding array<float>, n int"


def some_vectors(seed, sizes, step, dims=2):
    """Vectors on a grid, so that many distances are equal; uuids are in another order than places."""
    rng = random.Random(seed)
    rows = []
    for bucket, size in enumerate(sizes):
        names = rng.sample(range(10 * size), size)
        rows += [(bucket, f"u{names[k]:05d}", k, [rng.randrange(step) * 0.25 for _ in range(dims)], 7) for k in range(size)]
    return rows


def by_hand(rows, cut):
    out = []
    for bucket in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((r for r in rows if r[0] == bucket and r[3] is not None), key=lambda r: r[2])
        x = np.array([r[3] for r in own])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        out += [(bucket, c, k, own[i][1]) for c, m in enumerate(complete_linkage([r[1] for r in own], d, cut)) for k, i in enumerate(m)]
    return sorted(out)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MATRIX", 6)
    monkeypatch.setattr(vectors, "TASK_PAIRS", 40)


@pytest.mark.parametrize("seed, step, cut", [(1, 8, 0.6)])
def test_linkage_by_components_and_rounds_equals_the_matrix(spark, small_parts, seed, step, cut):
    rows = some_vectors(seed, (40, 3, 1, 9), step) + [(None, "x", 0, [0.0, 0.0], 7), (1, "empty", 9, None, 7)]
    got = vectors.linkage_clusters(spark.createDataFrame(rows, SCHEMA), cut)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, cut)


def test_linkage_of_whole_components_and_of_nothing(spark):
    rows = some_vectors(4, (90, 40, 2), 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vectors.linkage_clusters(df.repartition(5), 0.8).collect())) == by_hand(rows, 0.8)
    assert vectors.linkage_clusters(df.limit(0), 0.8).count() == 0 and vectors.linkage_clusters(df, 0.0).count() == 0


def test_linkage_compares_one_of_equal_vectors(spark, small_parts, monkeypatch):
    """Many copies of few vectors: the clusters of the matrix, with no pair of equal vectors among those that are compared."""
    rows = some_vectors(6, (60, 3), 3) + [(1, "none", 90, None, 7)]
    rows += [(2, f"c{k}", k, [-0.0 if k % 2 else 0.0, 1.0], 7) for k in range(30)] + [(2, f"n{k}", 40 + k, [float("nan"), 1.0], 7) for k in range(3)]
    compared = []

    def counted(distinct, *a, found=vectors.pair_distances, **b):
        compared.append(distinct.groupBy("bucket_id").count().collect())
        return found(distinct, *a, **b)

    monkeypatch.setattr(vectors, "pair_distances", counted)
    got = sorted(map(tuple, vectors.linkage_clusters(spark.createDataFrame(rows, SCHEMA), 0.3).collect()))
    assert got == by_hand([r for r in rows if r[1][0] != "n"], 0.3) and len(got) > 80
    assert [dict(map(tuple, x)) for x in compared] == [{0: 9, 2: 4}]  # of 60 and 33


def distances(rows, bucket):
    own = sorted((r for r in rows if r[0] == bucket and r[3] is not None), key=lambda r: r[2])
    return [(own[i][1], own[j][1], float(np.sqrt(((np.array(own[j][3]) - np.array(own[i][3])) ** 2).sum()))) for i in range(len(own)) for j in range(i + 1, len(own))]


def test_pairs_and_their_order_statistics_cross_blocks(spark, small_parts):
    rng = random.Random(9)
    rows = some_vectors(5, (50, 2, 1, 33), 7) + [(8, f"v{k}", k, [rng.randrange(999) / 1024, rng.randrange(999) / 64 - 9], 7) for k in range(41)] + [(9, f"same{k}", k, [1.0, 2.0], 7) for k in range(40)] + [(9, "none", 99, None, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(b, *p) for b in (0, 1, 2, 3, 8, 9) for p in distances(rows, b)]
    assert sorted(map(tuple, vectors.pair_distances(df).collect())) == sorted(want)
    assert sorted(map(tuple, vectors.pair_distances(df, below=0.5).collect())) == sorted(p for p in want if p[3] < 0.5)
    got = {r["bucket_id"]: tuple(r)[1:] for r in vectors.pair_statistics(df).collect()}
    assert got == {b: (len(d), max(d), statistics.median(d)) for b in (0, 1, 3, 8, 9) for d in [[x[2] for x in distances(rows, b)]]}
    assert vectors.pair_statistics(df.limit(0)).count() == vectors.pair_distances(df.limit(0)).count() == 0


def test_vectors_of_several_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0], 1), (1, "b", 1, [1.0, 2.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        vectors.pair_distances(df).collect()


def way(p, q):
    a, b = np.radians(p), np.radians(q)
    h = np.sin((b[0] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(b[0]) * np.sin((b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(min(1.0, np.sqrt(h)))


def test_spread_over_poles_the_date_line_and_many_places(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 24)
    rng = random.Random(12)
    trips = {
        0: [(10.0, 179.9), (10.0, -179.9), (10.1, 179.5)],  # over the date line
        1: [(90.0, 0.0), (-90.0, 77.0), (0.0, 0.0)], 2: [(0.0, 10.0), (0.0, -170.0), (1.0, 10.0)],  # antipodes
        3: [(5.0, 5.0)] * 4, 4: [(1.0, 1.0)], 5: [(None, 3.0), (2.0, None)],
        6: [(47 + rng.random(), 8 + rng.random()) for _ in range(300)],  # a town
        7: [(89.5 + rng.random() / 2, rng.uniform(-180, 180)) for _ in range(200)],  # around a pole
        8: [(float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), rng.uniform(-180, 180)) for _ in range(150)],  # everywhere
        9: [(0.0, -180 + k * 2.0) for k in range(180)],  # a ring, where everybody has an antipode
        10: [(40.0 + rng.choice([0, 0.0001]) * k, 20.0) for k in range(60)] + [(40.0, 20.3)],
    }
    rows = [(t, f"u{t}-{k}", "2025-06-01 10:00:00", lat, lon, 3) for t, places in trips.items() for k, (lat, lon) in enumerate(places)]
    df = spark.createDataFrame(rows, "trip_ord int, uuid string, date string, latitude double, longitude double, place int").withColumn("date", F.to_timestamp("date"))
    got = {r["trip_ord"]: r for r in pool.trip_spread(df).collect()}
    for t, places in trips.items():
        known = [p for p in places if None not in p]
        want = max((way(p, q) for p in known for q in known), default=None) if len(known) > 1 else None
        assert got[t]["size"] == len(places) and (got[t]["spread_km"] is None) == (want is None)
        assert want is None or abs(got[t]["spread_km"] - want) < 1e-4 and got[t]["wide"] == (want > 150)
    assert pool.trip_spread(df.limit(0)).count() == 0
    inside = pool.outer_places(df.where("trip_ord = 6").select("trip_ord", F.col("uuid").alias("place"), *[c.alias(n) for n, c in zip("xyz", (F.cos(F.radians("latitude")) * F.cos(F.radians("longitude")), F.cos(F.radians("latitude")) * F.sin(F.radians("longitude")), F.sin(F.radians("latitude"))))]))
    assert inside.count() < 60  # of 300: the rest lie inside


def test_of_the_tables_of_pairs_one_stays_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MATRIX", 4)
    written, left = [], []
    stage_table, drop_staged = vectors.stage_table, vectors.drop_staged
    held = lambda: [t for t in written if getattr(t, "_staged_at", None)]

    def stage(df, name):
        got = stage_table(df, name)
        if name in ("near", "parted", "pairs"):
            written.append(got)
            left.append(len(held()))
        return got

    monkeypatch.setattr(vectors, "stage_table", stage)
    rng = np.random.default_rng(8)
    rows = [(1, f"u{(k * 7) % 60:02d}", k, (rng.integers(0, 12, 2) * 0.25).tolist(), 7) for k in range(60)]
    got = sorted(map(tuple, vectors.linkage_clusters(spark.createDataFrame(rows, SCHEMA), 0.9).collect()))
    assert got == by_hand(rows, 0.9)
    assert len(written) > 3 and max(left) <= 2 and not held()
    assert "uuid_a" not in written[0].columns


def test_pairs_linked_by_queue_equal_the_matrix_with_ties():
    for seed in range(30):
        rows = some_vectors(seed, (40,), 7)
        x, names = np.array([r[3] for r in rows]), [r[1] for r in rows]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        rank = {u: k for k, u in enumerate(sorted(names))}
        a, b = np.nonzero(np.triu(d < 0.8, 1))
        label = vectors.linked_pairs([rank[u] for u in names], a.tolist(), b.tolist(), d[a, b].tolist())
        members = {}
        for k, i in enumerate(label):
            members.setdefault(i, []).append(k)
        assert sorted(m for m in members.values() if len(m) > 1) == complete_linkage(names, d, 0.8)


def test_near_pairs_of_a_large_group_are_few_at_a_time(spark, monkeypatch):
    """Most pairs are near, and clusters outgrow a block: steps of a growing cut give the clusters of the matrix without a table of all near pairs."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MATRIX", 60)
    monkeypatch.setattr(vectors, "TASK_PAIRS", 600)
    monkeypatch.setattr(vectors, "WIDE", 2)
    monkeypatch.setattr(vectors, "SAMPLE", 100)
    written, stage_table = [], vectors.stage_table

    def stage(df, name):
        got = stage_table(df, name)
        if name in ("near", "parted", "pairs"):
            written.append(got.count())
        return got

    monkeypatch.setattr(vectors, "stage_table", stage)
    rng = np.random.default_rng(3)
    rows = [(1, f"u{(k * 7) % 240:03d}", k, rng.normal(0, 0.3, 3).astype(np.float32).tolist(), 7) for k in range(240)]
    rows += [(2, f"v{(k * 11) % 90:03d}", k, (4096 + rng.integers(0, 40, 3) * 0.25).tolist(), 7) for k in range(90)]  # far from 0, with ties
    odd = [(1, "w0", 300, [float("nan"), 0.0, 0.0], 7), (1, "w1", 301, [float("inf"), 0.0, 0.0], 7)]
    want = by_hand(rows, 1.5)
    assert max(k for b, _, k, _ in want if b == 1) > 32  # more than two blocks in one cluster
    assert sum(d < 1.5 for _, _, d in distances(rows, 1)) > 25_000
    assert sorted(map(tuple, vectors.linkage_clusters(spark.createDataFrame(rows + odd, SCHEMA), 1.5).collect())) == want
    assert len(written) > 2 and max(written) < 8_000
