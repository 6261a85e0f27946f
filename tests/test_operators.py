import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernsieve import schema
from fernsieve.functions import scalar
from fernsieve.operators import actions, albums, audit, decisions, explain, pool, sampling, scoring, sessions, sweep, vectors
from fernsieve.operators.components import connected_components
from fernsieve.sources import cache, library

START = dt.datetime(2025, 6, 1, 12)
RECORD = "uuid string, date timestamp, burst_key string, derivative_path string, is_shared boolean, is_favorite boolean, is_hidden boolean, is_video boolean, is_screenshot boolean, is_screen_recording boolean, duration_seconds double, fingerprint string, filesize bigint, album_count int, latitude double, longitude double"


def record(uuid, seconds=0, **more):
    base = {"uuid": uuid, "date": None if seconds is None else START + dt.timedelta(seconds=seconds), "burst_key": None, "derivative_path": "/d", "duration_seconds": None, "fingerprint": None, "filesize": 1, "album_count": 0, "latitude": None, "longitude": None}
    return base | dict.fromkeys(("is_shared", "is_favorite", "is_hidden", "is_video", "is_screenshot", "is_screen_recording"), False) | more


def records(spark, *rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in rows], RECORD)


def groups(df, key):
    out = {}
    for r in df.orderBy(key, "member_ord").collect():
        out.setdefault(r[key], []).append(r["uuid"])
    return list(out.values())


def test_gap_is_strict_and_undated_records_go(spark):
    df = records(spark, record("a", 0), record("b", 89), record("c", 179), record("d", None))
    assert groups(sessions.time_buckets(df), "bucket_ord") == [["a", "b"], ["c"]]
    assert sessions.gap_run_count(df).first()["n_runs"] == 1


def test_bursts_join_over_several_steps(spark):
    df = records(spark, record("a", 0, burst_key="1"), record("b", 1000, burst_key="2"), record("c", 2000, burst_key="1"), record("d", 2010, burst_key="2"), record("e", 5000))
    assert groups(sessions.merge_bursts(sessions.time_buckets(df)), "bucket_ord") == [["a", "b", "c", "d"], ["e"]]


def test_records_without_raster_bridge_but_shared_ones_do_not(spark):
    bridge = records(spark, record("a", 0), record("b", 80, derivative_path=None), record("c", 160))
    assert groups(sessions.candidate_buckets(bridge), "bucket_ord") == [["a", "c"]]
    shared = records(spark, record("a", 0), record("b", 80, is_shared=True), record("c", 160))
    assert groups(sessions.candidate_buckets(shared), "bucket_ord") == []


def test_runs_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [record(f"u{k:04d}", rng.randrange(40_000), burst_key=rng.choice([None, None, "x", "y"])) for k in range(400)]
    want, last = [], None
    for r in sorted(rows, key=lambda r: (r["date"], r["uuid"])):
        if last and ((r["date"] - last["date"]).total_seconds() < 90 or r["burst_key"] and r["burst_key"] == last["burst_key"]):
            want[-1].append(r["uuid"])
        else:
            want.append([r["uuid"]])
        last = r
    assert groups(sessions.time_buckets(records(spark, *rows).repartition(7)), "bucket_ord") == want


def test_trips_split_beyond_the_gap_and_at_missing_dates(spark):
    h = 3600
    df = records(spark, record("a", 0), record("b", 48 * h), record("c", 97 * h), record("d", 98 * h), record("e", None), record("f", None))
    assert groups(sessions.trips(df, 48.0, 2), "trip_ord") == [["a", "b"], ["c", "d"]]


def test_spread_and_title(spark):
    df = records(spark, record("a", 0, latitude=37.7749, longitude=-122.4194), record("b", 10, latitude=40.7128, longitude=-74.006), record("c", 20), record("d", 30, latitude=40.7128, longitude=-74.006))
    row = pool.trip_spread(df.withColumn("trip_ord", F.lit(0))).first()
    assert 4125 < row["spread_km"] < 4133 and row["wide"] and row["title"] == "Jun 1, 2025" and row["size"] == 4


def test_empty_tables(spark):
    none = records(spark)
    assert audit.totals(none).first()["size_bytes"] == 0 and audit.totals(none.withColumnRenamed("x", "y")).count() == 1
    assert [r["count"] for r in audit.by_duration(none).collect()] == [0] * 4 and len(audit.by_type(none).collect()) == 9
    assert sessions.time_buckets(none).count() == 0 and sweep.sweep_counts(sweep.build_sweep(none, START)).count() == 3
    assert sampling.stratified_sample(spark.createDataFrame([], "ord bigint, size bigint, diameter double")).count() == 0


def test_first_category_wins_and_a_bad_member_saves_its_group(spark):
    old = -400 * 86400
    df = records(
        spark,
        record("a", old, is_screen_recording=True, is_video=True, duration_seconds=2.0), record("b", 0, is_video=True, duration_seconds=2.0), record("c", 0, is_video=True, duration_seconds=5.0),
        record("d", 5, fingerprint="x"), record("e", 0, fingerprint="x"), record("f", None, fingerprint="x"), record("g", 0, fingerprint="y"), record("h", 0, fingerprint="y", is_favorite=True), record("i", 0, fingerprint=""), record("j", 0, fingerprint=""),
    )
    got = {r["uuid"]: r["category"] for r in sweep.build_sweep(df, START).collect()}
    assert got == {"a": "screenshots", "b": "short_videos", "d": "exact_duplicates", "f": "exact_duplicates"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 4), (5, 5)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_linkage(uuids, d, cut):
    clusters = [[i] for i in range(len(uuids))]
    while True:
        best = None
        for x, y in itertools.combinations(range(len(clusters)), 2):
            key = (max(d[i][j] for i in clusters[x] for j in clusters[y]), *sorted((uuids[clusters[x][0]], uuids[clusters[y][0]])))
            if best is None or key < best[0]:
                best = (key, x, y)
        if best is None or not best[0][0] < cut:
            return [c for c in clusters if len(c) > 1]
        clusters[best[1]] = sorted(clusters[best[1]] + clusters.pop(best[2]))
        clusters.sort(key=lambda c: c[0])


def test_complete_linkage_against_brute_force_with_ties():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(0, 9)
        x = [rng.randrange(0, 6) / 4 for _ in range(n)]
        uuids = rng.sample([f"u{k}" for k in range(20)], n)
        d = np.abs(np.subtract.outer(x, x)) if n else np.zeros((0, 0))
        assert vectors.complete_linkage(uuids, d, 0.8) == slow_linkage(uuids, d, 0.8)


def test_linkage_does_not_chain(spark):
    df = spark.createDataFrame([(1, f"u{k}", k, [x]) for k, x in enumerate((0.0, 0.35, 0.70))], "bucket_id int, uuid string, member_ord int, embedding array<float>")
    assert [r["uuid"] for r in vectors.linkage_clusters(df, 0.40).orderBy("member_ord").collect()] == ["u0", "u1"]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(scalar.l2_distance(F.col("a"), F.col("b"))).collect()


def test_scores_drop_what_is_missing(spark):
    df = spark.createDataFrame([(1, "a", 0.5, None, 0.2), (1, "b", 0.9, 0.3, 0.1), (2, "c", None, None, None)], "cluster_id int, uuid string, sharpness double, faces double, exposure double")
    got = {r["uuid"]: r for r in scoring.rank_members(scoring.common_criteria(df, {"sharpness": 0.35, "faces": 0.35, "exposure": 0.15})).collect()}
    assert math.isclose(got["a"]["total"], (0.35 * 0.5 + 0.15 * 0.2) / 0.5) and got["a"]["dropped"] == ["faces"] and got["b"]["rank"] == 1
    assert got["c"]["total"] == 0 and not got["c"]["ambiguous"] and got["c"]["winner"] == "c"
    sharp = spark.createDataFrame([(1, "a", 5.0, 480, 360), (1, "b", 10.0, 480, 300), (2, "c", 1.0, 0, 0), (3, "d", None, 4, 4), (3, "e", 2.0, 4, 4)], "cluster_id int, uuid string, laplacian double, width int, height int")
    assert {r["uuid"]: r["sharpness"] for r in scoring.relative_sharpness(sharp).collect()} == {"a": 0.5, "b": 1.0, "c": None, "d": None, "e": None}
    assert {r["uuid"]: r["mark"] for r in explain.proposed_marks(spark.createDataFrame([(1, "a", "a"), (1, "b", "a"), (2, "c", None)], "cluster_id int, uuid string, winner string")).collect()} == {"a": "keep", "b": "cull", "c": "unset"}
    assert explain.ranking_basis(scoring.common_criteria(df, {"sharpness": 0.5, "faces": 0.5})).count() == 2 and explain.standing(scoring.rank_members(scoring.common_criteria(df))).count() == 2


def test_allocation_and_even_places(spark):
    assert sampling.allocate({"a": 100, "b": 2, "c": 50}, 20) == {"a": 9, "b": 2, "c": 9}
    assert sampling.allocate({"a": 3, "b": 3, "c": 3}, 4) == {"a": 2, "b": 1, "c": 1} and sampling.allocate({"a": 1}, 9) == {"a": 1} and sampling.allocate({}, 3) == {}
    df = spark.range(100).select(F.col("id").alias("ord"), F.lit(2).cast("bigint").alias("size"), (F.col("id") % 20 / 100).alias("diameter"))
    sample = sampling.stratified_sample(df, 8)
    assert sample.count() == 8 and {r["count"] for r in sample.groupBy("stratum").count().collect()} == {2}


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text("gap_seconds = 30\n")
    assert schema.load_settings(f, similarity_threshold=0.5, gap_seconds=None).gap_seconds == 30
    for bad in ("oops = 1", "gap_seconds = 'x'", "gap_seconds = -1", "[weights]\nsharpness = 0.9"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            schema.load_settings(f)
    a, b = (schema.settings_document(schema.ClusterSettings(gap_seconds=g), s) for g, s in ((90.0, "x"), (30.0, "y")))
    assert schema.settings_digest(a) == schema.settings_digest(a | {"source": "z"}) != schema.settings_digest(b) and ("gap_seconds", 90.0, 30.0) in schema.settings_changes(a, b)


def test_log_ledger_and_cache(spark, tmp_path):
    marks = spark.createDataFrame([(1, "a", "keep", True), (1, "a", "cull", False), (1, None, "x", False), (2, "b", "cull", True)], "batch_id int, photo_id string, mark string, favorite boolean")
    assert {(r["photo_id"], r["problem"]) for r in decisions.invalid_marks(marks).collect()} == {("a", "two-verdicts"), (None, "no-id"), (None, "unknown-mark"), ("b", "favorite-not-kept")}
    with pytest.raises(ValueError):
        decisions.page(marks, ["batch_id"], -1)
    pending = spark.createDataFrame([("a", "favorite"), ("b", "boom")], "photo_id string, action string")

    def writer(photo, action):
        if action == "boom":
            raise RuntimeError(action)

    ledger = str(tmp_path / "ledger")
    assert actions.apply_actions(pending, None, None).first()["n"] == 2
    with pytest.raises(ValueError):
        actions.apply_actions(pending, None, None, dry_run=False)
    assert {r["status"]: r["n"] for r in actions.apply_actions(pending, writer, ledger, dry_run=False).collect()} == {"done": 1, "failed": 1}
    assert [r["photo_id"] for r in actions.split_by_ledger(pending, spark.read.parquet(ledger))[0].collect()] == ["b"]
    folder = cache.cache_folder(str(tmp_path), "prints", 2)
    kind = "uuid string, mod_key string, analysis_key string, payload string, written int"
    assert cache.get(spark, folder, kind).count() == 0
    cache.put(spark.createDataFrame([("a", "", "k", "old", 1), ("a", "", "k", "new", 2)], kind), folder)
    hits, misses = cache.hits_and_misses(spark.createDataFrame([("a", "", "k"), ("a", "m", "k")], "uuid string, mod_key string, analysis_key string"), cache.get(spark, folder, kind))
    assert [r["payload"] for r in hits.collect()] == ["new"] and misses.count() == 1


def test_albums_and_pages(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    move = lambda x, y: df.select(albums.move_before(F.col("s"), F.lit(x), F.lit(y))).first()[0]
    assert move("c", "a") == ["c", "a", "b"] and move("a", "c") == ["b", "a", "c"] and move("a", "a") == move("z", "a") == ["a", "b", "c"]
    boxes = scalar.page_boxes(1800, 1200, bleed_mm=3, marks=True)
    assert boxes["page"][2] == 1800 + 2 * 35 + 2 * 71 and len(scalar.crop_marks(boxes)) == 8 and scalar.crop_marks(scalar.page_boxes(10, 10)) == []
    plan = albums.export_plan(spark.createDataFrame([(1, ["a", "x"], {"a": (1.0, 0.0)})], "album_id int, sequence array<string>, offsets map<string,struct<x:double,y:double>>"), spark.createDataFrame([("a", 3000, 1000)], "uuid string, width int, height int"), 1800, 1200)
    assert [(r["uuid"], r["status"]) for r in plan.orderBy("place").collect()] == [("a", "planned"), ("x", "failed")] and plan.where("uuid = 'a'").first()["crop"]["x"] == 1500


def test_library_sources(spark):
    albums_df = spark.createDataFrame([(1, "Keepers", ["Other"], ["z"]), (2, "Keepers", ["Cull"], ["a", "a", "b"])], "ordinal int, title string, folder_names array<string>, uuids array<string>")
    assert {r["uuid"] for r in library.album_members(albums_df).collect()} == {"a", "b"}
    photos = spark.createDataFrame([(0, "k", True, [("s", False), ("t", True), ("q", None)]), (1, "q", False, [])], "ordinal int, uuid string, burst boolean, burst_photos array<struct<uuid:string,intrash:boolean>>")
    assert {r["uuid"]: r["burst_key"] for r in library.expand_bursts(photos).collect()} == {"k": "k", "s": "k", "q": "k"}
