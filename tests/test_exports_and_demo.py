import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fernsieve.operators import album_export, albums, decisions, pipeline, sweep
from fernsieve.plans.progress import watched
from fernsieve.schema import ClusterSettings
from fernsieve.sources import demo

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
ALBUMS = "album_id int, sequence array<string>, offsets map<string,struct<x:double,y:double>>"
RENDITIONS = "uuid string, edited boolean, path string, width int, height int"


class Folder:
    """A sink that writes the crop to a file and notes each call; it refuses one photo."""

    def __init__(self, at, refuses=None):
        self.at, self.refuses = str(at), refuses

    def __call__(self, album, photo, path, crop):
        if photo == self.refuses:
            raise OSError("disk full")
        with open(os.path.join(self.at, "calls"), "a") as f:
            f.write(f"{album} {photo}\n")
        with open(os.path.join(self.at, f"{album}-{photo}.json"), "w") as f:
            json.dump([path, crop], f)


def plan_of(spark, rows, photos, renditions):
    entries = album_export.entries_of(spark.createDataFrame(rows, ALBUMS))
    return album_export.plan_export(entries, spark.createDataFrame(photos, "uuid string, adjusted boolean"), spark.createDataFrame(renditions, RENDITIONS), 1800, 1200)


def test_export_prefers_edited_falls_back_and_isolates_failures(spark, tmp_path):
    photos = [("a", True), ("b", True), ("c", False), ("d", None), ("e", False), ("f", True), ("g", False)]
    renditions = [
        ("a", False, "a.o", 3000, 1000), ("a", True, "a.e", 1500, 1000), ("b", False, "b.o", 3000, 1000), ("b", True, None, 9, 9), ("c", False, "c.o", 600, 400),
        ("c", True, "c.e", 1, 1), ("d", False, "d.o", None, 7), ("g", False, "g.2", 10, 10), ("g", False, "g.1", 300, 200),
    ]
    rows = [(1, ["b", "gone", "a", "c", "d", "e", "a", None], {"b": (1.0, 0.0)}), (2, ["g", "f"], {}), (3, [], {}), (4, ["c"], None), (5, None, None)]
    plan = plan_of(spark, rows, photos, renditions)
    got = {(r["album_id"], r["place"]): r for r in plan.collect()}
    why = {k: (r["status"], r["reason"]) for k, r in got.items()}
    assert why == {
        (1, 0): ("planned", None), (1, 1): ("failed", "no-photo"), (1, 2): ("planned", None), (1, 3): ("planned", None), (1, 4): ("failed", "unreadable"), (1, 5): ("failed", "no-rendition"),
        (1, 6): ("planned", None), (1, 7): ("failed", "no-photo"), (2, 0): ("planned", None), (2, 1): ("failed", "no-rendition"), (4, 0): ("planned", None),
    }
    assert {k for k, r in got.items() if r["crop_not_applied"]} == {(1, 0)}  # adjusted, but only its original could be made
    assert [got[k]["path"] for k in ((1, 0), (1, 2), (1, 3), (2, 0))] == ["b.o", "a.e", "c.o", "g.1"]
    assert got[1, 0]["crop"].asDict() == {"x": 1500, "y": 0, "width": 1500, "height": 1000} and got[1, 2]["crop"]["x"] == 0

    rows = album_export.carry_out(plan, Folder(tmp_path, refuses="c"))
    done = {(r["album_id"], r["place"]): (r["status"], r["reason"]) for r in rows.collect()}
    assert done == why | {k: ("exported", None) for k in ((1, 0), (1, 2), (1, 6), (2, 0))} | {k: ("failed", "OSError: disk full") for k in ((1, 3), (4, 0))}
    assert sorted(open(tmp_path / "calls").read().split("\n")) == ["", "1 a", "1 b", "2 g"]  # twice in an album, written once
    assert json.load(open(tmp_path / "1-b.json")) == ["b.o", {"x": 1500, "y": 0, "width": 1500, "height": 1000}]
    report = {r["album_id"]: tuple(r)[1:] for r in album_export.export_report(rows).collect()}
    assert report == {1: (3, 5, 1), 2: (1, 1, 0), 4: (0, 1, 0)}
    assert [tuple(r) for r in album_export.exported_order(rows).collect()] == [(1, 0, "b"), (1, 2, "a"), (1, 6, "a"), (2, 0, "g")]


def test_export_of_nothing(spark, tmp_path):
    plan = plan_of(spark, [], [], [])
    assert album_export.carry_out(plan, Folder(tmp_path)).count() == 0 and album_export.export_report(plan).count() == 0


def test_demo_shares_hold_at_a_million_takes(spark):
    shares = demo.DemoShares()
    clusters = demo.demo_clusters(spark.range(300_000).withColumnRenamed("id", "cluster_ord"), seed=3)
    small = F.col("n_small")
    rates = {
        "ambiguous": F.col("ambiguous"), "unmeasured": ~F.col("sharpness_available"), "low": small == F.col("size"), "mixed": (small > 0) & (small < F.col("size")), "evicted": F.col("evicted"),
        "no_horizon": F.array_contains("dropped", "horizon"), "no_faces": F.array_contains("dropped", "faces"),
    }
    got = clusters.agg(F.sum("size").alias("takes"), *[F.avg(c.cast("double")).alias(n) for n, c in rates.items()], *[F.avg((F.col("size") == n).cast("double")).alias(f"s{n}") for n in shares.sizes]).first()
    assert got["takes"] > 10**6
    for name in rates:
        assert abs(got[name] - getattr(shares, name)) < 0.004, name
    for n, share in shares.sizes.items():
        assert abs(got[f"s{n}"] - share) < 0.004, n


def test_demo_is_the_same_however_keys_are_dealt_and_agrees_with_itself(spark):
    keys = spark.range(400).withColumnRenamed("id", "cluster_ord")
    made = lambda k: sorted(map(tuple, demo.demo_members(demo.demo_clusters(k, seed=5)).collect()), key=lambda r: r[:2])
    assert made(keys.repartition(1)) == made(keys.repartition(13)) != made(keys.withColumn("cluster_ord", F.col("cluster_ord") + 1))
    clusters = {r["cluster_ord"]: r for r in demo.demo_clusters(keys, seed=5).collect()}
    by = {}
    for r in demo.demo_members(demo.demo_clusters(keys, seed=5)).collect():
        by.setdefault(r["cluster_ord"], []).append(r)
    assert by.keys() == clusters.keys()
    for n, c in clusters.items():
        takes = sorted(by[n], key=lambda r: r["member_ord"])
        best = max(takes, key=lambda r: r["total"])
        totals = sorted((r["total"] for r in takes), reverse=True)
        assert len(takes) == c["size"] and best["uuid"] == c["winner"] and best["member_ord"] > 0 and best["distance_to_winner"] is None
        assert (totals[0] - totals[1] < 0.05) == c["ambiguous"]  # the margin that scoring calls ambiguous
        for name in ("sharpness", "faces", "framing", "horizon"):
            assert all((r[name] is None) == (name in c["dropped"]) for r in takes)
        if c["sharpness_available"]:
            assert best["sharpness"] == 1 and min(r["sharpness"] for r in takes) == (0.98 if c["ambiguous"] else 0.74)
        assert [r["display_width"] for r in takes] == [None if c["evicted"] and k == c["size"] - 1 else 480 if k < c["n_small"] else 1024 for k in range(c["size"])]
    assert demo.demo_clusters(spark.createDataFrame([(None,), (-1,)], "cluster_ord bigint")).count() == 0
    repeated = spark.createDataFrame([(7, "x"), (7, "y")], "cluster_ord bigint, size string")  # clashing names
    assert demo.demo_clusters(repeated).distinct().count() == 1 and demo.demo_clusters(repeated).count() == 2


def test_demo_shares_that_cannot_be_are_refused():
    for bad in ({"ambiguous": 1.1}, {"sizes": {2: 0.5}}, {"sizes": {1: 1.0}}, {"low": 0.7, "mixed": 0.7}):
        with pytest.raises(ValueError):
            demo.DemoShares(**bad)


def test_demo_pool_has_trips_and_crops(spark):
    rows = demo.demo_pool(spark.range(4000).withColumnRenamed("id", "photo_ord"), per_trip=4, cropped=0.5).orderBy("photo_ord").collect()
    assert [r["trip_ord"] for r in rows[:9]] == [0] * 4 + [1] * 4 + [2] and len({r["uuid"] for r in rows}) == 4000
    gaps = [(b["date"] - a["date"]).total_seconds() / 3600 for a, b in zip(rows, rows[1:], strict=False)]
    assert gaps[:5] == [2, 2, 2, 162, 2]
    assert abs(sum(r["width"] * 2 != r["height"] * 3 for r in rows) / 4000 - 0.5) < 0.04


def test_progress_counts_never_fall_and_end_complete(spark):
    records = demo.demo_members(demo.demo_clusters(spark.range(30).withColumnRenamed("id", "cluster_ord")))
    records = records.select("uuid", "date", "derivative_path", F.lit(None).cast("string").alias("burst_key"), F.lit(False).alias("is_shared"), F.lit("m").alias("mod_date"))
    near = lambda photos: photos.withColumn("embedding", F.array(F.col("bucket_id").cast("float"), F.col("member_ord").cast("float") / 100))
    values = {n: F.lit(0.5) for n in ("laplacian", "exposure", "faces", "framing", "horizon", "capture_quality", "smiling")} | {"width": F.lit(480), "height": F.lit(360)}
    told = []
    sc = spark.sparkContext
    sc.setJobGroup("mine", "my own work")
    try:
        got = pipeline.run_pipeline(records, near, lambda p: p.withColumns(values), ClusterSettings(), progress=lambda *x: told.append(x))
        assert sc.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(k, None)
    assert got.clusters.count() == 30
    assert list(dict.fromkeys(s for s, _, _ in told)) == ["buckets", "vectors", "groups", "scores", "ranks"]
    for stage in {s for s, _, _ in told}:
        counts = [(d, t) for s, d, t in told if s == stage]
        assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(counts, counts[1:], strict=False)) and all(d <= t for d, t in counts)
        assert counts[-1][0] == counts[-1][1] > 0


def test_progress_faults_are_raised_and_a_failed_block_reports_no_end(spark):
    def refuse(*_):
        raise KeyError("told")

    with pytest.raises(KeyError, match="told"), watched(spark, "s", refuse):
        spark.range(10).count()
    told = []
    with pytest.raises(ZeroDivisionError), watched(spark, "s", lambda *x: told.append(x)):
        1 / 0  # noqa: B018
    assert told == []


def test_marks_of_a_changed_library_and_members(spark):
    marks = spark.createDataFrame([("k", "a", "keep"), ("k", "b", "cull"), ("l", "c", "cull")], "cluster_key string, photo_id string, mark string")
    library = spark.createDataFrame([("a",), ("a",), ("c",)], "photo_id string")
    assert [tuple(r) for r in decisions.voided_marks(marks, library).collect()] == [("k", "b", "cull")]
    members = spark.createDataFrame([("k", "a"), ("k", "d"), ("l", "c"), ("m", "b")], "cluster_key string, photo_id string")
    assert sorted(map(tuple, decisions.member_mismatch(marks, members).collect())) == [("k", "b", "unknown"), ("k", "d", "missing"), ("m", "b", "missing")]


def test_resuming_needs_a_decision_under_the_present_settings(spark):
    of = lambda *s: spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(s)], "cluster_key string, status string")
    assert decisions.resume_allowed(of()) and decisions.resume_allowed(of("superseded", "kept"))
    assert not decisions.resume_allowed(of("superseded", "superseded")) and decisions.resume_allowed(of("superseded"), new_session=True)


def test_sweep_overrides_and_unknown_album_entries(spark):
    swept = spark.createDataFrame([("a", "screenshots"), ("b", "screenshots")], "uuid string, category string")
    got = {(r["uuid"], r["kind"]): r["target"] for r in sweep.sweep_actions(swept, {"b": "Receipts", "zz": "Nowhere"}).collect()}
    assert got == {("a", "album"): "Cull/Old Screenshots", ("b", "album"): "Cull/Receipts", ("a", "keyword"): "cull", ("b", "keyword"): "cull"}
    drafts = spark.createDataFrame([(1, ["a", "x", "x"]), (2, ["b"]), (3, [])], "album_id int, sequence array<string>")
    assert [tuple(r) for r in albums.unknown_entries(drafts, swept).collect()] == [(1, "x")]
