import datetime as dt
import functools
import itertools
import json
import statistics

import pytest
from pyspark.sql import functions as F

from fernsieve.functions import imaging, scalar
from fernsieve.operators import audit, exports, pipeline, review, sentences, sessions
from fernsieve.operators.vectors import complete_linkage
from fernsieve.schema import RECORDS, ClusterSettings
from fernsieve.sources import records

WEIGHTS = {"sharpness": 0.35, "faces": 0.35, "exposure": 0.15, "odd": 0.15, "facing": 0.0}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scales_and_placement(spark):
    scale = lambda *x: one(spark, imaging.largest_scale(*map(F.lit, x)))
    assert scale(1600, 1000, 800, 500) == 2.0 and scale(400, 100, 800, 500) == 0.5 and scale(0, 100, 800, 500) is None
    assert one(spark, imaging.shared_scale(F.array(F.lit(2.0), F.lit(None), F.lit(1.5)))) == 1.5
    assert one(spark, imaging.can_magnify(F.array(F.lit(None).cast("double")))) is False
    assert one(spark, imaging.unlike_widths(F.array(F.lit(100), F.lit(136)))) is True and one(spark, imaging.unlike_widths(F.array(F.lit(100), F.lit(0)))) is False
    at = one(spark, imaging.pan_placement(*map(F.lit, (1600, 1000, 800, 500, 2.0, 0.0, 1.0))))
    assert (at["left"], at["top"], at["x"], at["y"]) == (0.0, -500.0, 0.25, 0.75)
    small = one(spark, imaging.pan_placement(*map(F.lit, (1600, 1000, 800, 500, 0.5, 0.0, 1.0))))
    assert (small["left"], small["top"], small["x"]) == (200.0, 125.0, 0.5)


def slow_evidence(members, margin):
    """(uuid -> sentences) of one cluster; members are (uuid, scores)."""
    common = [n for n in WEIGHTS if WEIGHTS[n] > 0 and all(s[n] is not None for _, s in members)]
    add = lambda values: functools.reduce(lambda a, b: a + b, values, 0.0)  # noqa: E731  in order, without correction
    weight = add(WEIGHTS[n] for n in common)
    total = {u: add(WEIGHTS[n] * s[n] for n in common) / weight if weight else 0.0 for u, s in members}
    order = sorted(members, key=lambda m: (-total[m[0]], m[0]))
    winner, second = order[0], order[1]
    close = total[winner[0]] - total[second[0]] < margin
    out = {}
    for uuid, s in members:
        partner = second if uuid == winner[0] else winner
        name = "the next-best take" if uuid == winner[0] else "the proposed keeper"
        deltas = {n: s[n] - partner[1][n] for n in common}
        told = sorted((n for n in common if abs(deltas[n]) >= 0.005), key=lambda n: (-round(abs(WEIGHTS[n] * deltas[n]), 9), n))[:3]
        lines = []
        for n in told:
            if n == "sharpness":
                values = [x["sharpness"] for _, x in members]
                best, low = max(values), min(values)
                if s[n] < best:
                    lines.append(f"Softer than the sharpest take — {s[n] / best:.2f}× its detail.")
                elif low <= 0:
                    lines.append(f"Sharpest of the {len(values)} takes — the softest has no measurable detail.")
                elif best / low < 1.05:
                    lines.append(f"Sharpest of the {len(values)} takes, though only just — {best / low:.2f}× the detail of the softest.")
                else:
                    lines.append(f"Sharpest of the {len(values)} takes — {best / low:.2f}× the detail of the softest.")
            elif n in sentences.BETTER_WORSE:
                lines.append(sentences.BETTER_WORSE[n][deltas[n] <= 0].format(partner=name))
            else:
                lines.append(f"Scores {'higher' if deltas[n] > 0 else 'lower'} on {n} than {name} ({s[n]:.3f} against {partner[1][n]:.3f}).")
        if common and not told:
            lines.append(f"Nothing measured here separates this take from {name}.")
        if close and uuid in (winner[0], second[0]):
            gap = total[winner[0]] - total[second[0]]
            lines.append(f"Too close to call — only {gap:.3f} " + ("ahead of the next take." if uuid == winner[0] else "behind the proposed keeper."))
        elif uuid == winner[0]:
            lines.append(f"The scorer's pick, {total[uuid] - total[second[0]]:.3f} ahead of the next take.")
        else:
            lines.append(f"Behind the proposed keeper by {total[winner[0]] - total[uuid]:.3f}.")
        out[uuid] = lines
    return out


def test_sentences_against_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    for cluster in range(40):
        levels = [0.0, 0.25, 0.5, 0.503, 0.96, 1.0]
        for k in range(1 if cluster == 0 else rng.randrange(2, 5)):
            value = lambda: None if rng.random() < 0.06 else rng.choice(levels)
            rows.append((cluster, f"u{cluster}-{k}", value(), value(), value(), value()))
    table = spark.createDataFrame(rows, "cluster_id int, uuid string, sharpness double, faces double, exposure double, odd double")
    got = {}
    for r in sentences.evidence(table, WEIGHTS).orderBy("place").collect():
        got.setdefault(r["uuid"], []).append(r["text"])
    want = {}
    for cluster in range(1, 40):
        want |= slow_evidence([(r[1], dict(zip(("sharpness", "faces", "exposure", "odd"), r[2:])) | {"facing": None}) for r in rows if r[0] == cluster], 0.05)
    assert got == want
    names = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "x array<string>")
    assert [r[0] for r in names.select(sentences.prose_list(F.col("x"))).collect()] == ["a", "a and b", "a, b and c", ""]


def photo_rows(n=24):
    start = dt.datetime(2024, 5, 1, 12)
    rows = []
    for k in range(n):
        at = start + dt.timedelta(hours=k // 6, seconds=20 * (k % 6))
        rows.append((f"p{k:02d}", None if k == 20 else at, k == 7, f"m{k}", None if k == 13 else f"/d/{k}", None))
    return rows


PHOTOS = "uuid string, date timestamp, is_shared boolean, mod_date string, derivative_path string, burst_key string"


def vector(uuid):
    k = int(uuid[1:])
    return [float(k // 6 * 10 + (k % 6) // 3), float(k % 3) * 0.1]


def test_whole_pipeline_against_brute_force_and_its_cache(spark, tmp_path):
    photos = spark.createDataFrame(photo_rows(), PHOTOS)
    asked = {"vectors": [], "scores": []}

    def vectors_of(wanted):
        asked["vectors"].append(sorted(r["uuid"] for r in wanted.collect()))
        k = F.substring("uuid", 2, 9).cast("int")
        return wanted.withColumn("embedding", F.array((F.floor(k / 6) * 10 + F.floor(k % 6 / 3)).cast("float"), (k % 3 * 0.1).cast("float")))

    def analyse(wanted):
        asked["scores"].append(sorted(r["uuid"] for r in wanted.collect()))
        k = F.substring("uuid", 2, 9).cast("double")
        none = F.lit(None).cast("double")
        return wanted.withColumns({"laplacian": k + 1, "width": F.lit(48), "height": F.lit(36), "exposure": (k % 5) / 5, "faces": F.when(k != 1, k % 7 / 7), "framing": none, "horizon": none, "capture_quality": none, "smiling": none})

    cfg = ClusterSettings(similarity_threshold=0.5)
    got = pipeline.run_pipeline(photos, vectors_of, analyse, cfg, str(tmp_path))
    members = got.members.orderBy("cluster_id", "member_ord").collect()
    # by hand: photos within 90 seconds that are not shared and have a raster, then complete linkage of each bucket
    usable = [r for r in photo_rows() if r[1] is not None and not r[2] and r[4]]
    want = []
    for _, bucket in itertools.groupby(usable, key=lambda r: r[1].hour):
        names = [r[0] for r in bucket]
        x = [vector(u) for u in names]
        import numpy as np

        d = np.array([[sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 for q in x] for p in x])
        want += [[names[i] for i in m] for m in complete_linkage(names, d, 0.5)]
    clusters = [[m["uuid"] for m in g] for _, g in itertools.groupby(members, key=lambda m: m["cluster_id"])]
    assert clusters == want and len(want) > 4
    assert asked["vectors"] == [[r[0] for r in usable]] and asked["scores"] == [sorted(sum(want, []))]
    about = {r["cluster_id"]: r for r in got.clusters.collect()}
    for _, g in itertools.groupby(members, key=lambda m: m["cluster_id"]):
        g = list(g)
        apart = [sum((a - b) ** 2 for a, b in zip(vector(p["uuid"]), vector(q["uuid"]))) ** 0.5 for p, q in itertools.combinations(g, 2)]
        row = about[g[0]["cluster_id"]]
        assert row["diameter"] == pytest.approx(max(apart)) and row["median_distance"] == pytest.approx(statistics.median(apart)) and row["size"] == len(g) and row["sharpness_available"]
        for m in g:
            assert (m["distance_to_winner"] is None) == (m["uuid"] == m["winner"])
        if any(m["uuid"] == "p01" for m in g):
            assert "faces" in row["dropped"]
    pipeline.run_pipeline(photos, vectors_of, analyse, cfg, str(tmp_path))
    assert asked["vectors"][1:] == [[]] and asked["scores"][1:] == [[]]  # the second run reads the cache alone
    changed = photos.withColumn("mod_date", F.when(F.col("uuid") == "p02", "new").otherwise(F.col("mod_date")))
    pipeline.run_pipeline(changed, vectors_of, analyse, cfg, str(tmp_path))
    assert asked["vectors"][2] == ["p02"] and asked["scores"][2] == ["p02"]
    assert pipeline.run_pipeline(photos.limit(0), vectors_of, analyse, cfg).members.count() == 0


def test_session_document_and_gate(spark):
    scores = spark.createDataFrame([("c", "a", 1.0, 0.5), ("c", "b", 0.4, 0.5)], "cluster_id string, uuid string, sharpness double, exposure double")
    members = spark.createDataFrame([("c", 1, "b", "/x"), ("c", 0, "a", "/y")], "cluster_id string, member_ord int, uuid string, display_path string")
    displays = spark.createDataFrame([("a", 600), ("b", None)], "uuid string, long_side int")
    about = spark.createDataFrame([("c", 2)], "cluster_id string, size int")
    (row,) = review.session_document(scores, members, displays, about, {"sharpness": 0.5, "exposure": 0.5}).collect()
    doc = json.loads(row["document"])
    assert [m["uuid"] for m in doc["members"]] == ["a", "b"] and "display_path" not in doc["members"][0]
    assert doc["members"][0]["display"] == {"available": True, "long_side": 600} and doc["members"][1]["display"]["available"] is False
    assert doc["proposed"] == {"a": "keep", "b": "cull"} and "no-display" in doc["notes"] and doc["ranking_basis" if "ranking_basis" in doc else "basis"] is None
    assert doc["members"][0]["evidence"][-1] == "The scorer's pick, 0.300 ahead of the next take."
    marks = spark.createDataFrame([("k", "a", "keep"), ("k", "b", "cull"), ("k", "z", "cull")], "cluster_key string, uuid string, mark string")
    staged = review.staged_rows(marks, members.withColumnRenamed("cluster_id", "cluster_key").withColumn("cluster_key", F.lit("k"))).collect()
    assert [(r["uuid"], r["keepers"]) for r in staged] == [("b", ["a"])]
    assert review.may_write(review.confirm("d", "d"), "d") and not review.may_write(None, "d") and not review.may_write("d", "e")
    with pytest.raises(review.Refused):
        review.confirm("old", "new")
    review.same_library("/a ", "/a")
    for pair in (("/a", "/b"), (None, "/a"), ("/a", " ")):
        with pytest.raises(review.Refused):
            review.same_library(*pair)


def test_albums_orders_and_reports(spark):
    now = dt.datetime(2024, 1, 2)
    albums = spark.createDataFrame([("x", "X", "4x6", ["a"], dt.datetime(2024, 1, 1), now), ("y", "Y", "5x7", [], now, now)], "album_id string, title string, print_size string, sequence array<string>, created_at timestamp, updated_at timestamp")
    pool = spark.createDataFrame([("a",), ("b",)], "uuid string")
    assert [r["album_id"] for r in review.newest_albums(albums).collect()] == ["y", "x"]
    saved = {r["album_id"]: r["sequence"] for r in review.save_album(albums, "x", ["b", "a"], pool, now).collect()}
    assert saved == {"x": ["b", "a"], "y": []}
    assert review.save_album(albums, "z", ["a"], pool, now, "Z", "8x10").count() == 3
    for bad in (("x", ["c"]), ("z", ["a"], "Z", "9x9"), ("x", ["a"], "X", "4x6")):
        with pytest.raises(review.Refused):
            review.save_album(albums, bad[0], bad[1], pool, now, *bad[2:])
    with pytest.raises(KeyError):
        review.save_album(albums, "none", ["a"], pool, now)
    ledger = spark.createDataFrame([(2, "b", "k"), (1, "b", "k"), (1, "a", "z"), (1, "a", "k")], "applied_at int, photo_id string, action string")
    assert [tuple(r) for r in review.ledger_rows(ledger).collect()] == [(1, "a", "k"), (1, "a", "z"), (1, "b", "k"), (2, "b", "k")]
    assert [r["cluster_id"] for r in review.newest_first(spark.range(3).withColumnRenamed("id", "cluster_id")).collect()] == [2, 1, 0]
    report = review.write_report(spark.createDataFrame([("done", 3), ("failed", 1)], "status string, n bigint")).first().asDict()
    assert report["done"] == 3 and report["failed"] == 1 and report["gone"] == 0


def test_audit_tables_and_document(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2023, 1, 1), False, 2048, None, 0, True, False), ("b", None, True, 1, 3.0, 1, False, True)], "uuid string, date timestamp, is_video boolean, filesize bigint, duration_seconds double, album_count int, is_favorite boolean, is_hidden boolean")
    shown = exports.audit_tables(rows, date="date")
    assert {r["what"]: r["value"] for r in shown["overview"].collect()}["Total items"] == "2" and [tuple(r) for r in shown["by_year"].collect()] == [("2023", 1, "2.0 KB")]
    document = exports.audit_document(rows, date="date")
    exports.write_document(document, str(tmp_path / "audit"))
    got = json.loads(spark.read.text(str(tmp_path / "audit")).first()[0])
    assert got["by_year"] == {"2023": {"count": 1, "size_bytes": 2048}} and got["by_duration"]["<5s"]["count"] == 1 and got["items"] == 2
    assert audit.summary_json(rows.withColumnRenamed("date", "date_local"), sessions.gap_run_count(rows)).count() == 1


def test_records_of_a_source_and_settings_search(spark, tmp_path):
    source = spark.createDataFrame([("a", None, True, 5, (2.5, "cam"), ["x"], [(4, 3, "/s"), (8, 6, "/l")]), ("b", None, False, 6, None, [], [])], "uuid string, date timestamp, ismovie boolean, original_filesize bigint, exif_info struct<duration:double,camera_model:string>, albums array<string>, derivatives array<struct<w:int,h:int,path:string>>")
    a, b = records.records_of(source, with_derivatives=True).orderBy("uuid").collect()
    assert list(a.asDict()) == RECORDS.names and (a["duration_seconds"], a["device"], a["album_count"], a["derivative_path"], a["display_path"]) == (2.5, "cam", 1, "/s", "/l")
    assert (b["duration_seconds"], b["device"], b["album_count"], b["is_shared"], b["derivative_path"]) == (None, None, 0, False, None)
    assert records.find_settings(cwd=tmp_path, home=tmp_path) is None
    (tmp_path / ".config").mkdir()
    (tmp_path / ".config" / records.SETTINGS_FILE).write_text("")
    assert records.find_settings(cwd=tmp_path, home=tmp_path).parent.name == ".config"
    (tmp_path / records.SETTINGS_FILE).write_text("")
    assert records.find_settings(cwd=tmp_path, home=tmp_path).parent == tmp_path
    with pytest.raises(FileNotFoundError):
        records.find_settings(tmp_path / "none")
    source.write.parquet(str(tmp_path / "lib" / "photos.parquet"))
    source.select("uuid").write.parquet(str(tmp_path / "lib" / "albums.parquet"))
    assert records.open_library(spark, None, str(tmp_path / "lib"))["photos"].count() == 2
    with pytest.raises(FileNotFoundError):
        records.open_library(spark)


def test_scalar_functions_by_hand(spark):
    assert [one(spark, scalar.likeness(F.lit(x))) for x in (0.1, 0.2, 0.3, 0.9)] == ["near-identical", "very similar", "similar", "loosely similar"]
    assert [one(spark, scalar.human_size(F.lit(x))) for x in (5, 2048, 5 << 20, 3 << 30, 1 << 50)] == ["5.0 B", "2.0 KB", "5.0 MB", "3.0 GB", "1024.0 TB"]
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (0.5, 0.0), (1.0, 1.0))])
    assert one(spark, scalar.eye_aspect_ratio(points, F.lit(2.0))) == 2.0 and one(spark, scalar.smile_curvature(points, F.lit(1.0))) == pytest.approx(1 / 3)
    assert one(spark, scalar.album_name(F.lit("Cull/Best"))) == "Best"
