import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fernsieve.operators import calibration, decision_log, decisions, exports, sampling
from fernsieve.schema import ClusterSettings, settings_digest, settings_document


def test_state_from_snapshots_equals_a_full_replay_and_reads_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decision_log, "SEGMENT", 20)
    monkeypatch.setattr(decision_log, "BUCKETS", 8)
    rng, log = random.Random(3), decision_log.DecisionLog(spark, str(tmp_path / "log"))
    assert log.state().count() == 0 and log.take_snapshot() == 0
    at = 0
    for step in range(6):
        ids = range(at + 1, at + 16)
        at += 15
        log.append(spark.createDataFrame([(i, rng.randrange(12)) for i in ids], "batch_id int, cluster_key int"))
        log.append(undos=spark.createDataFrame([(rng.randrange(1, at + 1),) for _ in range(4)], "batch_id int"))  # old ones too, and some twice
        if step in (2, 4):
            log.take_snapshot()
        want = decisions.current_state(log.batches(), log.undos())
        assert sorted(map(tuple, log.state().collect())) == sorted((r["cluster_key"], r["batch_id"]) for r in want.collect())
    assert log.snapshots() == [2, 3] and log.take_snapshot() == 4
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).collect()}
    read = files(log.batches(log.snapshots()[-1]))
    assert read and len(read) < len(files(log.batches())) and not any("segment=0" in f for f in read)
    assert "(segment#" in (plan := log.state()._jdf.queryExecution().executedPlan().toString()) and ">= 4)" in plan  # by the folders' names
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([(at, 1)], "batch_id int, cluster_key int"))
    everything = spark.range(1, at + 1).select(F.col("id").alias("batch_id"))
    log.append(undos=everything)
    assert log.state().count() == 0 and log.undos().count() > at


def made(spark, n):
    rng = random.Random(5)
    clusters = [(k, rng.choice([2, 3, 6, 12]), f"u{k}-0", k % 3 == 0, rng.choice([None, rng.random()]), rng.random(), k % 2 == 0, ["faces"] if k % 4 == 0 else []) for k in range(n)]
    members = [(c[0], m, f"u{c[0]}-{m}", "2025-03-01 10:00:00" if m else None, f'/d/"{m}"', c[2], 0.25 * m, None if m == 1 else 0.5) for c in clusters for m in range(c[1])]
    clusters = spark.createDataFrame(clusters, "cluster_id int, size int, winner string, ambiguous boolean, diameter double, median_distance double, sharpness_available boolean, dropped array<string>")
    members = spark.createDataFrame(members, "cluster_id int, member_ord int, uuid string, date string, derivative_path string, winner string, distance_to_winner double, total double")
    return clusters, members.withColumn("date", F.to_timestamp("date")).withColumn("sub_scores", F.struct(F.col("total").alias("sharpness"), F.lit(None).cast("double").alias("facing")))


def joined(path):
    return "".join(open(os.path.join(path, n), encoding="utf-8").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_calibration_is_one_document_of_many_parts(spark, tmp_path):
    clusters, members = made(spark, 90)
    lines = calibration.document_lines(clusters.repartition(5), members, ClusterSettings(), "my.toml", limit=30)
    calibration.write_calibration(lines.repartition(4), str(tmp_path / "c.json"))
    doc = json.loads(joined(tmp_path / "c.json"))
    sample = {r["cluster_id"]: r for r in sampling.stratified_sample(clusters, 30, "cluster_id").collect()}
    rows = {r["cluster_id"]: r for r in clusters.collect()}
    assert list(doc) == ["config", "population", "strata", "clusters"] and doc["config"]["source"] == "my.toml"
    assert doc["config"]["digest"] == settings_digest(settings_document(ClusterSettings())) and doc["population"] == exports.population(clusters, clusters.where(F.col("cluster_id").isin(list(sample)))).first().asDict()
    assert doc["population"]["sampled"] == len(doc["clusters"]) == len(sample) == sum(doc["strata"].values()) == 30
    for told, key in zip(doc["clusters"], sorted(sample)):  # in order of capture
        c = rows[key]
        assert list(told) == ["size", "winner_uuid", "is_ambiguous", "diameter", "median_distance", "sharpness_available", "dropped_criteria", "members"]
        assert [told["size"], told["winner_uuid"], told["is_ambiguous"], told["diameter"], told["median_distance"], told["sharpness_available"], told["dropped_criteria"]] == list(c)[1:]
        assert [m["uuid"] for m in told["members"]] == [f"u{key}-{m}" for m in range(c["size"])] and told["members"][0]["is_winner"] and told["members"][0]["distance_to_winner"] is None
        assert list(told["members"][1]) == ["uuid", "date", "derivative_path", "is_winner", "distance_to_winner", "total", "sub_scores"]
        assert told["members"][1] == {"uuid": f"u{key}-1", "date": "2025-03-01T10:00:00.000000", "derivative_path": '/d/"1"', "is_winner": False, "distance_to_winner": 0.25, "total": None, "sub_scores": {"sharpness": None, "facing": None}}
        assert told["members"][0]["date"] is None


def test_calibration_of_everything_and_of_nothing(spark, tmp_path):
    clusters, members = made(spark, 7)
    calibration.write_calibration(calibration.document_lines(clusters, members, limit=None), str(tmp_path / "all"))
    whole = json.loads(joined(tmp_path / "all"))
    assert len(whole["clusters"]) == 7 == whole["population"]["clusters"] and whole["strata"] == {} and whole["config"]["source"] == calibration.BUILT_IN
    calibration.write_calibration(calibration.document_lines(clusters.limit(0), members, limit=10), str(tmp_path / "none"))
    none = json.loads(joined(tmp_path / "none"))
    assert none["clusters"] == [] and none["population"]["photos_in_clusters"] == 0
