import json
import os
import sys
import threading

import pytest
from pyspark import cloudpickle

from fernsieve.operators import actions
from fernsieve.sources import cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
KIND = "uuid string, mod_key string, analysis_key string, payload string"


class Library:
    """A writer that notes each act in a file, and dies or refuses where it is told to."""

    def __init__(self, at, dies=None, refuses=None):
        self.at, self.dies, self.refuses = str(at), dies, refuses

    def __call__(self, photo, action):
        if photo == self.refuses:
            raise RuntimeError("refused")
        if self.dies == ("before", photo):
            os._exit(1)
        with open(self.at, "a") as f:
            f.write(json.dumps([photo, action]) + "\n")
        if self.dies == ("after", photo):
            os._exit(1)

    def landed(self, photo, action):
        return [photo, action] in self.acts()

    def acts(self):
        return [json.loads(x) for x in open(self.at)] if os.path.exists(self.at) else []


def counts(df):
    return {r["status"]: r["n"] for r in df.collect()}


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_killed_task_and_a_second_run_act_once(spark, tmp_path, moment):
    pending = spark.createDataFrame([(f"p{k}", a) for k in range(20) for a in ("album:x", "keyword:y")], "photo_id string, action string")
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    with pytest.raises(Exception, match="[Pp]ython"):
        actions.apply_actions(pending, Library(log, dies=(moment, "p7")), ledger, dry_run=False, session_id="one").count()
    begun = Library(log).acts()
    assert 0 < len(begun) < 40 and len({tuple(a) for a in begun}) == len(begun)
    unsure = counts(actions.apply_actions(pending, Library(log), ledger, dry_run=False, session_id="two"))
    assert unsure["in_doubt"] >= 1  # nobody can say what came of it, so it is left alone
    sure = Library(log)
    assert counts(actions.apply_actions(pending, sure, ledger, dry_run=False, session_id="three", landed=sure.landed)) == {"done": unsure["in_doubt"]}
    acts = [tuple(a) for a in sure.acts()]
    assert len(acts) == len(set(acts)) == 40  # each once, whether it died before it acted or after
    rows = actions.read_ledger(spark, ledger).collect()
    assert {(r["photo_id"], r["action"]) for r in rows} == set(acts) and {r["session_id"] for r in rows} == {"one", "two", "three"}
    assert actions.apply_actions(pending, Library(log, dies=("before", "p1")), ledger, dry_run=False).count() == 0


def test_refused_actions_are_open_again_and_twins_act_once(spark, tmp_path):
    pending = spark.createDataFrame([(k, "favorite") for k in range(12)] * 2, "photo_id int, action string")
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    assert counts(actions.apply_actions(pending, Library(log, refuses=5), ledger, dry_run=False)) == {"done": 11, "failed": 1}
    assert counts(actions.apply_actions(pending, Library(log), ledger, dry_run=False)) == {"done": 1} and len(Library(log).acts()) == 12
    other, twins = str(tmp_path / "other"), []
    journal = actions.FolderJournal(str(tmp_path / "journal"))
    run = lambda: twins.append(counts(actions.apply_actions(pending, Library(tmp_path / "twins"), other, dry_run=False, journal=journal)))
    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    acts = [tuple(a) for a in Library(tmp_path / "twins").acts()]
    assert len(acts) == len(set(acts)) == 12 and actions.read_ledger(spark, other, "int").count() == 12


def files(folder):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(folder) for name in names)


def test_many_upserts_leave_few_files_and_the_last_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKETS", 3)
    monkeypatch.setattr(cache, "MOST_FOLDERS", 3)
    at, want = cache.cache_folder(str(tmp_path), "scores", 1), {}
    for k in range(24):
        rows = [(f"u{(k * 5 + j) % 17}", "m", f"/d/{j % 2}", f"{k}-{j}") for j in range(4)]
        cache.put(spark.createDataFrame(rows, KIND), at)
        want |= {r[:3]: r[3] for r in rows}
    got = cache.get(spark, at, KIND)
    assert {tuple(r)[:3]: r["payload"] for r in got.collect()} == want and got.count() == len(want)
    assert files(at) <= 3 * 3 * (cache.KEPT_MANIFESTS + 1) and len(cache.Store(spark, at).manifests()) == cache.KEPT_MANIFESTS
    asked = spark.createDataFrame([("u3", "m", "/d/0"), ("new", "m", "/d/0")], "uuid string, mod_key string, analysis_key string")
    some = cache.get(spark, at, KIND, asked)
    hits, misses = cache.hits_and_misses(asked, some)
    assert len(some.inputFiles()) < len(got.inputFiles()) and {r["uuid"] for r in misses.collect()} >= {"new"}
    assert {tuple(r)[:3]: r["payload"] for r in hits.collect()} == {k: v for k, v in want.items() if k == ("u3", "m", "/d/0")}


def test_a_failed_write_changes_nothing_and_writers_do_not_lose_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKETS", 2)
    at = cache.cache_folder(str(tmp_path), "scores", 1)
    cache.put(spark.createDataFrame([("a", "", "k", "first")], KIND), at)
    before = cache.Store(spark, at).now()
    with pytest.raises(Exception):
        cache.put(spark.createDataFrame([("a", "", "k", "second")], KIND).selectExpr("uuid", "mod_key", "analysis_key", "cast(raise_error('lost') AS string) AS payload"), at)
    monkeypatch.setattr(cache.Store, "switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        cache.put(spark.createDataFrame([("a", "", "k", "third")], KIND), at)
    monkeypatch.undo()
    monkeypatch.setattr(cache, "BUCKETS", 2)
    assert cache.Store(spark, at).now() == before and [r["payload"] for r in cache.get(spark, at, KIND).collect()] == ["first"]
    writers = [threading.Thread(target=cache.put, args=(spark.createDataFrame([(f"w{k}", "", "k", str(k))], KIND), at)) for k in range(4)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert {r["uuid"] for r in cache.get(spark, at, KIND).collect()} == {"a", "w0", "w1", "w2", "w3"}
    cache.put(spark.createDataFrame([], KIND), at)
    assert cache.get(spark, str(tmp_path / "none"), KIND).count() == 0
