import collections
import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from fernsieve.llm import common, mixing, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, size int, copy string, _part int"


def targets_by_hand(sizes, weights, share=1.0, repeats=3):
    """Deals the budget again and again: who is above their cap stops there."""
    left, open_, out = int(sum(sizes.values()) * share), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / total >= repeats * sizes[s]}
        if not above:
            return out | {s: left * weights[s] / total for s in open_}
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= repeats * sizes[s]
        open_ -= above
    return out


def mix_by_hand(docs):
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    sized = [(i, len(common_words(t)), s) for i, t, s in docs]
    sizes = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weights = {s: k % 3 + 1 for k, s in enumerate(sources)}
    targets, copies = targets_by_hand(sizes, weights), []
    for s in sources:
        at = 0
        for digest, n, i in sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), n, -1 if i is None else i) for i, n, x in sized if x == s and n):
            copies += [((at + n + c * sizes[s]) / targets[s], sources.index(s), c, at, n, i) for c in range(3)]
            at += n
    taken, left = collections.Counter(), sum(sizes.values())
    for *_, n, i in sorted(copies):
        taken[i] += min(n, left)
        left -= min(n, left)
    return sizes, targets, taken


def common_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def some_documents():
    rng = random.Random(3)
    docs = [(k, " ".join("w" for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "\x1c", "\x0b \x0c"]), "hot" if k % 3 else rng.choice(["a", "b", None, "tiny", "é"])) for k in range(400)]
    return docs + [(400, None, "a"), (401, "", "empty"), (402, "long " * 3000, "b"), (403, "one", "tiny2")]


def test_mix_is_that_of_the_hand_and_targets_are_dealt_again(spark):
    docs = some_documents()
    rows = spark.createDataFrame([(*d, 7, "mine", 1) for d in docs], SCHEMA)  # columns that clash are left alone
    taken, plan = mixing.mix_sources(rows)
    sizes, targets, by_hand = mix_by_hand(docs)
    got = taken.collect()
    assert len(got) == len(docs) and {r["key"]: r["taken"] for r in got} == {i: by_hand.get(i, 0) for i, _, _ in docs}
    for r in got:
        assert r["size"] == len(common_words(docs[r["key"]][1])) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
    assert targets["tiny2"] == 3.0 and sum(r["taken"] for r in got) == sum(sizes.values())
    ordered = sorted(plan.collect(), key=lambda r: r["place"])
    place = 0
    for a, b in zip(ordered, ordered[1:] + [None]):  # the mix has no gap and its virtual time never goes back
        assert a["place"] == place and (b is None or a["finish"] <= b["finish"])
        place += a["taken"]
    assert sorted(map(tuple, mixing.mix_sources(rows.repartition(7))[0].collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_of_repeated_rows_null_keys_and_nothing(spark):
    rows = [(1, "a b c", "x")] * 40 + [(None, "a b", None)] * 20 + [(2, None, "y")] * 3
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))[0].collect()
    assert len(got) == 63 and sum(r["taken"] for r in got) == 160 and all(r["taken"] == 0 == r["target"] for r in got if r["source"] == "y")
    assert sum(r["taken"] for r in got if r["source"] is None) == 120 and [r["target"] for r in got if r["source"] is None][0] == 120.0
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(empty)[0].count() == mixing.mix_sources(empty)[1].count() == 0
    blank = spark.createDataFrame([(1, "", "x"), (2, None, None)], "doc_id bigint, text string, source string")
    assert sorted(tuple(r)[2:] for r in mixing.mix_sources(blank)[0].collect()) == [(0, 0, 0.0, 0)] * 2


def test_mix_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.QUERIES["op11_mixing"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(mixing.ORACLE_SQL).fetchall(), key=str)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_running_sums_cross_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), k, rng.randrange(9)) for k in range(3000)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g int, k int, v int").repartition(5)
        got = {(r["g"], r["k"]): (r["s"], r["n"]) for r in common.running_sums(df, "g", ["k"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    total, count = collections.Counter(), collections.Counter()
    for g, k, v in rows:
        total[g] += v
        count[g] += 1
        assert got[g, k] == (total[g], count[g])
