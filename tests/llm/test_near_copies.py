import os
import random
import subprocess
import sys

import numpy as np

import corpus_pipeline
from fernsieve.llm import common, shingles, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def word_shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def likeness(a, b):
    x, y = word_shingles(a), word_shingles(b)
    return len(x & y) / len(x | y)


def distance(a, b):
    return (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()


def chain():
    """Three texts: SimHash alone links the first two, shingles alone the last two."""
    rng = random.Random(132)
    base = [f"s{rng.randrange(9000)}" for _ in range(200)]
    near = list(base)
    for at in range(10, 200, 28):
        near[at] = f"t{rng.randrange(9000)}"
    return " ".join(base), " ".join(near), " ".join(near + [f"u{rng.randrange(9000)}" for _ in range(30)])


def test_pipeline_drops_what_simhash_links_and_what_it_misses(spark):
    a, b, c = chain()
    assert distance(a, b) <= simhash.RADIUS < min(distance(b, c), distance(a, c)) and max(likeness(a, b), likeness(a, c)) < 0.8 <= likeness(b, c)
    other = " ".join(f"o{k}" for k in range(90))
    rows = [(4, c), (3, b), (2, a), (2, a), (None, a), (7, other), (None, other + " x"), (9, "short")]
    for some, want in ((rows, [2, 7, 9]), ([rows[0], rows[2]], [2, 4])):
        docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in some], DOCS)
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def test_links_known_beforehand_leave_no_pair_out(spark, monkeypatch):
    """A pair of two joined groups is found although the groups' other members are unlike."""
    monkeypatch.setattr(shingles, "FEW", 1)
    rng = random.Random(3)
    texts, links = [], []
    for k in range(12):
        base = [f"v{k}x{rng.randrange(9000)}" for _ in range(100)]
        edits = [list(base) for _ in range(4)]
        for words, n in zip(edits, (0, 3, 5, 3)):
            for at in rng.sample(range(100), n):
                words[at] = f"n{rng.randrange(9000)}"
        links += [(len(texts) + j, 2 * k + j // 2) for j in range(4)]
        texts += [" ".join(w) for w in edits]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS).withColumn("row", common.row_key())
    linked = docs.join(spark.createDataFrame(links, "doc_id bigint, class int"), "doc_id").select("row", "class")
    label = {k: 2 * (k // 2) for k in range(len(texts))}
    for x in range(len(texts)):
        for y in range(x):
            if likeness(texts[x], texts[y]) >= 0.8:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
    got = {}
    for r in shingles.similar_classes(docs.select("row", "doc_id", "text"), linked=linked).collect():
        got.setdefault(r["component"], []).append(r["doc_id"])
    want = {}
    for k, v in label.items():
        want.setdefault(v, []).append(k)
    assert sorted(map(sorted, got.values())) == sorted(want.values()) and len(want) < 24


def test_only_texts_that_are_asked_for_reach_python(spark, monkeypatch):
    docs = spark.range(50).selectExpr("CAST(CAST(id % 40 AS STRING) AS BINARY) AS row", "concat_ws(' ', 'a', 'b', CAST(id % 40 AS STRING), 'c', 'd', 'e') AS text")
    rows = docs.where("row IN (CAST('3' AS BINARY), CAST('17' AS BINARY))").distinct().selectExpr("row", "row AS node")
    plans, stage_table = [], shingles.stage_table
    monkeypatch.setattr(shingles, "stage_table", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage_table(df, name))[1])
    want = [(k, shingles.shingle_hashes(f"a b {k} c d e", 5, common.WordHashes()).tobytes()) for k in ("17", "3")]
    got = {}
    for few in (100, 1):
        monkeypatch.setattr(shingles, "FEW_ROWS", few)
        got[few] = sorted((bytes(r["node"]).decode(), bytes(r["hashes"])) for r in shingles.sets_of(docs, rows, 5).collect())
    assert got[100] == got[1] == want
    assert "Join" in plans[0][plans[0].index("MapInArrow") :]  # below it, so before it


def test_workers_hand_back_what_other_work_kept():
    script = """
import os, re
from fernsieve.llm import common
def held():
    return int(re.search(r'VmRSS:\\s+(\\d+)', open('/proc/self/status').read()).group(1)) / 1024
common.kept_in_worker('one', lambda: [bytes(2000) for _ in range(100_000)])
pinned, many = [], held()
for k in range(0, 100_000, 50):
    pinned.append(common._KEPT['one'][k])
common.kept_in_worker('two', dict)
assert list(common._KEPT) == ['two'] and held() < many - 100, (many, held())
kept = [bytes(2000) for _ in range(100_000)]
pinned += kept[::50]
del kept
many = held()
common.work_begins('three')
assert not common._KEPT and held() < many - 100, (many, held())
"""
    subprocess.run([sys.executable, "-c", script], check=True, env=os.environ)


def test_shingles_shared_by_chance_are_not_carried_along(spark, monkeypatch):
    """Rows of a shingle whose other sets are too large or too small go to no round; likely ones and those of frequent shingles stay."""
    kept, write = [], shingles.stage_table

    def spy(df, name):
        out = write(df, name)
        if name == "places":
            kept.append(out.count())
        return out

    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    passage = [" ".join(words(k, n) + words("p", 40)) for k, n in ((0, 10), (1, 60), (2, 200), (3, 700))]
    near = words("n", 100)
    pair = [" ".join(near), " ".join(near[:-3])]
    monkeypatch.setattr(shingles, "stage_table", spy)
    monkeypatch.setattr(shingles, "COMMON", 100)
    for texts, want, least in ((passage, 4, 0), (passage + pair, 5, 18)):
        kept.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").selectExpr("cast(cast(row as string) as binary) row", "row doc_id", "text")
        got = shingles.similar_classes(docs)
        assert len({r["component"] for r in got.collect()}) == want and least <= kept[0] <= 2 * least
    monkeypatch.setattr(shingles, "CELL", 3)
    many = [" ".join(words(k, 50) + words("p", 40)) for k in range(6)] + pair
    docs = spark.createDataFrame(list(enumerate(many)), "row bigint, text string").selectExpr("cast(cast(row as string) as binary) row", "row doc_id", "text")
    assert len({r["component"] for r in shingles.similar_classes(docs).collect()}) == 7


def test_rows_with_partners_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    for most in (3, 40):
        sizes = rng.integers(1, most + 1, 60)
        starts = np.cumsum(sizes) - sizes
        n = rng.integers(20, 200, sizes.sum())
        at = (rng.random(len(n)) * (n // 5 + 1)).astype(np.int64)
        want = np.zeros(len(n), bool)
        for start, size in zip(starts, sizes):
            for i in range(start, start + size):
                want[i] = any(
                    9 * min(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]) and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) for j in range(start, start + size) if j != i
                )
        assert want.any() and not want.all() and (shingles.with_partners(starts, sizes, n, at, 4, 5) == want).all()


def test_wide_parities_tell_large_sets_apart_and_never_too_much():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for n in (1000, 1025, 3000, 3500, 4095, 4097, 5000)]
    sets += [np.unique(np.concatenate([sets[4], sets[0][:30]])), np.unique(sets[5][40:])]
    wide = [shingles.wide_parities(h) for h in sets]
    assert wide[0] == b"" and len(wide[2]) == len(wide[4]) == 512 and len(wide[5]) == 1024
    for i, j in [(i, j) for i in range(len(sets)) for j in range(i)]:
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert shingles.least_apart(wide[i], wide[j]) <= apart
        if i in (2, 3, 4) and j in (2, 3) and i != j:
            assert 9 * shingles.least_apart(wide[i], wide[j]) > len(sets[i]) + len(sets[j])


def test_large_unlike_texts_are_told_apart_without_their_sets(spark, monkeypatch):
    """Texts of 3,000 words that share a passage only: no set is asked for; a near copy of one is found."""
    asked, write = [], shingles.stage_table

    def spy(df, name):
        out = write(df, name)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(shingles, "stage_table", spy)
    monkeypatch.setattr(shingles, "COMMON", 100)
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    texts = [" ".join(words(k, 2700) + words("p", 300)) for k in range(4)]
    for more, want, sets in (([], 4, 0), ([texts[0] + " and some more"], 4, 2)):
        asked.clear()
        docs = spark.createDataFrame(list(enumerate(texts + more)), "row bigint, text string").selectExpr("cast(cast(row as string) as binary) row", "row doc_id", "text")
        assert len({r["component"] for r in shingles.similar_classes(docs).collect()}) == want and sum(asked) == sets
