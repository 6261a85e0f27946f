import collections
import random
import re
import zlib

import duckdb

from fernsieve.llm import registry, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, word string, n int, node int"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped_by_hand(words):
    best, out = {}, []
    near = {w: sorted((-m, v) for v, m in words.items() if one_edit(w, v)) for w in words}
    for w, n in words.items():
        best[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 5 * n else None
    for w, n in words.items():
        root = w
        while best[root]:
            root = best[root]
        out.append((w, best[w], root, n, len(near[w]), words[best[w]] if best[w] else None))
    return sorted(out, key=str)


def counted_by_hand(docs):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = {}
    for alphabet, lengths, many in (("ab", (6, 9), 400), ("abcé", (6, 8), 600), ("a", (6, 16), 11), ("xyzÿ", (60, 64), 30)):
        for _ in range(many):
            words["".join(rng.choice(alphabet) for _ in range(rng.randrange(*lengths)))] = rng.choice([5, 5, 6, 30, 30, 200, 5000])
    for w in list(words)[:300]:  # neighbours on purpose, at the ends and in repeated letters
        at = rng.randrange(len(w))
        words.setdefault(rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w + w[-1], "z" + w, w[:at] + "q" + w[at + 1 :]]), rng.choice([5, 40, 1500]))
    long = "".join(rng.choice("mnop") for _ in range(5000))
    words |= {long: 900, long[:-1]: 5, long[:2500] + long[2501:]: 6, "q" + long: 7, long[:4000] + "q" + long[4001:]: 1}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = grouped_by_hand(words)
    assert sorted(map(tuple, spelling.group_variants(df).collect()), key=str) == want
    monkeypatch.setattr(spelling, "HOT_WORDS", 20)
    monkeypatch.setattr(spelling, "PREFIX_ROWS", 7)
    assert sorted(map(tuple, spelling.group_variants(df.repartition(6)).collect()), key=str) == want and any(r[4] > 3 for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_words_are_counted_with_their_errors_and_nothing_gives_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(7)) for _ in range(20)] + ["Étéçàa", "ÉTÉçàa", "STRASSE", "naïveté", "ab", "abcdef"]
    docs = [(k % 300 if k % 7 else None, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "1", "×", "日"]) for _ in range(30))) for k in range(400)]
    docs += [(1, None), (2, ""), (None, None), (3, "onelongrun" * 3000)] + [(9, "repeated rows repeated")] * 6
    frame = spark.createDataFrame([(*d, "mine", 3, 1) for d in docs], SCHEMA)  # columns that clash are not read
    counted = spelling.count_words(frame)
    want = counted_by_hand(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == want and min(map(len, want)) == 6
    assert sorted(map(tuple, spelling.group_variants(counted).collect()), key=str) == grouped_by_hand(want)
    assert spelling.group_variants(spelling.count_words(frame.limit(0))).count() == 0


def test_variants_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.QUERIES["op13_spelling"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(spelling.ORACLE_SQL).fetchall(), key=str) and sum(r["form"] is not None for r in got) > 3
