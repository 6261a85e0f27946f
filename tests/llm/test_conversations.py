import collections
import hashlib
import random
import re
import zlib

import duckdb

from fernsieve.llm import conversations, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in by.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie_by_hand(convs):
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    out = []
    for node in members:
        below, stack = [], [node]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(kids[node]), sum(not kids[x] for x in below), saved, sha))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 45), *range(60, 75), 107, 200, 8191, 8192, 12289]:  # 100 and 8180 are absent
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a\x1cb c", "", None, "x \x0b y"])))
    for c in range(300, 340):  # one conversation many times
        rows += [(c, 0, "user", "same here"), (c, 1, "bot", "same there"), (c, 2, "user", "bye"), (c, 3, "bot", "bye bye")]
    rows += [(400, t, "user", f"turn {t}") for t in range(40)] + [(401, t, "user", f"turn {t}") for t in range(25)]  # long, the shorter a prefix of the longer
    for k in range(12):  # each branches off the one before, one turn deeper
        rows += [(500 + k, t, "user", "s" if t < k else f"own {k} {t}") for t in range(14)]
    return rows + [(7, 1, "user", "a b")] * 3 + [(None, 0, "user", "nobody's")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "mine") for r in rows], SCHEMA)  # columns that clash are not read


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "IDS_A_PIECE", 8)
    rows = some_rows()
    want = trie_by_hand(ordered(rows))
    got = conversations.trie_of(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == want
    turns = conversations.number_turns(frame(spark, rows).repartition(5))
    again = conversations.prefix_trie(*conversations.with_shared_heads(turns))
    assert sorted(map(tuple, again.collect()), key=str) == trie_by_hand(rebuilt(ordered(rows)))


def test_trie_of_nothing_and_of_turnless(spark):
    assert conversations.trie_of(frame(spark, []).limit(0)).count() == 0
    single = [(c, 0, "u", "hi") for c in (1, 2, 7, 9)]  # base 0 is absent, so some are left without a turn
    got = conversations.prefix_trie(*conversations.with_shared_heads(conversations.number_turns(frame(spark, single)))).collect()
    assert sorted(map(tuple, got), key=str) == trie_by_hand(rebuilt(ordered(single))) and any(not t for t in rebuilt(ordered(single)).values())


def test_trie_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = registry.QUERIES["op12_conversations"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(conversations.ORACLE_SQL).fetchall(), key=str)
