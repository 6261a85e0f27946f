import numpy as np

from fernsieve.llm import audio, registry

SF = "/root/testdata/sf0.001"


def recordings(spark):
    rng = np.random.default_rng(4)
    tunes = [rng.uniform(-0.5, 0.5, 64).tolist() for _ in range(9)]
    rows = [(k, tunes[k % 9] if k < 12 else tunes[k - 12][8:], 1, "mine") for k in range(20)] + [(30, None, 1, ""), (3, tunes[3], 1, ""), (None, tunes[1], 1, "")]
    return audio.fingerprint_recordings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, codes int, query string"), "embedding", "vec_id", audio.samples_of_vector)


def test_blocks_of_any_size_give_the_same_rows(spark, monkeypatch):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    prints = recordings(spark)
    want = sorted(map(str, audio.align_recordings(prints, "vec_id", audio.F.col("vec_id") < 10).collect()))
    assert sum("kind='match'" in r for r in want) >= 8 and spark.conf.get(rows) == before  # other plans keep their batches
    for queries, block, codes in ((2, 3, 400), (3, 2, 1), (1, 100, 1 << 20)):
        monkeypatch.setattr(audio, "QUERIES", queries)
        monkeypatch.setattr(audio, "RECORDINGS", block)
        monkeypatch.setattr(audio, "CODES", codes)
        assert sorted(map(str, audio.align_recordings(prints, "vec_id", audio.F.col("vec_id") < 10).collect())) == want
    members = [r for r in audio.align_recordings(prints, "vec_id", audio.F.col("vec_id") < 10).collect() if r["kind"] == "member"]
    assert sorted((r["query"], r["member"]) for r in members if r["query"] in (0, 3)) == [(0, 0), (0, 9), (3, 3), (3, 3)]  # 12 is shorter; a repeated row is a repeated member
    assert audio.align_recordings(prints.limit(0), "vec_id", audio.F.col("vec_id") < 10).count() == 0


def test_the_query_finds_its_noisy_excerpts(spark):
    got = registry.QUERIES["op9_audio"](spark, SF).collect()
    of = {r["member"]: r["query"] for r in got if r["kind"] == "member"}
    found = {(r["query"], r["match"]): r["offset"] for r in got if r["kind"] == "match"}
    asked = [k for k in of if k >= 0 and k % 50 == 0]
    for j, _ in enumerate(audio.NOISES):
        hits = [found.get((of[-1 - (2 * k + j)], of[k])) for k in asked]
        assert len(asked) == 10 and sum(h == audio.EXCERPT * audio.NOTE // audio.HOP for h in hits) >= 0.9 * len(asked)
    assert len(of) == 500 + 2 * len(asked)


def test_only_long_overlaps_are_counted_and_wrong_bits_up_to_the_limit():
    rng = np.random.default_rng(4)
    recordings = [rng.integers(0, 1 << 32, n) for n in (40, 90, 5000, 20_000)]
    query = recordings[3][3000:9000].copy()
    query[::3] ^= 1 << 7
    recordings[2][100:4000] = query[50:3950] ^ (1 << 3)
    index, loose = audio.Index(recordings), np.full(len(query), (1 << audio.LOOSE) - 1)
    owner, offset, votes = index.histogram(query, loose, audio.MIN_OVERLAP)
    assert len(owner) and index.overlap(len(query), owner, offset).min() >= audio.MIN_OVERLAP
    every = dict(zip(zip(*(x.tolist() for x in index.histogram(query, loose)[:2])), index.histogram(query, loose)[2].tolist()))
    assert dict(zip(zip(owner.tolist(), offset.tolist()), votes.tolist())) == {k: v for k, v in every.items() if index.overlap(len(query), *map(np.array, ([k[0]], [k[1]])))[0] >= audio.MIN_OVERLAP}
    owner, offset = (np.array(x) for x in zip((3, 3000), (3, 2999), (2, 50), (1, 0), (2, -5900), (3, 19_950)))
    wrong, frames = index.errors(query, owner, offset)
    for o, off, w, n in zip(owner, offset, wrong, frames):
        lo, hi = max(0, -off), min(len(query), len(recordings[o]) - off)
        right = int(np.bitwise_count(query[lo:hi] ^ recordings[o][lo + off : hi + off]).sum())
        most = audio.MAX_ERRORS * 32 * n
        assert n == hi - lo and (w == right if right <= most else most < w <= right)
    assert {(o, off) for o, off, _, _ in audio.aligned(index, query, loose)} == {(3, 3000), (2, 50)}
