import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from fernsieve.llm import audio, bpe, html_text, language, packing, quality, registry, shingles, simhash, substrings, toxicity, url_filters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, extra=()):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + list(extra), DOCS)


def odd_texts():
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "Straße", "don't", "x1", "!", "…", "the", "of"]
    long = " ".join(rng.choice(vocabulary) for _ in range(3000))
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    passage = " ".join(f"p{k}" for k in range(60))
    near = base.split()
    near[150] = "changed"
    return [None, "", " \n\t", "one", long, long, base, " ".join(near), base + " " + passage, passage + " tail " + passage, "\x1c\x85  x", "a" * 9000, "日本語 テキスト", "<|endoftext|> end", passage.upper()]


def test_url_filter_matches_sql_and_handles_odd_urls(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = registry.QUERIES["op1_url_filters"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(url_filters.ORACLE_SQL).fetchall(), key=str)
    rows = [(None, 1), ("no scheme", 2), ("http://A.NET", 3), ("http://x.Example.net/en/a?b", 4), ("http://example.net/english", 5), ("http://badnet/", 6), ("ftp://u.org/fr/://x", 7), ("http://A.NET/", 3)]
    pages = spark.createDataFrame(rows, "url string, page_id int").selectExpr("*", "'mine' AS host", "1 AS verdict_")
    rules = spark.createDataFrame(url_filters.RULES + [("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    out = collections.defaultdict(list)
    for r in url_filters.filter_urls(pages, rules).collect():
        out[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert out[1] == out[2] == [("", "", None, "allow")] and sorted(out[3], key=str) == [("a.net", "", None, "allow"), ("a.net", "/", "net/", "block")]
    assert out[4] == [("x.example.net", "/en/a", "example.net/en/", "allow")] and out[5][0][2] == "net/" and out[6][0][2] is None and out[7][0][2:] == ("org/fr/", "allow")
    assert url_filters.filter_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0 and url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_bpe_is_exact_with_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 16)
    monkeypatch.setattr(bpe, "REACH", 4)
    e, rng = bpe.Encoder(bpe.vocabulary_path()), random.Random(1)
    pieces = ["a", "e", "t", "th", "ing", "er", "'s", "'re", "!", "'", "é", "ß", "9", " ", "\n", "Σ", "İ", "中文", "́", "😀", "<|endoftext|>", "</w>", "\x1c", "\x85"]
    for k in range(1500):
        some = rng.choice([pieces, pieces[:6], ["!", "'", "?", "s"], ["A", "b"]])
        text = "".join(rng.choice(some) for _ in range(rng.randrange(120)))
        want = e.whole.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == want and e.decode(want) == e.whole.decode(want, skip_special_tokens=False)


def test_bpe_query_on_odd_texts(spark):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in bpe.digest_documents(documents(spark, texts), bpe.vocabulary_path()).collect()}
    whole = bpe.Encoder(bpe.vocabulary_path()).whole
    for k, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_documents(documents(spark, []), bpe.vocabulary_path()).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(100):
        cap = rng.choice([7, 16, 50, 2048])
        lengths = [rng.randint(1, cap) for _ in range(rng.randrange(200))]
        bins = collections.defaultdict(list)
        for length, _, many, first, offset in packing.best_fit(collections.Counter(lengths), cap):
            for b in range(first, first + many):
                bins[b].append((offset, length))
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            rooms.append((min(fits) if fits else cap) - x)
            if fits:
                rooms.remove(min(fits))
        assert sorted(cap - sum(x for _, x in b) for b in bins.values()) == sorted(rooms)
        for b in bins.values():
            assert [o for o, _ in sorted(b)] == [0, *np.cumsum([x for _, x in sorted(b)])[:-1]]


def test_packing_holds_every_piece_once(spark):
    texts = odd_texts()
    rows = packing.pack_documents(documents(spark, texts)).collect()
    assert packing.pack_documents(documents(spark, [])).count() == 0
    e, by, seen = bpe.Encoder(bpe.vocabulary_path()), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*e.encode(t), 0], "<u4")
        parts = sorted(seen[k], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["ids_crc32"]) for r in parts] == [(i, 2048 * i, zlib.crc32(ids[2048 * i : 2048 * i + 2048].tobytes())) for i in range(-(-len(ids) // 2048))]
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_quality_counts_against_brute_force(spark):
    texts = [*odd_texts(), "a b c d e f g h " * 4, "line\nline\n \nline x", "##$ <b>"]
    got = {r["doc_id"]: r for r in quality.judge_quality(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_symbols"], got[k]["n_dup_lines"], got[k]["n_repeat_words"], got[k]["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and got[k]["kept"])


def slow_components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def slow_print(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("hot", [32, 0])
def test_simhash_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(rng.choice(["x", "y"]) if rng.random() < 0.02 else w for w in base) for _ in range(60)]
    texts = odd_texts() + near
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(documents(spark, texts, [(0, None, None, None, None)])).collect()}
    prints = {k: slow_print(t) for k, t in enumerate(texts)}
    want = slow_components(prints)
    assert got == {k: (prints[k], want[k]) for k in prints}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [16, 1])
def test_wide_parts_lose_no_link(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_FROM", 0)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for f in fps for _ in range(3)]
    fps += [fps[0] ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]  # many share either half
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(table).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    joined = lambda edges: slow_labels(fps, edges)
    assert joined(got) == joined(want)


def slow_labels(nodes, edges):
    label = {x: x for x in nodes}
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        if old != new:
            label = {k: new if x == old else x for k, x in label.items()}
    return label


def test_similar_documents_catch_near_copies_and_leave_others(spark):
    rng = random.Random(9)
    texts = []
    for k in range(30):
        words = [f"v{rng.randrange(4000)}" for _ in range(200)]
        changed = list(words)
        changed[rng.randrange(200)] = "new"
        texts += [" ".join(words), " ".join(changed), " ".join(f"u{rng.randrange(4000)}" for _ in range(200))]
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar_documents(documents(spark, [*texts, None, ""])).collect()}
    assert all(got[3 * k + 1] == got[3 * k] == 3 * k and got[3 * k + 2] == 3 * k + 2 for k in range(30)) and got[91] == got[90] == 90


def test_substrings_against_brute_force(spark):
    texts = odd_texts()
    docs = documents(spark, texts, [(100, texts[6], None, None, None), (100, texts[6], None, None, None), (None, "x y", None, None, None)]).selectExpr("*", "1 AS row", "2 AS kept")
    words = [WORD.findall(t or "") for t in [*texts, texts[6], texts[6], "x y"]]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for k, w in zip([*range(len(texts)), 100, 100, None], words):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[(k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs).collect())
    assert got == want and substrings.remove_repeats(documents(spark, [])).count() == 0


def test_paths_compact_and_name_equal_spans(spark):
    word = lambda a, b, x="p": " ".join(f"{x}{k}" for k in range(a, b))
    texts = [word(0, 400), "x y z " + word(0, 400), word(100, 200) + " tail", word(0, 90, "q"), word(0, 90, "q"), word(0, 90, "q"), "short", None]
    got = substrings.repeated_paths(documents(spark, texts)).collect()
    spans, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        words = (texts[r["doc_id"]] or "").split()[r["first_word"] : r["first_word"] + r["n_words"]]
        spans[r["path"]].add(" ".join(words))
        want[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert all(len(x) == 1 for x in spans.values())
    assert {k: (min(v), max(v), len(v)) for k, v in want.items()} == {0: (0, 399, 400), 1: (3, 402, 400), 2: (0, 99, 100), 3: (0, 89, 90), 4: (0, 89, 90), 5: (0, 89, 90)}
    assert [(r["n_words"], r["copies"]) for r in got if r["doc_id"] == 4] == [(90, 3)]  # one path, whole
    assert len([r for r in got if r["doc_id"] == 0]) <= 60


def test_word_hashes_follow_the_words_alone():
    words = [b"a", b"a\0", b"12345678", b"123456789", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 5000, "ж中".encode()]
    rng = random.Random(4)
    several = [rng.choice(words) for _ in range(300)]
    alone = {w: substrings.Words([w], 1).hashes()[0] for w in words}
    got = substrings.Words(several, 1)
    assert len(set(alone.values())) == len(words) and [alone[w] for w in several] == got.hashes().tolist()
    assert [got.joined[a : b - 1] for a, b in zip(got.starts, got.starts[1:])] == several


def test_substrings_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.QUERIES["op10_substrings"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(substrings.ORACLE_SQL).fetchall())


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(10)
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        parts = [" ".join(f"w{rng.randrange(200)}x" for _ in range(8)) for _ in range(6)]
        if toxic:
            parts[rng.randrange(6)] += f" snarl{rng.choice('abc')}"
        rows.append((k, ". ".join(parts), "en", "s", 0))
    docs = spark.createDataFrame([(a, re.sub(r"(\d)", lambda m: "abcdefghij"[int(m[1])], b), *c) for a, b, *c in rows], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int"))
    scored = toxicity.score_documents(docs.union(documents(spark, [None, ""])), model).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in scored if r["text"]]) > 0.98
    assert all(r["score"] == 0 for r in scored if not r["text"])
    for r in scored:
        if r["predicted"]:
            assert any("snarl" in r["text"][x["start"] : x["end"]] for x in r["offending"])
    nothing = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score_documents(docs, nothing).where("predicted = 1").count() == 0


def test_language_held_out_and_mixed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.identify_languages(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    english, german = (next(r["text"] for r in got if r["lang"] == x and r["n_chars"] > 400)[:300] for x in ("en", "de"))
    (lang, share, spans), (empty, _, none), (digits, *_), (null, *_) = language.label_texts([f"{english} {german[:200]}", "", "12 34", None], model)
    assert lang == "en" and 0.4 < share < 0.9 and [s[0] for s in spans][0] == "en" and "de" in [s[0] for s in spans]
    assert empty == digits == null == "und" and none == []
    assert language.label_texts(["abc"], language.fit([], []))[0][0] == "und"


def test_language_reads_long_words_and_changes_of_script():
    model = language.fit(["abab abba baab " * 50, "xyxy yxxy xyyx " * 50, "привет мир слово " * 50], ["aa", "zz", "ru"])
    ((lang, share, spans),) = language.label_texts(["ab" * 32 + "xy" * 2000], model)
    assert lang == "zz" and share > 0.95 and [s[0] for s in spans] == ["aa", "zz"]
    ((lang, _, spans),) = language.label_texts(["абабприветпривет" * 3 + "ab" * 40], model)
    assert {s[0] for s in spans} == {"ru", "aa"} and spans[0][1] == 0 and spans[-1][2] == 48 + 80


def test_samples_of_very_large_tables_are_not_empty(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    many = 20_000_000_000
    picked = ids.where(language.share_by_hash(audio.F.col("doc_id"), 17, many // 20, many)).count()
    assert 9_000 < picked < 11_000 and ids.where(language.share_by_hash(audio.F.col("doc_id"), 17, 8_000, many)).count() < 10
    texts = spark.createDataFrame([(f"{k} " * 100, k) for k in range(400)], "text string, y int")
    assert language.bounded_sample(texts, 1 << 40).count() == 400 and 20 < language.bounded_sample(texts, 20_000).count() < 120


def test_bpe_forgets_within_its_bound_and_refuses_other_vocabularies(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 8000)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 6000)
    e, rng = bpe.Encoder(bpe.vocabulary_path()), random.Random(8)
    for _ in range(30):
        text = " ".join(f"word{rng.randrange(900)}" for _ in range(40))
        assert e.encode(text) == e.whole.encode(text, add_special_tokens=False).ids
        assert e.words.bytes <= 4000 and e.piece_bytes <= 3000 and len(e.words) + len(e.words.before) < 200 and not getattr(e.words.before, "before", {})
    other = tmp_path / "other.json"
    other.write_text('{"version":"1.0","truncation":null,"padding":null,"added_tokens":[],"normalizer":null,"pre_tokenizer":null,"post_processor":null,"decoder":null,"model":{"type":"BPE","dropout":null,"unk_token":null,"continuing_subword_prefix":null,"end_of_word_suffix":null,"fuse_unk":false,"byte_fallback":false,"ignore_merges":false,"vocab":{"a":0},"merges":[]}}')
    with pytest.raises(ValueError):
        bpe.Encoder(str(other))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = -rng.integers(0, 30, (rng.integers(1, 6), 3)) / 2.0
        cost = lambda p, s=s: sum(s[k, x] for k, x in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(cost(p) for p in np.ndindex(*[3] * len(s)))
        assert np.isclose(cost(language.viterbi([s])[0].tolist()), best)
        one = language.stays(s)
        assert one is None or np.isclose(cost([one] * len(s)), best)


def test_sure_places_leave_the_best_labels_as_they_are():
    rng, cuts = np.random.default_rng(5), 0
    for _ in range(300):
        true = np.repeat(rng.integers(0, 3, 12), rng.integers(1, 90, 12))
        s = -np.abs(rng.normal(0, 3, (len(true), 3)))
        s[np.arange(len(true)), true] *= rng.choice([0, 0.1, 0.3])
        s = np.maximum(s - s.max(1, keepdims=True), language.FLOOR)
        cost = lambda p, s=s: s[np.arange(len(p)), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
        ((whole,), (cut,)) = language.viterbi([s]), language.best_labels([s])
        assert np.isclose(cost(cut), cost(whole))
        cuts += len(language.sure_places(s))
    assert cuts > 300


def test_language_words_are_scored_alike_however_texts_are_grouped(monkeypatch):
    texts = ["abab xyxy baab", "", None, "привет abab мирabab", "xyxy " * 40, "x", "ªº ١٢ ..."]
    model = language.fit(["abab abba baab " * 50, "xyxy yxxy xyyx " * 50, "привет мир слово " * 50], ["aa", "zz", "ru"])
    want = [language.label_texts([t], model)[0] for t in texts]
    monkeypatch.setattr(language, "MOST_LETTERS", 20)
    monkeypatch.setattr(language, "MOST_NEW", 2)
    monkeypatch.setattr(language, "MOST_KEPT", 3)
    assert language.label_texts(texts, model) == want
    p3, p2, p1 = model.grams
    for word in ("abab", "x", "приab", "abq", "日"):
        padded, total = f"^{word}$", 0
        for k in range(1, len(padded)):
            by = next((g[x] for g, x in ((p3, padded[max(0, k - 2) : k + 1]), (p2, padded[max(0, k - 2) : k + 1]), (p2, padded[k - 1 : k + 1]), (p1, padded[k])) if x in g), 0)
            total = total + by
        assert np.allclose(language.Scores(model).spelled([word])[0], total)


def test_html(spark):
    page = "<html><head><title>t</title><script>x</script></head><body><nav><a>menu</a></nav><article><h1>A &amp;  B</h1><p>First <b>para</b>\n graph of the article, long enough.<p>Second one is long enough as well.<div class='ad'>buy</div><div id='comments'><p>nice</div></article><aside>side</aside><footer>foot</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "plain words"), (5, "u", "<div><p>unclosed <b>text")]
    got = {r["page_id"]: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nFirst para graph of the article, long enough.\nSecond one is long enough as well."
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain words" and got[5]["text"] == "unclosed text" and got[5]["n_chars"] == 13


def test_audio_alignment(spark):
    rng = np.random.default_rng(0)
    tune = rng.uniform(-0.5, 0.5, 96).tolist()
    rows = [(0, tune), (1, tune), (2, tune[16:]), (3, rng.uniform(-0.5, 0.5, 96).tolist()), (4, None), (5, []), (6, [None] * 40)]
    prints = audio.fingerprint_recordings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "embedding", "vec_id", audio.samples_of_vector)
    got = audio.align_recordings(prints, "vec_id", audio.F.col("vec_id") == 0).collect()
    assert {(r["query"], r["member"]) for r in got if r["kind"] == "member"} == {(0, 0), (0, 1), (2, 2), (3, 3), (6, 6)}
    (match,) = [r for r in got if r["kind"] == "match"]
    assert (match["query"], match["match"], match["offset"]) == (0, 2, -16 * audio.NOTE // audio.HOP) and match["errors"] < 0.05
    assert len(audio.samples_of_wav(None)) == len(audio.samples_of_wav(b"no")) == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.DOCUMENT)
    rows = [r.asDict() for r in docs.collect()]
    # what each stage decides, row by row or by comparing all rows with each other
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if model.score(r["text"])[0] < 0.5]
    kept = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS)
    named = language.label_texts([r["text"] for r in rows], language.train(kept))
    rows = [r for r, (lang, *_) in zip(rows, named) if lang != "und"]
    rows.sort(key=lambda r: r["doc_id"])
    root = slow_similar([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    words = [WORD.findall(r["text"]) for r in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    e, want, lengths = bpe.Encoder(bpe.vocabulary_path()), set(), collections.Counter()
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r["text"]
        ids = np.array([*e.whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            lengths[len(part)] += 1
            want.add((r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = got.collect()
    assert len(found) == len(want) and {tuple(r)[:5] for r in found} == want
    plan = packing.best_fit(lengths, 2048)
    assert len({r["sequence_id"] for r in found}) == max(first + many for _, _, many, first, _ in plan)


def test_pipeline_stages_take_empty_tables_and_odd_rows(spark):
    odd = documents(spark, ["", "some words here", "some words here", None], [(None, "a text without an id", None, None, None)] * 2)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).count() >= 2, name


def word_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def contiguous_copies():
    rng = random.Random(21)
    texts = []
    for k in range(24):
        base = [f"v{rng.randrange(9000)}" for _ in range(rng.randrange(60, 600))]
        for share in (0.11, 0.16, 0.21):
            new = [f"n{rng.randrange(9000)}" for _ in range(int(share * len(base)))]
            at = rng.randrange(len(base))
            texts += [" ".join(base + new), " ".join(base[: len(base) - len(new) * 8 // 10]), " ".join(base[:at] + new + base[at:])]
        texts.append(" ".join(base))
    return texts


def slow_similar(texts):
    sets, label = [word_shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return dict(enumerate(label))


def test_similar_documents_find_every_contiguous_copy(spark):
    texts = contiguous_copies()
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar_documents(documents(spark, texts)).collect()}
    assert got == slow_similar(texts)


@pytest.mark.parametrize("few, cell", [(8, 2048), (1, 2048), (1, 7)])
def test_similar_documents_join_large_groups_like_brute_force(spark, few, cell, monkeypatch):
    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "CELL", cell)
    rng, texts = random.Random(23), []
    for group in range(3):
        base = [f"g{group}x{rng.randrange(9000)}" for _ in range(150)]
        for k in range(40):
            words = list(base)
            for at in rng.sample(range(150), rng.randrange(1, 6)):
                words[at] = f"t{rng.randrange(9000)}"
            texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar_documents(documents(spark, texts)).collect()}
    assert got == slow_similar(texts) and len(set(got.values())) > 3


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(None, "b"), (1, "a"), (1, "a"), (2, "a"), (3, long), (3, long + " tail"), (None, None), (4, ""), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert [x for x in got if x[0] != 3] == [(1, "a"), (4, ""), (None, "b"), (None, "only null")]
    assert [x[0] for x in got].count(3) == 1


def test_similar_documents_hold_the_threshold_exactly(spark):
    rng, texts = random.Random(22), ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j k l"]
    for edits in range(1, 9):
        for k in range(6):
            words = [f"s{rng.randrange(9000)}" for _ in range(200)]
            texts.append(" ".join(words))
            for at in rng.sample(range(200), edits):
                words[at] = f"t{rng.randrange(9000)}"
            texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar_documents(documents(spark, texts)).collect()}
    assert got == slow_similar(texts) and got[1] == 0 and got[2] == 2


def brute_force_alignments(queries, recordings):
    """Every pair at every offset: the best offset within the limits."""
    want = {}
    for i, x in enumerate(queries):
        for j, y in enumerate(recordings):
            for off in range(-len(x) + audio.MIN_OVERLAP, len(y) - audio.MIN_OVERLAP + 1):
                n = min(len(x), len(y) - off) - max(0, -off)
                wrong = int(np.bitwise_count(x[max(0, -off) :][:n] ^ y[max(0, off) :][:n]).sum()) if n >= audio.MIN_OVERLAP else 1 << 30
                if wrong <= audio.MAX_ERRORS * 32 * n:
                    want[i, j] = max(want.get((i, j), (0, 0, 0)), (32 * n - 2 * wrong, -off, wrong / (32 * n)))
    return {k: (-v[1], v[2]) for k, v in want.items()}


@pytest.mark.parametrize("noise, least", [(0.0, 1.0), (0.02, 1.0), (0.05, 1.0), (0.1, 0.9)])
def test_audio_finds_noisy_and_cut_recordings_like_brute_force(noise, least):
    rng = np.random.default_rng(5)
    tunes = [rng.uniform(-0.5, 0.5, 64) for _ in range(12)]
    clean = [audio.fingerprint(audio.samples_of_vector(t.tolist())) for t in tunes]
    noisy = lambda x: audio.fingerprint(x + rng.normal(0, noise, len(x)))[0]
    recordings = [noisy(audio.samples_of_vector(t.tolist())[cut : cut + keep]) for t in tunes for cut, keep in ((0, 1 << 20), (0, 24000), (7 * audio.HOP, 1 << 20), (20 * audio.HOP, 24000))]
    want = brute_force_alignments([c for c, _ in clean], recordings)
    index = audio.Index(recordings)
    got = {(i, j): (off, errors) for i, (c, x) in enumerate(clean) for j, off, _, errors in audio.aligned(index, c, x)}
    assert len(want) >= 48 * 0.9 and set(got) <= set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= least * len(want)


def test_audio_loses_no_common_code_and_keeps_bounded_steps(monkeypatch):
    rng = np.random.default_rng(6)
    held = np.full(200, 12345, np.int64)  # a held tone: all pairs of frames agree
    tune, loose = audio.fingerprint(audio.samples_of_vector(rng.uniform(-0.5, 0.5, 64).tolist()))
    recordings = [np.concatenate([held, tune]), held, np.concatenate([tune, held[:100]])]
    whole = audio.Index(recordings)
    query, mask = np.concatenate([tune, held[:60]]), np.concatenate([loose, np.full(60, 255)])
    want = list(audio.aligned(whole, query, mask))
    monkeypatch.setattr(audio, "HITS", 50)
    monkeypatch.setattr(audio, "FRAMES", 16)
    assert list(audio.aligned(whole, query, mask)) == want and {m: (off, e) for m, off, _, e in want}[2] == (0, 0.0)
    assert {m for m, *_ in want} == {0, 1, 2}


def test_audio_reads_odd_files():
    def wav(width, rate=8000, channels=1, data=b"\x01\x80\x7f\x00\xff\x10" * 400):
        out = audio.io.BytesIO()
        with audio.wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(data)
        return out.getvalue()

    for width in (1, 2, 3, 4):
        x = audio.samples_of_wav(wav(width))
        assert len(x) == 2400 // width and np.abs(x).max() <= 1
    assert audio.samples_of_wav(wav(3, data=b"\x00\x00\x40"))[0] == 0.5 and audio.samples_of_wav(wav(1, data=b"\x00"))[0] == -1
    cut = wav(2)[:-1]
    assert len(audio.samples_of_wav(cut)) in (1199, 1200)
    zero = bytearray(wav(2))
    zero[24:28] = bytes(4)
    assert len(audio.samples_of_wav(bytes(zero))) == len(audio.samples_of_wav(b"RIFF")) == len(audio.samples_of_wav(None)) == 0
    assert len(audio.samples_of_wav(wav(2, rate=16000))) == 600
    assert audio.samples_of_vector([float("inf"), None, float("nan")]).any() == False  # noqa: E712
    assert len(audio.fingerprint(np.zeros(10))[0]) == 0


def unnamed_page(rng):
    """A page whose furniture has no telling name: lists of links around a story; and the story's paragraphs."""
    words = lambda n: " ".join(rng.choice(["river", "lantern", "meadow", "winter", "of", "the", "carried", "slowly"]) for _ in range(n))
    links = lambda: "<div><ul>" + "".join(f"<li><a href='/{k}'>{words(1)}</a> <a href='#'>{words(1)}</a></li>" for k in range(rng.randrange(6, 14))) + "</ul></div>"
    story = [words(rng.randrange(25, 60)) for _ in range(rng.randrange(6, 12))]
    return f"<html><body>{links()}<div><div>{''.join(f'<p>{x}</p>' for x in story)}</div></div>{links()}</body></html>", story


def test_html_regions_come_from_the_clustered_ratios(spark, monkeypatch):
    rng = random.Random(12)
    pages = [unnamed_page(rng) for _ in range(60)]
    want = ["\n".join(story) for _, story in pages]
    assert [html_text.main_text(page) for page, _ in pages] == want
    named = [page.replace("<div><div>", "<article><div>").replace("</div></div><div><ul>", "</div></article><div><ul>") for page, _ in pages]
    assert [html_text.main_text(page) for page in named] == want
    rows = [(k, "u", page) for k, (page, _) in enumerate(pages[:5])] + [(0, "u", pages[0][0])]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract_main_text(table).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((k, want[k]) for k in (0, 0, 1, 2, 3, 4))
    assert html_text.extract_main_text(table.limit(0)).count() == 0
    noise = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: noise.random(len(ratios)))
    assert sum(html_text.main_text(page) != text for (page, _), text in zip(pages, want)) > 50


@pytest.mark.parametrize("bad, text", [("<![foo[x]]>a", "a"), ("<![ >a<p>b", "a\nb"), ("<![CDATA[x]]><p>y", "y"), ("<p>a<!--", None), ("<a <b", None), ("</", None), ("&#xfffffffff;&bogus;", None), ("<" * 3000, None), ("<div>" * 5000 + "x", "x"), ("<![", None)])
def test_html_reads_malformed_pages(bad, text):
    got = html_text.main_text(bad)
    assert isinstance(got, str) and (text is None or got == text)


def test_html_keeps_content_outside_the_chosen_element():
    story = "".join(f"<p>Sentence number {k} of the long story goes on and on for quite a while, as stories do.</p>" for k in range(8))
    card = "<article class=card><p>A teaser that is long enough to be content of its own, were it the only one here.</p></article>"
    assert html_text.main_text(f"<body><nav><a>x</a></nav><div>{story}</div>{card}<footer>f</footer>").count("Sentence") == 8
    short = "<div><p>The second section is short, but content all the same, and must not go missing.</p></div>"
    text = html_text.main_text(f"<body><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><h1>Head</h1><p>The lead paragraph stands beside the div and says what is to come.</p><div>{story * 2}</div>{short}<footer>f</footer>")
    assert text.startswith("Head\nThe lead paragraph") and text.count("Sentence") == 16 and "second section" in text


@pytest.mark.parametrize("size", [100, 150, 200, 250, 400, 700, 1000, 2000, 4000, 6000])
def test_quality_rejects_noise_of_every_size(size):
    rng, packer = random.Random(size), quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    for _ in range(40):
        words = " ".join(base64.b64encode(rng.randbytes(rng.randrange(3, 12))).decode().rstrip("=") for _ in range(size // 4))
        assert not quality.compression(words[:size].encode(), packer)[2]


def test_quality_judges_the_last_partial_chunk():
    rng, packer = random.Random(1), quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    prose = " ".join(rng.choice(["meadow", "winter", "lantern", "of", "the", "and", "carried", "river", "slowly", "house", "beyond", "quiet"]) + rng.choice("abcdefgh") for _ in range(900)).encode()[:4096]
    noise = base64.b64encode(rng.randbytes(3060))[:4080]
    assert quality.compression(prose, packer)[1] == 0 and quality.compression(prose + noise, packer)[1] == len(noise) / (4096 + len(noise))
