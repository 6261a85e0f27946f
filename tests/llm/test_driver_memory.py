import pickle
import random
from collections import Counter

import numpy as np
import pytest

from fernsieve.llm import language, toxicity
from fernsieve.operators import components


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs = [(k, ". ".join(" ".join(rng.choice(("harum", "velit", "snarlz", "Quod", "esse", "näm", "омега")) for _ in range(6)) for _ in range(5)), rng.choice(("en", "de"))) for k in range(300)]
    return spark.createDataFrame([*docs, (300, "12 34", "la")], "doc_id bigint, text string, lang string"), spark.createDataFrame([(k, int("snarlz" in text)) for k, text, _ in docs], "doc_id bigint, toxic int")


def test_no_text_of_a_sample_reaches_the_driver(spark, corpus, monkeypatch):
    docs, labels = corpus
    kind, given = type(docs), []
    for name in ("toArrow", "collect"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (given.extend(self.columns), f(self))[1])
    assert toxicity.train(docs, labels).weights
    assert language.train(docs).langs
    assert given and "text" not in given


def test_toxicity_counts_and_numbers_in_tasks(spark, corpus):
    sample = toxicity.sample_labelled(*corpus)
    rows = sorted((r["y"], r["text"]) for r in sample.collect())
    found = [toxicity.features(toxicity.WORD.findall(text.lower())) for _, text in rows]
    want = {k: Counter(w for (y, _), f in zip(rows, found) if y == k for w in f) for k in (0, 1)}
    got = {r["feature"]: (r["toxic"], r["clean"]) for r in toxicity.feature_counts(sample).collect()}
    assert got == {w: (want[1][w], want[0][w]) for w in want[0] | want[1] if want[0][w] + want[1][w] >= toxicity.MIN_DOCS}
    known = {w: k for k, w in enumerate(sorted(got)) if k % 3}
    numbered = toxicity.numbered_sentences(sample, known).collect()
    assert [r["y"] for r in numbered] == [y for y, _ in rows]
    for r, (_, text) in zip(numbered, rows):
        hits = [sorted(known[w] for w in toxicity.features(toxicity.WORD.findall(s)) if w in known) for s in toxicity.SENTENCE.findall(text.lower())]
        assert r["sizes"] == [len(x) for x in hits if x] and r["hits"] == [w for x in hits for w in x]


def test_steps_in_parts_give_the_same_weights(monkeypatch):
    rng = np.random.default_rng(1)
    y, sentences = (np.arange(60) % 3 == 0).astype(np.int32), rng.integers(0, 6, 60)
    sizes = rng.integers(1, 9, sentences.sum()).astype(np.int16)
    hits = rng.integers(0, 40, sizes.sum()).astype(np.int16)
    known = {f"w{k}": k for k in range(40)}
    whole = toxicity.fit(known, y, sentences, sizes, hits)
    monkeypatch.setattr(toxicity, "HITS", 7)
    parts = toxicity.fit(known, y, sentences, sizes, hits)
    assert whole.weights.keys() == parts.weights.keys() and np.allclose(list(whole.weights.values()), list(parts.weights.values())) and np.isclose(whole.bias, parts.bias)
    none = np.zeros(0, np.int16)
    assert toxicity.fit({}, y, np.zeros(60, np.int32), none, none).weights == {}


def test_language_learns_the_same_from_counts(spark, corpus, monkeypatch):
    docs, _ = corpus
    rows = language.sample_texts(docs).collect()
    want = language.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    got = language.train(docs)
    assert got.langs == want.langs == sorted({r["lang"] for r in rows})
    assert got.words.keys() == want.words.keys() and all(np.array_equal(v, got.words[w]) for w, v in want.words.items())
    for mine, theirs in zip((*got.grams, got.scripts), (*want.grams, want.scripts)):
        assert mine.keys() == theirs.keys() and all(np.array_equal(v, mine[g]) for g, v in theirs.items())


def test_language_workers_get_few_arrays(corpus):
    rows = corpus[0].collect()
    texts = [r["text"] for r in rows]
    model = language.fit([f"{t} {' '.join(f'w{chr(97 + k % 26)}{chr(97 + k // 26)} ' * 6 for k in range(600))}" for t in texts[:5]], [r["lang"] for r in rows[:5]])
    tables = pickle.loads(pickle.dumps(language.Tables(model)))
    assert len(pickle.dumps(tables)) < len(pickle.dumps(model)) / 2
    assert language.label_texts([*texts, "", None], tables) == language.label_texts([*texts, "", None], model)
    assert language.label_texts(["a"], language.Tables(language.Model([])))[0][0] == "und" and language.Scores(language.Model([])) == {}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(300):03}".encode(), f"n{rng.randrange(300):03}".encode()) for _ in range(200)], "a binary, b binary").repartition(6)
    written = []
    stage = components.stage_table
    monkeypatch.setattr(components, "stage_table", lambda df, name: (written.append(name), stage(df, name))[1])
    few = sorted((bytes(n), bytes(r)) for n, r in components.connected_components(edges).collect())
    assert len(written) == 2
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert few == sorted((bytes(n), bytes(r)) for n, r in components.connected_components(edges).collect()) and len(few) > 150
    assert len(written) > 5
