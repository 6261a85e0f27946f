"""Toxicity by multiple-instance learning.

A document is a bag of sentences; it is toxic if any of them is. Each sentence has a logistic score over its words, the
sentences of a document combine by noisy-or, and the weights are learned from the labels of documents alone. The
sentences whose own score is high are then what makes the document toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import bounded_sample, hand_back_memory, held_out, lower, map_batches, share_by_hash, table, work_begins
from fernsieve.plans.staging import stage_table

#: Bounds of the sample that a model is fitted on: documents (about), characters of one of them, characters of all (about).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 8_000, 200_000, 64_000_000
#: Words that a model weighs at most, documents of the sample that a word must stand in, steps and pull to zero.
VOCABULARY, MIN_DOCS, STEPS, DECAY = 6000, 3, 300, 2e-5
#: Features of sentences that a step weighs at a time.
HITS = 1 << 17
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside whole words: insults inflect.
STEMS = (4, 5)


def features(words: list[str]) -> set[str]:
    """Distinct words and word beginnings; a beginning ends in ``~``."""
    found = set(words)
    return found.union(*({w[:n] + "~" for w in found if len(w) >= n} for n in STEMS))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> list[tuple[float, int, int]]:
        """(score, start, end) of each sentence that holds a weighted feature; the others have the bias alone."""
        out, weights = [], self.weights
        for m in SENTENCE.finditer(lower(text)):
            hits = weights.keys() & features(WORD.findall(m[0]))
            if hits:
                z = self.bias + math.fsum(weights[w] for w in hits)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), m.start(), m.end()))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """Noisy-or over the sentences; of a null or empty text 0. A sentence without a weighted feature adds nothing."""
        scored = self.sentences(text) if text else []
        return 1 - math.exp(math.fsum(math.log1p(-p) for p, _, _ in scored)), scored


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(text, y) of about SAMPLE_DOCS labelled documents, spread by a hash of doc_id, none of them held out.

    Labels other than 0 and 1, null ids and null or empty texts are not learned from; of labels that differ the larger counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = stage_table(known, "labelled")
    picked = known.where(share_by_hash(F.col("doc_id"), 17, SAMPLE_DOCS, known.count()))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    return bounded_sample(texts.join(F.broadcast(picked), "doc_id").select("text", "y"), SAMPLE_TOTAL)  # about SAMPLE_DOCS rows are sent


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of ``sample(text, y)`` with either label it stands, of those in MIN_DOCS or more."""

    def work(cols: dict[str, list]) -> dict[str, list]:
        work_begins("features")
        clean, toxic = seen = Counter(), Counter()
        for text, label in zip(cols["text"], cols["y"]):
            seen[label].update(features(WORD.findall(lower(text))))
        found = list(clean.keys() | toxic.keys())
        return {"feature": found, "toxic": [toxic[w] for w in found], "clean": [clean[w] for w in found]}

    counted = map_batches(sample.select("text", "y"), work, "feature string, toxic bigint, clean bigint").groupBy("feature")
    return counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= MIN_DOCS)


def telling_features(counts: DataFrame, n: dict[int, int]) -> dict[str, int]:
    """Numbers from 0 of the VOCABULARY features whose shares differ most between ``n`` documents of each label."""
    gain = {}
    for batch in counts.toArrow().to_batches():  # what MIN_DOCS documents of the sample have at least
        for w, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            p, q, r = (a + 0.5) / (n[1] + 1), (b + 0.5) / (n[0] + 1), (a + b) / (n[0] + n[1])
            gain[w] = abs(p - q) / math.sqrt(r * (1 - r) + 1e-3)
    return {w: i for i, w in enumerate(sorted(gain, key=lambda w: (-gain[w], w))[:VOCABULARY])}


def numbered_sentences(sample: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(y, sizes, hits) of each document of ``sample(text, y)``, in order of label and text.

    hits numbers the features of its sentences, one sentence after the other; sizes tells how many each of those has that
    have any. Numbers are below VOCABULARY, so short ones do.
    """
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def work(cols: dict[str, list]) -> dict[str, list]:
        work_begins("sentences")
        known, out = shared.value, {"y": cols["y"], "sizes": [], "hits": []}
        for text in cols["text"]:
            found = [sorted(known[w] for w in features(WORD.findall(s)) & known.keys()) for s in SENTENCE.findall(lower(text))]
            out["sizes"].append([len(x) for x in found if x])
            out["hits"].append([w for x in found for w in x])
        return out

    return map_batches(sample.select("text", "y").orderBy("y", "text"), work, "y int, sizes array<smallint>, hits array<smallint>")


def fit(vocabulary: dict[str, int], y: np.ndarray, sentences: np.ndarray, sizes: np.ndarray, hits: np.ndarray) -> Model:
    """Weights that make noisy-or over sentences explain the labels: Adam on the whole sample, from zero.

    ``y`` and ``sentences``, their number, are of documents, ``sizes`` of sentences, as in ``numbered_sentences``.
    """
    of = np.repeat(np.arange(len(y)), sentences)
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    # so many sentences at a time that their features are about HITS
    cuts = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, len(hits), HITS)), [len(sizes)]])).tolist() if len(sizes) else [0]
    theta, bias, z = np.zeros(len(vocabulary)), -4.0, np.zeros(len(of))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, STEPS + 1):
        for a, b in zip(cuts, cuts[1:]):
            z[a:b] = np.add.reduceat(theta[hits[first[a] : first[b]]], first[a:b] - first[a])
        p = 1 / (1 + np.exp(-np.clip(bias + z, -30, 30)))
        none = np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        some = np.maximum(1 - none, 1e-6)
        slope = p * (1 - y / some)[of] / len(y)  # of the loss by a sentence's logit
        g = DECAY * theta
        for a, b in zip(cuts, cuts[1:]):
            g += np.bincount(hits[first[a] : first[b]], np.repeat(slope[a:b], sizes[a:b]), len(theta))
        gb = slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        theta -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (math.sqrt(vb) + 1e-8)
    return Model({w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.05}, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents; without any of both kinds nothing counts as toxic.

    Tasks read the texts; the driver gets counts of features, and of each sentence the numbers of those that are weighed.
    """
    sample = sample_labelled(docs, labels, label)
    n = dict(sample.groupBy("y").count().collect())
    if len(n) < 2:
        return Model({}, -8.0)
    vocabulary = telling_features(feature_counts(sample), n)
    got = numbered_sentences(sample, vocabulary).toArrow()
    sentences = np.concatenate([np.diff(x.offsets.to_numpy()) for x in got["sizes"].chunks])
    y, sizes, hits = got["y"].to_numpy(), *(np.concatenate([x.flatten().to_numpy() for x in got[c].chunks]) for c in ("sizes", "hits"))
    del got
    model = fit(vocabulary, y, sentences, sizes, hits)
    del y, sentences, sizes, hits
    hand_back_memory()
    return model


def score_documents(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and score, predicted and ``offending``: (score, start, end) of sentences at fault.

    Columns of these names are replaced. Start and end are character places. Each row is scored on its own: repeated
    rows get equal results, null and empty texts 0, an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words

    def work(cols: dict[str, list]) -> dict[str, list]:
        work_begins("toxicity")
        scored = [shared.value.score(t) for t in cols["text"]]
        return cols | {
            "score": [s for s, _ in scored],
            "predicted": [int(s >= 0.5) for s, _ in scored],
            "offending": [[{"score": p, "start": a, "end": b} for p, a, b in x if p >= offending] for _, x in scored],
        }

    kinds = dict(docs.dtypes)
    return map_batches(docs.select(*keep), work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double, predicted int, offending array<struct<score:double,start:int,end:int>>"]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
