"""Language identification of mixed text: scripts, scores of words, and Viterbi over words.

The script of a word leaves only the languages that are written in it; a trigram model with back-off scores the word
for each of those; Viterbi with a penalty for every change of language labels the words, and runs of equal labels are
the spans. The language with the most letters is the document's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import bounded_sample, hand_back_memory, held_out, lower, map_batches, share_by_hash, table, work_begins

#: Bounds of the sample that a model is fitted on: documents (about), characters of one of them, characters of all (about).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 8_000, 200_000, 64_000_000
#: What a change of language costs, how far a word's scores may lie apart, words a model and a worker remember.
SWITCH, FLOOR, MOST_WORDS, MOST_KEPT = 6.0, -8.0, 50_000, 300_000
#: Words of a block that is looked at to cut long texts.
BLOCK = 16
#: Letters in a row; a longer run, as of scripts without spaces, is as many words as it takes, each with a label of its own.
WORD = re.compile(r"[^\W\d_]{1,64}")
#: First code point of a range, its script ("" ends a range).
SCRIPTS = (
    (0x0041, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, ""),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, ""), (0x0B80, "tamil"), (0x0C00, ""), (0x0E00, "thai"), (0x0E80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, ""), (0x20000, "han"), (0x30000, ""),
)
STARTS = [a for a, _ in SCRIPTS]
LATIN_ENDS = chr(SCRIPTS[1][0])
#: Characters of texts, and words, that are scored at a time.
MOST_LETTERS, MOST_NEW = 1 << 20, 1 << 12


def script_of(word: str) -> str:
    """Script of a word's last letter that has one; "" if none has."""
    for c in reversed(word):
        if (k := bisect_right(STARTS, ord(c))) and SCRIPTS[k - 1][1]:
            return SCRIPTS[k - 1][1]
    return ""


def by_script(word: str) -> list[str]:
    """The stretches of a word that are written in one script; letters without one go with those before them."""
    if max(word) < LATIN_ENDS:
        return [word]
    cuts, now = [0], ""
    for k, c in enumerate(word):
        script = script_of(c)
        if script and now and script != now:
            cuts.append(k)
        now = script or now
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]


@dataclass
class Model:
    """langs; log scores of common words, of trigrams, bigrams and characters; which scripts each language is written in."""

    langs: list[str]
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: tuple[dict[str, np.ndarray], ...] = ({}, {}, {})
    scripts: dict[str, np.ndarray] = field(default_factory=dict)


def numbered(gram: str) -> int:
    """One to three characters as a number."""
    return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class Tables:
    """A model as few arrays, which take less memory in a worker than an array for each word and gram."""

    def __init__(self, model: Model) -> None:
        self.langs = model.langs
        self.words = dict(zip(model.words, range(len(model.words))))
        self.known = np.array([*model.words.values()]).reshape(len(model.words), len(model.langs))
        #: which languages are written in a script, where that rules out some but not all
        self.masks = {s: fits for s, fits in model.scripts.items() if fits.any() and not fits.all()}
        grams = {numbered(g): v for by in model.grams for g, v in by.items()}
        self.grams = np.array(sorted(grams), np.int64)
        self.table = np.array([*(grams[g] for g in self.grams.tolist()), np.zeros(len(model.langs))])


class Scores(dict):
    """Rows of a table of scores by word, filled as words come; -1 for what has no letter."""

    def __init__(self, model: Model | Tables) -> None:
        super().__init__()
        self.tables = tables = model if isinstance(model, Tables) else Tables(model)
        self.many = 0
        self.grams, self.table = tables.grams, tables.table
        self.mixed: dict[str, list[str]] = {}  # words of several scripts, and their stretches
        self.rows = np.zeros((2 * MOST_KEPT, len(tables.langs)))  # what is not filled takes no memory

    def places_of(self, grams: np.ndarray) -> np.ndarray:
        """Where numbered grams stand in the table; its last row, of zeros, for those that the model has not."""
        none = len(self.grams)
        at = np.searchsorted(self.grams, grams)
        return np.where(self.grams[np.minimum(at, none - 1)] == grams, at, none) if none else at

    def spelled(self, words: list[str]) -> np.ndarray:
        """Log scores of words by their trigrams, each backing off to what the model has of its end."""
        if not words:
            return np.zeros((0, len(self.tables.langs)))
        letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(sizes) - sizes
        one = letters[1:]
        two = letters[:-1] << 21 | one
        three = two.copy()
        three[1:] |= letters[:-2] << 42
        three[first] = two[first]  # a word's first letter has only the mark before it
        ends = np.ones(len(letters) - 1, bool)
        ends[first[1:] - 1] = False  # where the last one is the mark of a word's start
        ids = self.places_of(three[ends])
        for shorter in (two[ends], one[ends]):
            missing = np.flatnonzero(ids == len(self.grams))
            ids[missing] = self.places_of(shorter[missing])
        return np.add.reduceat(self.table[ids], first - np.arange(len(words)), axis=0)

    def fresh(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words by language: 0 for the best, at least FLOOR for those that the script allows."""
        raw = self.spelled(words)
        for k, w in enumerate(words):
            if (known := self.tables.words.get(w)) is not None:
                raw[k] = self.tables.known[known]
            if (fits := self.tables.masks.get(script_of(w))) is not None:
                raw[k, ~fits] = -np.inf
        raw -= raw.max(axis=1, keepdims=True)
        return np.where(np.isinf(raw), 4 * FLOOR, np.maximum(raw, FLOOR))

    def learn(self, words: set[str]) -> None:
        """Gives each word, and each stretch of a word of several scripts, its row."""
        if self.many > MOST_KEPT:
            self.clear()
            self.mixed.clear()
            self.many = 0
        new = [w for w in words if w not in self]
        mixed = {w: parts for w in new if len(parts := by_script(w)) > 1}
        self.mixed |= mixed
        new = [w for w in set(new).union(*mixed.values()) if w not in self]
        self.update(dict.fromkeys(new, -1))
        new = [w for w in new if has_letter(w)]
        for k in range(0, len(new), MOST_NEW):
            part = new[k : k + MOST_NEW]
            while self.many + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.many : self.many + len(part)] = self.fresh(part)
            self.update(zip(part, range(self.many, self.many + len(part))))
            self.many += len(part)

    def of(self, words: list[str]) -> np.ndarray:
        """Row of each word; all have been learned."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def sample_texts(docs: DataFrame) -> DataFrame:
    """(text, lang) of about SAMPLE_DOCS documents with a language, spread by a hash of doc_id, none of them held out.

    Documents without an id, a language or a text are not learned from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.where(share_by_hash(F.col("doc_id"), 23, SAMPLE_DOCS, known.count()))
    return bounded_sample(picked.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", "lang"), SAMPLE_TOTAL)


def counted(texts: list[str], langs: list[str]) -> dict[str, Counter]:
    """How often words, and stretches of words of several scripts, stand in the texts of each language."""
    words: dict[str, Counter] = {lang: Counter() for lang in langs}
    for text, lang in zip(texts, langs):
        words[lang].update(x for w in WORD.findall(lower(text)) for x in by_script(w))
    return words


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, many) of ``sample(text, lang)``; a language whose texts have no words has a null word."""

    def work(cols: dict[str, list]) -> dict[str, list]:
        work_begins("words of languages")
        rows = [(lang, w, n) for lang, mine in counted(cols["text"], cols["lang"]).items() for w, n in [*mine.items(), (None, 0)]]
        return dict(zip(("lang", "word", "many"), map(list, zip(*rows))))

    return map_batches(sample.select("text", "lang"), work, "lang string, word string, many bigint").groupBy("lang", "word").agg(F.sum("many").alias("many"))


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model of texts at hand."""
    return fit_counts(counted(texts, langs))


def fit_counts(of: dict[str, Counter]) -> Model:
    """Scores from each language's counts of words in the sample; rare counts lean on shorter contexts."""
    names = sorted(of)
    if not names:
        return Model([])
    words = [of[name] for name in names]
    counts = [[Counter() for _ in names] for _ in range(3)]
    letters = [Counter() for _ in names]
    for n, mine in enumerate(words):
        for w, many in mine.items():
            padded = f"^{w}$"
            letters[n][script_of(w)] += many * len(w)
            for k in range(1, len(padded)):
                for size in (3, 2, 1):
                    if k >= size - 1:
                        counts[3 - size][n][padded[k - size + 1 : k + 1]] += many
    three, two, one = counts
    sums = [[Counter() for _ in names] for _ in range(2)]
    for size, by in ((0, three), (1, two)):
        for n in range(len(names)):
            for g, c in by[n].items():
                sums[size][n][g[:-1]] += c
    total = [sum(c.values()) for c in one]
    size = len(set().union(*one)) + 1
    p1 = {g: np.array([(one[n][g] + 0.5) / (total[n] + 0.5 * size) for n in range(len(names))]) for g in set().union(*one)}
    p2 = {g: np.array([(two[n][g] + 5 * p1[g[-1]][n]) / (sums[1][n][g[:-1]] + 5) for n in range(len(names))]) for g in set().union(*two)}
    p3 = {g: np.array([(three[n][g] + 5 * p2[g[-2:]][n]) / (sums[0][n][g[:-1]] + 5) for n in range(len(names))]) for g in set().union(*three)}
    grams = tuple({g: np.log(p) for g, p in by.items()} for by in (p3, p2, p1))
    model = Model(names, {}, grams, {s: np.array([letters[n][s] >= 0.01 * sum(letters[n].values()) for n in range(len(names))]) for s in set().union(*letters) if s})
    total_words = sum(words, Counter())
    common = [w for w, c in sorted(total_words.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS] if c >= 5]
    seen = np.array([[c[w] for c in words] for w in common]).reshape(-1, len(names))
    many = np.array([sum(c.values()) for c in words])
    model.words = dict(zip(common, np.log((seen + 3 * np.exp(Scores(model).spelled(common))) / (many + 3))))
    return model


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each document's words; documents go side by side, longest first, and leave as they end."""
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    sizes = np.array([len(scores[d]) for d in order])
    n = int((sizes > 0).sum())
    if not n:
        return [np.zeros(0, np.int64) for _ in scores]
    kinds, longest = scores[order[0]].shape[1], int(sizes[0])
    starts = np.concatenate([[0], np.cumsum(sizes[:n])[:-1]])
    flat = np.concatenate([scores[d] for d in order[:n]])
    came = np.zeros((len(flat), kinds), np.int16)  # 0: the same label before, else 1 + the label before
    alive = np.searchsorted(-sizes[:n], -np.arange(longest), "left")
    value, rows = flat[starts].copy(), np.arange(n)
    for t in range(1, longest):
        k = alive[t]
        v = value[:k]
        best = v.argmax(1)
        top = v[rows[:k], best] - SWITCH
        moved = top[:, None] > v
        at = starts[:k] + t
        came[at] = np.where(moved, best[:, None] + 1, 0)
        value[:k] = np.where(moved, top[:, None], v) + flat[at]
    label = np.zeros(len(flat), np.int64)
    now = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        label[at] = now[:k]
        back = came[at, now[:k]]
        now[:k] = np.where(back > 0, back - 1, now[:k])
    out = [np.zeros(0, np.int64)] * len(scores)
    for d, a, s in zip(order[:n], starts, sizes[:n]):
        out[d] = label[a : a + s]
    return out


def sure_places(scores: np.ndarray) -> np.ndarray:
    """Where a text can be cut in two whose best labels, found apart, are those of the whole.

    In the middle of three blocks that favour the same label: the outer two by more than two changes cost, so the best
    path is at that label in both; in all three all that words favour others by does not make up for half a change, so it
    never leaves in between, nor at a cut there. Only every second block is cut, so each piece holds whole outer blocks.
    """
    n = len(scores) // BLOCK
    blocks = scores[: n * BLOCK].reshape(n, BLOCK, -1)
    best = blocks.sum(1).argmax(1)
    others = blocks.copy()
    others[np.arange(n), :, best] = -np.inf
    ahead = blocks[np.arange(n), :, best] - others.max(2)
    sure, behind = ahead.sum(1) > 2 * SWITCH, np.maximum(-ahead, 0).sum(1)
    cut = (best[:-2] == best[1:-1]) & (best[1:-1] == best[2:]) & sure[:-2] & sure[2:] & (behind[:-2] + behind[1:-1] + behind[2:] <= SWITCH / 2)
    middle = np.flatnonzero(cut) + 1
    return middle[middle % 2 == 0] * BLOCK + BLOCK // 2


def best_labels(scores: list[np.ndarray]) -> list[np.ndarray]:
    """What ``viterbi`` gives, with texts cut at sure places: its steps are as many as the longest piece has words."""
    pieces = [np.split(s, sure_places(s)) if len(s) >= 3 * BLOCK else [s] for s in scores]
    found = iter(viterbi([x for parts in pieces for x in parts]))
    return [np.concatenate([next(found) for _ in parts]) for parts in pieces]


def stays(scores: np.ndarray) -> int | None:
    """The label of all words if no change of it can pay, else None.

    A path with ``k`` runs away from the best single label has ``k`` changes at least, or ``k - 1`` (and ``k`` above 1) if
    it is never there. So none pays if no run of words favours another label by more than half of what a change costs.
    """
    best = int(scores.sum(0).argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    return best if (gain - np.minimum.accumulate(gain, axis=0)).max() <= SWITCH / 2 else None


def groups_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of MOST_LETTERS characters at most, or one longer text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > MOST_LETTERS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def label_texts(texts: list[str | None], model: Model | Tables, kept: Scores | None = None) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans of (language, start, end)) of each text."""
    if not model.langs:
        return [("und", 0.0, []) for _ in texts]
    kept = Scores(model) if kept is None else kept
    words: list[np.ndarray] = []
    labels: list[np.ndarray | int | None] = []
    hard: dict[int, np.ndarray] = {}
    for group in groups_of(texts):
        split = [WORD.findall(lower(text or "")) for text in group]
        kept.learn(set().union(*split))
        for found in split:
            if not kept.mixed.keys().isdisjoint(found):
                found = [x for w in found for x in kept.mixed.get(w, (w,))]
            rows = kept.of(found)
            size = np.fromiter(map(len, found), np.int64, len(found))
            scores = kept.rows[rows[rows >= 0]]
            words.append(size[rows >= 0])
            labels.append(stays(scores) if len(scores) else None)
            if labels[-1] is None and len(scores):
                hard[len(labels) - 1] = scores
    for d, path in zip(hard, best_labels(list(hard.values()))):
        labels[d] = path
    out = []
    for text, size, path in zip(texts, words, labels):
        if path is None:
            out.append(("und", 0.0, []))
            continue
        if isinstance(path, int):
            path = np.full(len(size), path)
        share = np.bincount(path, size, len(model.langs)) / size.sum()
        where = places(text) if path.min() != path.max() else whole(text)
        cut = np.flatnonzero(np.diff(path)) + 1
        first, last = ([0, *cut], [*(cut - 1), len(where) - 1])
        out.append((model.langs[int(share.argmax())], float(share.max()), [(model.langs[path[min(a, len(path) - 1)]], where[a][0], where[b][1]) for a, b in zip(first, last)]))
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Where the words of a text, and the stretches of words of several scripts, start and end."""
    out = []
    for m in WORD.finditer(lower(text)):
        at = m.start()
        for part in by_script(m[0]):
            if has_letter(part):
                out.append((at, at + len(part)))
            at += len(part)
    return out


def whole(text: str) -> list[tuple[int, int]]:
    """From the first letter to the last, as one span."""
    a = next(k for k, c in enumerate(text) if c.isalpha())
    b = next(k for k in range(len(text), 0, -1) if text[k - 1].isalpha())
    return [(a, b)]


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of documents with a language; without any, every text is ``und``.

    Tasks read the texts; the driver gets counts of distinct words.
    """
    of: dict[str, Counter] = {}
    for batch in word_counts(sample_texts(docs)).toArrow().to_batches():
        for lang, word, many in zip(*(c.to_pylist() for c in batch.columns)):
            mine = of.setdefault(lang, Counter())
            if word is not None:
                mine[word] = many
    model = fit_counts(of)
    of.clear()
    hand_back_memory()
    return model


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (that language's share of the letters) and spans.

    Columns of these names are replaced. A null text, or one without letters, is ``und`` with score 0 and no spans.
    Each row is labelled on its own: repeated rows get equal results, an empty table an empty one; ids are not read. Of
    languages with equally many letters the first in the alphabet counts.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(Tables(model))  # MOST_WORDS words, and trigrams of the sample

    def work(cols: dict[str, list], kept: list[Scores] = []) -> dict[str, list]:  # noqa: B006  kept from batch to batch of a task
        if not kept:
            work_begins("language")
            kept.append(Scores(shared.value))
        got = label_texts(cols["text"], shared.value, kept[0])
        return cols | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "spans": [[{"lang": a, "start": b, "end": c} for a, b, c in x[2]] for x in got]}

    kinds = dict(docs.dtypes)
    return map_batches(docs.select(*keep), work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"]))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
