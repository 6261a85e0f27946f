"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

The vocabulary is a trie. Each node's heavy child holds the most words; the words under its other children, the light
ones, are merged into what stands beside them with one character changed: skipped, replaced by the heavy child's, or that
one put in before it. Where such a word coincides with one of the vocabulary, the two are one edit apart; two words under
light children coincide where both have the node's character replaced. A word hangs under at most log2(words) light
children, so the merges are few, and each pair is found once, at the node where its words part.

Nodes are rows: words are dealt by prefix to count children, and changed words meet the vocabulary in equi-joins, so no
task holds a trie. The one node that all words pass, and others that many pass, are joined by broadcast.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import parts_of, table
from fernsieve.plans.staging import drop_staged, let_workers_import, sent_if_few, stage_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words shorter or rarer are no words.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: Of this many pairs of document and run, one in all loses a character.
ERRORS_IN = 199
#: A word leads to a near one that is this many times as frequent.
TIMES = 5
#: Distinct words, and characters of them, that a task counts before it hands them on.
MOST_WORDS, MOST_CHARS = 200_000, 16 << 20
#: Prefixes up to this many characters name a node as they are, longer ones by their hash; rows of an Arrow batch of prefixes.
PLAIN, PREFIX_ROWS = 40, 1 << 13
#: A node with more words than this, and than this share of all, is joined by broadcast: at each depth no more than one over the share.
HOT_WORDS, HOT_SHARE = 2_000, 0.002


def runs_of(doc_id: object, text: str | None) -> Counter:
    """Counts of a text's runs, A-Z lower-cased; a run whose hash with the id says so has lost a character."""
    counts: Counter = Counter()
    who = "" if doc_id is None else str(doc_id)
    start = zlib.crc32(f"{who}:".encode())
    for run, n in Counter(RUN.findall((text or "").translate(SMALL))).items():
        h = zlib.crc32(run.encode(), start)
        if h % ERRORS_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        counts[run] += n
    return counts


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all texts, words of LEAST_CHARS code points that occur LEAST_COUNT times.

    A null text has no words, a null id is an empty one; repeated rows count each. Tasks sum what they read before
    anything is shuffled, a bounded number of words at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chars = Counter(), 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in parts_of(batch):
                for who, said in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for run, n in runs_of(who, said).items():
                        if len(run) >= LEAST_CHARS:
                            if run not in counts:
                                chars += len(run)
                            counts[run] += n
                    if len(counts) > MOST_WORDS or chars > MOST_CHARS:
                        yield rows()
                        counts.clear()
                        chars = 0
        yield rows()

    let_workers_import(docs.sparkSession)
    return docs.select(key, text).mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def prefixes_of(word: str) -> Iterator[tuple[str, str]]:
    """(node, next character) for each prefix, the empty one first; after the whole word the character is empty."""
    rolling, done = hashlib.md5(word[:PLAIN].encode()), PLAIN
    for at in range(len(word) + 1):
        if at <= PLAIN:
            node = word[:at]
        else:
            rolling.update(word[done:at].encode())
            done, node = at, f"#{at}:{rolling.hexdigest()}"
        yield node, word[at : at + 1]


def prefix_rows(words: DataFrame) -> DataFrame:
    """(name, node, next, depth) for each prefix of each word; a long word is named by its hash, so that rows stay short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["name", "node", "next", "depth"])

        for batch in batches:
            for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for depth, (node, following) in enumerate(prefixes_of(word)):
                    rows.append((name, node, following, depth))
                    if len(rows) >= PREFIX_ROWS:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return words.select("name", "word").mapInArrow(work, "name string, node string, next string, depth int")


def light_edges(prefixes: DataFrame, n_words: int) -> DataFrame:
    """(name, depth, node, heavy) where a word turns off to a light child: heavy is the character of the heavy one.

    The heavy child is the one with the most words, of equals the first by code point; a word that ends at a node counts
    as a light child of it, unless it is the only one.
    """
    children = prefixes.groupBy("node", "next").agg(F.count("*").alias("n"))
    order = F.struct(F.col("next") != "", "n", -F.coalesce(F.ascii("next"), F.lit(0)))
    nodes = children.groupBy("node").agg(F.max_by("next", order).alias("heavy"), F.sum("n").alias("n"), F.count("*").alias("kids"))
    nodes = stage_table(nodes.where("kids > 1").select("node", "heavy", "n"), "nodes")
    many = max(HOT_WORDS, int(n_words * HOT_SHARE))
    hot = sent_if_few(nodes.where(F.col("n") > many).select(F.col("node").alias("_hot"), F.col("heavy").alias("_heavy")))
    marked = prefixes.join(hot, F.col("node") == F.col("_hot"), "left")
    wide = marked.where("_hot IS NOT NULL").select("name", "depth", "node", "next", F.col("_heavy").alias("heavy"))
    narrow = marked.where("_hot IS NULL").select("name", "depth", "node", "next").join(nodes.where(F.col("n") <= many).drop("n"), "node").select("name", "depth", "node", "next", "heavy")
    return wide.unionByName(narrow).where("next <> heavy").select("name", "depth", "node", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many of ``words(word, n)`` are one edit from each, and the one with the largest n.

    Words that are near none are left out; of equal n the smallest by code point is given. Words are distinct.
    """
    named = F.when(F.length("word") <= PLAIN, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256)))
    words = stage_table(words.select("word", "n", named.alias("name")), "words")
    prefixes = stage_table(prefix_rows(words), "prefixes")
    light = light_edges(prefixes, words.count())
    depth = F.col("depth")
    before = F.when(depth == 0, F.lit("")).otherwise(F.expr("substring(word, 1, depth)"))
    turned, rest = F.expr("substring(word, depth + 1, 1)"), F.expr("substring(word, depth + 2)")
    merged = stage_table(
        words.join(light, "name").select("word", "n", depth.alias("depth"), "node", before.alias("before"), turned.alias("turned"), rest.alias("rest"), "heavy"), "light"
    )  # a row for each light child that a word hangs under
    inner, follows = F.col("turned") != "", F.expr("substring(rest, 1, 1)")
    changed = F.array_compact(F.array(
        F.when(inner & (follows != F.col("turned")), F.concat("before", "rest")),  # skipped; where the next is the same, a deeper node has it
        F.when(inner, F.concat("before", "heavy", "rest")),
        F.concat("before", "heavy", "turned", "rest"),
    ))
    errata = merged.select("word", "n", F.explode(changed).alias("changed"))
    pairs = errata.join(words.select(F.col("word").alias("changed"), F.col("n").alias("m")), "changed")
    # what coincides beside the heavy child: as many as there are letters at most, and no pair of them is written out
    beside = merged.where(inner).groupBy("node", "depth", "rest").agg(F.collect_list(F.struct(F.negative("n").alias("n"), "word")).alias("all")).where("size(all) > 1")
    ranked = beside.select(F.array_sort("all").alias("all")).select("all", F.explode("all").alias("one"))
    other = F.when(F.col("one.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    met = (
        pairs.select("word", F.col("changed").alias("other"), F.col("m").alias("other_n"), F.lit(1).cast("bigint").alias("times"))
        .unionByName(pairs.select(F.col("changed").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.lit(1).cast("bigint").alias("times")))
        .unionByName(ranked.select(F.col("one.word").alias("word"), other["word"].alias("other"), (-other["n"]).alias("other_n"), (F.size("all") - 1).cast("bigint").alias("times")))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    return met.groupBy("word").agg(F.sum("times").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.n")).alias("form_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where each of ``forms(word, form)`` ends. Each step doubles the way, and n grows along it, so it ends."""
    state = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage_table(state.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_staged(state)
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        state = moved


def group_variants(words: DataFrame) -> DataFrame:
    """form, root, n_near and form_n of each of ``words(word, n)``.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near word with the largest n, the
    smallest by code point of equals, if it has TIMES the word's n at least, else null; ``root`` is where forms lead.
    Words are distinct and not null; an empty table gives an empty result.
    """
    words = stage_table(words.select("word", "n"), "vocabulary")
    near = stage_table(near_words(words), "near")
    led = F.col("form_n") >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n"))
    found = stage_table(found, "forms")
    roots = follow_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all ``documents``, some of which have lost a character."""
    return group_variants(count_words(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS who, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
r AS (SELECT who, run, count(*) AS n, hex(encode(who || ':' || run)) AS bytes FROM d WHERE length(run) >= 6 GROUP BY who, run),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(4 * length(bytes)), lambda j:
      CASE WHEN j % 8 = 0 THEN ('0x' || substr(bytes, j // 4 + 1, 2))::BIGINT ELSE 0 END)),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS h FROM r),
v AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
w AS (SELECT word, n FROM v WHERE length(word) >= 6 AND n >= 5),
x AS (SELECT DISTINCT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM x AS a JOIN x AS b ON a.place = b.place AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -other_n, other := other)) AS best FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 5 * w.n THEN best.other END AS form, CASE WHEN -best.n >= 5 * w.n THEN -best.n END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word),
t AS (
  WITH RECURSIVE walk(word, root) AS (
    SELECT word, form FROM f WHERE form IS NOT NULL
    UNION SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL)
  SELECT walk.word, max_by(walk.root, f.n) AS root FROM walk JOIN f ON f.word = walk.root GROUP BY walk.word)
SELECT f.word, form, coalesce(root, f.word) AS root, f.n, n_near, form_n FROM f LEFT JOIN t ON t.word = f.word
"""
