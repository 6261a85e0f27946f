"""Substring dedup by compacting the de Bruijn graph of token k-mers.

An edge of the graph is a window of WINDOW words, between the windows of one word less that it begins and ends with.
Edges that repeat are found without shuffling every one: consecutive edges that share a minimizer (the word k-mer with
the least hash among a window's) travel as one piece, with the digest of its words. All edges of a piece that
occurs twice repeat; where different pieces have one minimizer they may share a part, so just those are cut into single
edges again.

The repeated pieces are then compacted through joins: where a piece is always followed by one and the same piece, and that
one always preceded by it, the node between them does not branch, and both become one path. Every occurrence of such
a path is whole, so its source coordinates (text, first edge, number of edges) name a span of its words, and what
all rows with a path cut out is the same.

A digest is 128 bits over the very words at the source coordinates, in their order; pieces and edges are equal if theirs are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernsieve.llm.common import SLOTS, bytes_of, is_set, map_batches, mix, slots_of, table
from fernsieve.plans.staging import drop_staged, stage_table

WINDOW, KMER = 35, 15
BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2 ** 64
LONGEST = 64  # a multiple of 8
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self) -> None:
        self.inverse, self.up, self.down = pow(BASE, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


POWERS = Powers()


class Words:
    """The words of one text, joined by a space, and where each begins; one more start is where the next would."""

    def __init__(self, words: list[bytes], window: int) -> None:
        self.joined, self.window = b" ".join(words), window
        spaces = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)  # no word holds one
        self.starts = np.concatenate([[0], spaces + 1, [len(self.joined) + 1]])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes of all words at a time; words over LONGEST bytes go one by one."""
        starts, sizes = self.starts[:-1], np.diff(self.starts)
        eights = np.ndarray(len(self.joined) + 2, "<u8", self.joined + b" " + bytes(8), 0, (1,))  # the eight bytes from each place on
        out = np.zeros(len(sizes), np.uint64)
        for k in range(0, min(int(sizes.max()), LONGEST), 8):
            which = np.flatnonzero(sizes > k)
            got = (out[which] ^ (eights[starts[which] + k] & LOW_BYTES[np.minimum(sizes[which] - k, 8)])) * np.uint64(BASE)
            out[which] = got ^ (got >> np.uint64(29))
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.joined[self.starts[k] : self.starts[k + 1] - 1])
        return out

    def digests(self, first: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(run, 2) longs: 128 bits of the words that runs of edges stand on."""
        a, b = self.starts[first].tolist(), (self.starts[first + edges + self.window - 1] - 1).tolist()
        joined, digest = self.joined, xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(a, b)]), "<i8").reshape(-1, 2)


class Pieces(Words):
    """The pieces of one text: first edge, number of edges, hash of the minimizer, digest of the words."""

    def __init__(self, words: list[bytes], window: int, kmer: int) -> None:
        super().__init__(words, window)
        hashes = self.hashes()
        up, down = POWERS.upto(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        at = len(hashes) - kmer + 1
        grams = mix((sums[kmer:] - sums[:at]) * down[:at])
        n, span = len(words) - window + 1, window - kmer + 1
        least = np.empty(n, np.int64)
        for k in range(0, n, 1 << 15):
            part = np.lib.stride_tricks.sliding_window_view(grams[k : k + (1 << 15) + span - 1], span)
            least[k : k + len(part)] = np.arange(k, k + len(part)) + part.argmin(axis=1)
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        self.edges = np.diff(np.concatenate([self.first, [n]]))
        self.minimizer = grams[least[self.first]].view(np.int64)


def gathered(names: list[str], rows: list[tuple]) -> dict[str, np.ndarray]:
    """Columns of numbers from one tuple of equally long arrays for each text."""
    return {n: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k, n in enumerate(names)}


def pieces_of(keyed: DataFrame, window: int, kmer: int) -> DataFrame:
    """One row for each piece of each text with at least ``window`` words."""

    def work(cols: dict[str, list]) -> dict[str, np.ndarray]:
        rows = []
        for r1, r2, text in zip(cols["r1"], cols["r2"], cols["text"]):
            words = bytes_of(text).split()
            if len(words) >= window:
                p = Pieces(words, window, kmer)
                d, n = p.digests(p.first, p.edges), len(p.first)
                rows.append((np.full(n, r1), np.full(n, r2), p.first, p.edges, p.minimizer, d[:, 0], d[:, 1]))
        return gathered(["r1", "r2", "first", "edges", "minimizer", "d1", "d2"], rows)

    return map_batches(keyed.select("r1", "r2", "text"), work, "r1 bigint, r2 bigint, first bigint, edges bigint, minimizer bigint, d1 bigint, d2 bigint")


def edges_of(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The single edges of the pieces ``wanted(r1, r2, first, edges, minimizer)``, with their digests, once for each row of ``keyed``."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_set(F.struct("first", "edges", "minimizer")).alias("pieces"))  # as many as one text has pieces
    lists = lists.select("r1", "r2", "pieces.first", "pieces.edges", "pieces.minimizer")

    def work(cols: dict[str, list]) -> dict[str, np.ndarray]:
        rows = []
        for r1, r2, text, *pieces in zip(*(cols[c] for c in ("r1", "r2", "text", "first", "edges", "minimizer"))):
            first, edges, minimizer = (np.array(x, np.int64) for x in pieces)
            first = np.repeat(first, edges) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
            d, n = Words(bytes_of(text).split(), window).digests(first, np.ones_like(first)), len(first)
            rows.append((np.full(n, r1), np.full(n, r2), first, np.repeat(minimizer, edges), d[:, 0], d[:, 1]))
        return gathered(["r1", "r2", "first", "minimizer", "d1", "d2"], rows)

    one = keyed.select("r1", "r2", "text").join(lists, ["r1", "r2"])
    return map_batches(one, work, "r1 bigint, r2 bigint, first bigint, minimizer bigint, d1 bigint, d2 bigint")


def with_partner(pieces: DataFrame) -> DataFrame:
    """The rows of ``pieces``, a table, whose minimizer others have too, and the few that share a bit of the filter with one. A table.

    Only minimizers are shuffled for this, counted before; a filter of SLOTS bits, whatever the corpus, does the rest.
    """
    shared = pieces.groupBy("minimizer").agg(F.count("*").alias("many")).where("many > 1")
    bits = pieces.sparkSession.sparkContext.broadcast(slots_of(shared.select(F.col("minimizer").bitwiseAND(SLOTS - 1).alias("slot"))))  # 8 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minimizer = batch.column(4).to_numpy()
            yield batch.filter(pa.array(is_set(bits.value, minimizer & (SLOTS - 1))))

    return stage_table(pieces.mapInArrow(work, pieces.schema), "shared")


def repeated_pieces(keyed: DataFrame, window: int, kmer: int) -> DataFrame:
    """(r1, r2, first, edges, d1, d2, copies) of the pieces, and single edges, whose words stand somewhere else too. A table.

    An edge of a piece that is repeated as a whole is not given once more. ``copies`` counts occurrences of the digest.
    """
    pieces = stage_table(pieces_of(keyed, window, kmer), "pieces")
    shared = with_partner(pieces)
    drop_staged(pieces)
    digest = ["minimizer", "d1", "d2"]
    # equal pieces: partial counts before the shuffle, so a hot one is a row for each task
    counted = stage_table(shared.groupBy(*digest).agg(F.count("*").alias("copies"), F.min(F.struct("r1", "r2", "first", "edges")).alias("source")), "counted")
    several = stage_table(counted.groupBy("minimizer").agg(F.count("*").alias("kinds")).where("kinds > 1").select("minimizer"), "several")
    twice = stage_table(counted.where("copies > 1").select(*digest, "copies"), "twice")
    whole = shared.join(twice, digest).select("r1", "r2", "first", "edges", "d1", "d2", "copies")
    # where a minimizer has several kinds of pieces, one of each kind is cut into edges
    cut = stage_table(counted.join(several, "minimizer").select("source.*", "minimizer", "copies"), "cut")
    edges = stage_table(edges_of(keyed, cut.drop("copies"), window), "edges")
    kinds = edges.groupBy(*digest).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*digest)
    # of the edges that two kinds have, those are still to be named that stand in a piece without a copy
    lone = cut.where("copies = 1").select("r1", "r2", F.explode(F.sequence("first", F.col("first") + F.col("edges") - 1)).alias("first"))
    single = edges.join(lone, ["r1", "r2", "first"], "left_semi").join(kinds, digest).select("r1", "r2", "first", F.lit(1).cast("bigint").alias("edges"), "d1", "d2", F.lit(0).cast("bigint").alias("copies"))
    out = stage_table(whole.union(single), "repeated")
    drop_staged(shared, counted, several, twice, cut, edges)
    return out


def compacted_paths(repeated: DataFrame) -> DataFrame:
    """(r1, r2, first, edges, p1, p2, copies): pieces of ``repeated`` joined where the node between two of them does not branch. A table.

    The node between two pieces does not branch if every occurrence of one is followed by the other and every occurrence of
    the other follows the one. Such pieces make one path, named by the digest of its first piece; ``copies`` counts
    its occurrences, all of which are whole. Single edges (``copies`` 0) stand in texts of which their piece has no other
    copy; they make paths of their own. Of rows that repeat the places are given once.
    """
    along = Window.partitionBy("r1", "r2").orderBy("first")  # the pieces of one text
    places = repeated.repartition("r1", "r2").groupBy("r1", "r2", "first").agg(F.first("edges").alias("edges"), F.first("d1").alias("d1"), F.first("d2").alias("d2"), F.first("copies").alias("copies"), F.count("*").alias("rows"))
    goes_on = (F.lead("first").over(along) == F.col("first") + F.col("edges")) & (F.col("copies") > 1) & (F.lead("copies").over(along) == F.col("copies"))
    following = places.withColumn("n1", F.when(goes_on, F.lead("d1").over(along))).withColumn("n2", F.when(goes_on, F.lead("d2").over(along)))
    followed = stage_table(following, "followed")
    # how often each two pieces follow each other: partial counts, a row for each two and task
    both = ["d1", "d2", "n1", "n2"]
    pairs = followed.where("n1 IS NOT NULL").groupBy(*both).agg(F.sum("rows").alias("times"), F.max("copies").alias("copies"))
    links = stage_table(pairs.where("times = copies").select(*both), "links")
    chained = followed.where("n1 IS NOT NULL").join(links, both, "left_semi").select("r1", "r2", "first", F.lit(True).alias("open"))
    joined = followed.drop("n1", "n2", "rows").join(chained, ["r1", "r2", "first"], "left")
    starts = F.when(F.lag("open").over(along), 0).otherwise(1)
    numbered = joined.withColumn("starts", starts).withColumn("number", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = numbered.groupBy("r1", "r2", "number").agg(F.min("first").alias("first"), F.sum("edges").alias("edges"), F.min_by("d1", "first").alias("p1"), F.min_by("d2", "first").alias("p2"), F.max("copies").alias("copies"))
    out = stage_table(paths.drop("number"), "paths")
    drop_staged(repeated, followed, links)
    return out


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` and two longs that name a row's doc_id and text; rows that repeat both share them."""
    name = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text")
    return docs.withColumn("r1", name(1)).withColumn("r2", name(2))


def repeated_paths(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, first_word, n_words, path, copies) of every long repeated span of ``docs(doc_id, text)``.

    Words are counted from 0. ``path`` (32 hex digits) is the same wherever the same span is found; ``copies`` counts its
    occurrences, 0 for single windows inside a text that are repeated in spans of other extent. Rows that repeat doc_id
    and text give their spans once; null and short texts give none.
    """
    keyed = named_rows(docs.select("doc_id", "text"))
    paths = compacted_paths(repeated_pieces(keyed, window, kmer))
    ids = keyed.select("r1", "r2", "doc_id").dropDuplicates(["r1", "r2"])
    path = F.concat(F.lpad(F.hex("p1"), 16, "0"), F.lpad(F.hex("p2"), 16, "0")).alias("path")
    return paths.join(ids, ["r1", "r2"]).select("doc_id", F.col("first").alias("first_word"), (F.col("edges") + window - 1).alias("n_words"), path, "copies")


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """All columns of ``docs``, n_words, n_removed and kept: the words that no repeated window covers, joined by a space.

    A window is ``window`` consecutive words of one text; it repeats if its words also start anywhere else, in the
    same text as well. Windows are judged on the input. A null text has no words, one shorter than a window keeps
    all. Rows that repeat doc_id and text are each other's copies; an empty table gives an empty result; columns
    named n_words, n_removed or kept are replaced, ``r1``, ``r2`` and ``_spans`` left out.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "r1", "r2", "_spans")]
    keyed = named_rows(docs.select(*keep))
    paths = compacted_paths(repeated_pieces(keyed.select("r1", "r2", "text"), window, kmer))
    spans = paths.groupBy("r1", "r2").agg(F.collect_list(F.struct("first", "edges")).alias("_spans"))  # at most one for each word of a text
    spans = spans.select("r1", "r2", F.array("_spans.first", "_spans.edges").alias("_spans"))

    def work(cols: dict[str, list]) -> dict[str, list]:
        spans = cols.pop("_spans")
        cols.pop("r1"), cols.pop("r2")
        out = cols | {"n_words": [], "n_removed": [], "kept": []}
        for text, found in zip(cols["text"], spans):
            words = bytes_of(text).split()
            out["n_words"].append(len(words))
            if found:
                first, edges = np.array(found, np.int64)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + edges + window - 1, -1)
                words = list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
            out["n_removed"].append(out["n_words"][-1] - len(words))
            out["kept"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return out

    kinds = dict(docs.dtypes)
    return map_batches(keyed.join(spans, ["r1", "r2"], "left"), work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_words bigint, n_removed bigint, kept string"]))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
e AS (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS words,
             count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
h AS (SELECT r, i, sha256(words) AS h FROM e WHERE n = 35),
c AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h JOIN c USING (h)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
