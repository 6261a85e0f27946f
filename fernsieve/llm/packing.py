"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length.

Documents are packed by length alone, so the plan needs only how many pieces have each length: at most ``capacity``
numbers, whatever the corpus. The plan is best-fit decreasing over those classes; a segment tree over remaining
capacities finds the tightest open bin. Equally full bins stand together, as ranges of sequence numbers, and so do
equally long pieces, as ranges of ranks; each range of ranks goes to a range of bins at one offset. Ranks come from
counts of (length, salt), so no length has to be ordered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernsieve.llm.bpe import Encoder, number, vocabulary_path
from fernsieve.llm.common import map_batches, table
from fernsieve.plans.staging import stage_table

CAPACITY = 2048
#: Parts of each length that are ranked apart from each other.
SALTS = 256
RANK_BITS = 44


class TightestBin:
    """Segment tree over remaining capacities; a leaf is set while a bin with just that much room is open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def put(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def find(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open bin has."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, number of ranks, first bin, offset) of ``counts[length]`` pieces each.

    The same bins as best-fit decreasing makes piece by piece: a bin that has just got a piece is tighter than before,
    so it takes pieces of that length until it has no room for another.
    """
    tree, rooms, bins, out = TightestBin(capacity), {}, 0, []

    def shelve(room: int, first: int, many: int) -> None:
        if room and many:
            rooms.setdefault(room, []).append((first, many))
            tree.put(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                each = capacity // length
                room, first, many = capacity, bins, -(-left // each)
                bins += many
            else:
                first, many = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
            each = room // length
            full = min(many, left // each)
            for layer in range(each if full else 0):
                out.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            shelve(room - each * length, first, full)
            first, many = first + full, many - full
            if many and left:  # fewer than one bin holds
                for layer in range(left):
                    out.append((length, rank, 1, first, capacity - room + layer * length))
                    rank += 1
                shelve(room - left * length, first, 1)
                left, first, many = 0, first + 1, many - 1
            shelve(room, first, many)
    return out


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row for each piece of each document: ids of the whole text and the separator, cut at ``capacity``."""

    def work(cols: dict[str, list]) -> dict[str, list]:
        e = Encoder.of(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, data in zip(cols["doc_id"], e.encode_many(cols["text"])):
            data += number(separator)
            for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                part = data[4 * start : 4 * (start + capacity)]
                for k, v in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part))):
                    out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which have a ``length`` of 1 to ``capacity`` each.

    ``pieces`` is read twice and should be a table. Equal rows get places of their own. Every other column is kept.
    """
    keys = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias("_salt"))
    counts = salted.groupBy("length", "_salt").count()  # at most capacity * salts rows
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_start"))
    classes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(best_fit(classes, capacity)), dtype=np.int64).reshape(-1, 5)
    first = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    order = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(starts, ["length", "_salt"]).select(*keys, (F.col("_start") + F.col("_rank") - 1).alias("_rank"))
    shared = pieces.sparkSession.sparkContext.broadcast((first, plan[:, 1], plan[:, 3], plan[:, 4]))  # the plan's size follows the capacity alone

    def work(cols: dict[str, list]) -> dict[str, list]:
        first, ranks, bins, offsets = shared.value
        rank = np.array(cols.pop("_rank"), np.int64)
        at = np.searchsorted(first, (np.array(cols["length"], np.int64) << RANK_BITS) + rank, "right") - 1
        return cols | {"sequence_id": (bins[at] + rank - ranks[at]).tolist(), "offset": offsets[at].tolist()}

    kinds = dict(pieces.dtypes)
    return map_batches(ranked, work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sequence_id bigint", "offset bigint"]))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Pack whole documents (null text: only the separator); one row for each piece.

    Only documents of more than ``capacity`` ids are cut. An empty table gives an empty result; rows that share a
    doc_id are packed as documents of their own; columns other than doc_id and text are not read.
    """
    return pack(stage_table(cut_documents(docs, path or vocabulary_path(), capacity, separator), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
