"""What the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernsieve.plans.staging import let_workers_import, stage_table

#: Rows, and about so many bytes, that are worked on at a time: long texts stay well inside a worker's memory. Spark ends a
#: batch at 64 MB by itself, so no operator sets the session's number of rows, which other plans would see.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: Words whose hashes a worker remembers.
MOST_HASHES = 250_000
#: Rows of a batch of short rows that is given out, and bits of a filter.
NUMBER_ROWS, SLOTS = 1 << 13, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A word, as every operator that counts them takes it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model may learn from; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def share_by_hash(key: Column, seed: int, wanted: int, have: int) -> Column:
    """Picks about ``wanted`` of ``have`` rows by a 64-bit hash of ``key``, however many rows there are."""
    if wanted >= have:
        return F.lit(True)
    return F.xxhash64(key, F.lit(seed)) < F.lit(-(1 << 63) + (1 << 64) * wanted // have)


def bounded_sample(texts: DataFrame, characters: int) -> DataFrame:
    """A table of ``texts(text, ...)``, or, if they have more than ``characters``, of a share of them by a hash of the text.

    ``texts`` is a sample already: this bounds what is sent to the driver where texts are long.
    """
    sample = stage_table(texts, "sample")
    have = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    return sample.where(share_by_hash(F.col("text"), 31, characters, have))


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of BATCH_ROWS rows and about BATCH_BYTES at most; one row is never split."""
    at = 0
    while at < batch.num_rows:
        rows = min(BATCH_ROWS, batch.num_rows - at)
        part = batch.slice(at, rows)
        while rows > 1 and part.nbytes > BATCH_BYTES:
            rows //= 2
            part = batch.slice(at, rows)
        yield part
        at += rows


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``work`` to columns as Python lists, a bounded number of rows at a time, on the executors."""
    from pyspark.sql.types import StructType

    let_workers_import(df.sparkSession)
    kinds = pa.schema([(f.name, arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bytes_of(text: str | None) -> bytes:
    """UTF-8 of a text; of null nothing."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def row_key() -> Column:
    """16 bytes that name a row of ``doc_id`` and ``text``: rows that repeat both share it, all others differ."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part("doc_id"), F.lit("\n"), part("text"))))


def lower(text: str) -> str:
    """Lower case with every character in its place: the few capitals that become two characters stay."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_HASHES:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(values: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits, whatever the corpus: those that the longs of ``values(slot)``, from 0 to SLOTS, name."""
    got = values.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    return bits


def is_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return bits[slot >> 6] >> (slot & 63) & 1 == 1


_KEPT: dict[str, object] = {}
_AT: list[str] = []


def hand_back_memory() -> None:
    """Gives the memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library, which keeps what is freed
    if trim:
        trim(0)


def work_begins(name: str) -> None:
    """Drops what the worker keeps of other work than ``name``, models of earlier tasks included, and hands free memory back.

    Workers serve all stages in turn, and only what the present stage needs should fill their memory.
    """
    if _AT != [name]:
        _AT[:] = [name]
        _KEPT.clear()
        hand_back_memory()


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """A cache that a Python worker keeps from task to task; asking for another name drops the one before."""
    work_begins(name)
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def running_sums(df: DataFrame, group: str, order: Sequence[str], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """Add to each row the sums, its own value included, over the rows of its ``group`` up to it along ``order``.

    Built-in functions only. Rows are dealt to ranges of (group, order), so a group of any size lies in many tasks; what
    joins the ranges is at most two rows for each, the sums of their first and last group. Rows that are equal in
    ``order`` are summed in any order among themselves. ``group`` must not be null.
    """
    columns, names = df.columns, list(sums)
    dealt = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()]).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stage_table(dealt, name)
    ends = dealt.groupBy("_part").agg(F.min(group).alias("_low"), F.max(group).alias("_high"))
    across = dealt.join(F.broadcast(ends), "_part").where((F.col(group) == F.col("_low")) | (F.col(group) == F.col("_high")))
    totals = across.groupBy("_part", F.col(group).alias("_group")).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])  # two rows a range
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_part").alias("_in"), "_group", *[F.sum(f"_v_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    upto = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(f"_v_{n}").over(upto).alias(f"_u_{n}") for n in names])
    joined = local.join(F.broadcast(carried), (F.col("_part") == F.col("_in")) & (F.col(group) == F.col("_group")), "left")
    return joined.select(*columns, *[(F.col(f"_u_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in names])
