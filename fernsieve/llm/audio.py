"""Chroma fingerprints of recordings, and their alignment.

Frames of pitch-class energy form an image twelve classes high; sixteen filters compare sums of rectangles, read from
the integral image, and give two bits each: one packed integer for each frame. Every integer is indexed. A query's
integers are looked up in all forms that noise makes of them first, by turning the bits whose filters lie nearest to a
threshold; the hits vote for offsets, and the wrong bits at an offset with votes decide.
"""

from __future__ import annotations

import functools
import io
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import map_batches, table
from fernsieve.plans.staging import stage_table

RATE, FRAME, HOP = 8000, 1024, 256
CLASSES, SPAN = 12, 16
LOWEST, HIGHEST = 110.0, 3520.0
#: (kind, first pitch class, height, width in frames) of a filter, made by a rule.
FILTERS = [(k % 6, (5 * k) % (CLASSES - 3 - k % 3), 4 + k % 3, (4, 8, 12, 16)[k % 4]) for k in range(16)]
QUANTUM = 0.15
#: Frames that must overlap, share of bits that may be wrong, frames that must agree but for loose bits.
MIN_OVERLAP, MAX_ERRORS, MIN_VOTES = 48, 0.2, 2
#: Bits of a query's code that may be turned when it is looked up, and all ways to turn them.
LOOSE = 8
TURNS = np.array([[k >> b & 1 for k in range(1 << LOOSE)] for b in range(LOOSE)], np.int64)
#: Queries, recordings and codes of a block; frames and hits worked on at a time; size of a block's filter.
QUERIES, RECORDINGS, CODES, FRAMES, HITS, FILTER_BITS = 512, 8192, 1 << 20, 1024, 1 << 20, 22
#: Frames that are compared before alignments with too many wrong bits are dropped.
STRETCH = 32
#: A recording made of a vector: one note for each number.
NOTE, LOW_NOTE, NOTES, REACH = 512, 57, 36, 0.5
#: Notes that an excerpt of the query lacks at its beginning, and the noises of excerpts.
EXCERPT, NOISES = 12, (0.05, 0.10)


def samples_of_wav(data: bytes | None) -> np.ndarray:
    """Mono samples from -1 to 1 of 8-, 16-, 24- or 32-bit PCM, brought to RATE by linear interpolation.

    None of null, of other bytes and of a rate of zero; a sample that is cut off is left out.
    """
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if rate <= 0 or width not in (1, 2, 3, 4):
        return np.zeros(0)
    raw = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, channels, width)
    if width == 1:
        x = raw[:, :, 0].astype(np.float64) - 128  # the only width without a sign
    else:
        x = sum(raw[:, :, k].astype(np.int64) << 8 * k for k in range(width)).astype(np.float64)
        x -= (x >= 1 << 8 * width - 1) * float(1 << 8 * width)
    x = x.mean(axis=1) / (1 << 8 * width - 1)
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


def samples_of_vector(vector: list[float] | None) -> np.ndarray:
    """A melody: each number is a note, NOTES of them between -REACH and REACH; beyond, the pitch classes go on in turn.

    A missing or infinite number is a rest.
    """
    v = np.array([np.nan if x is None else x for x in vector or ()], float)
    sounds = np.isfinite(v)
    step = np.floor((np.where(sounds, v, 0) + REACH) / (2 * REACH) * NOTES) % NOTES  # whole octaves
    pitch = 440.0 * 2.0 ** ((step + LOW_NOTE - 69) / 12)
    tone = np.sin(2 * np.pi * pitch[:, None] * np.arange(NOTE) / RATE) * np.hanning(NOTE)
    return (tone * sounds[:, None]).ravel()


def pitch_classes() -> np.ndarray:
    """(bins, CLASSES): which class a bin of the spectrum counts for."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), CLASSES))
    inside = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[inside, np.round(12 * np.log2(f[inside] / 440.0)).astype(int) % CLASSES] = 1
    return out


BINS, TAPER = pitch_classes(), np.hanning(FRAME)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 32-bit integers, one for each SPAN frames in a row, and the LOOSE bits of each that noise turns first.

    None if the recording is shorter.
    """
    n = (len(samples) - FRAME) // HOP + 1
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    chroma = np.concatenate([np.abs(np.fft.rfft(frames[k : k + 4096] * TAPER)) @ BINS for k in range(0, n, 4096)])
    size = np.linalg.norm(chroma, axis=1, keepdims=True)
    image = np.where(size > 1e-3, chroma / np.maximum(size, 1e-9), 0)
    total = np.zeros((n + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    m = n - SPAN + 1

    def box(a: int, y: int, w: int, h: int) -> np.ndarray:
        top, low = total[a + w : a + w + m], total[a : a + m]
        return top[:, y + h] - low[:, y + h] - top[:, y] + low[:, y]

    ratios = np.empty((m, len(FILTERS)))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole = box(0, y, w, h)
        if kind == 0:  # the whole against the other classes
            part, rest = whole, box(0, 0, w, CLASSES) - whole
        elif kind == 1:  # upper against lower half
            part = box(0, y, w, h // 2)
            rest = whole - part
        elif kind == 2:  # earlier against later half
            part = box(0, y, w // 2, h)
            rest = whole - part
        elif kind == 3:  # quarters crosswise
            part = box(0, y, w // 2, h // 2) + box(w // 2, y + h // 2, w - w // 2, h - h // 2)
            rest = whole - part
        elif kind == 4:  # middle third of the classes
            part = box(0, y + h // 3, w, h - 2 * (h // 3))
            rest = whole - part
        else:  # middle of the time
            part = box(w // 4, y, w // 2, h)
            rest = whole - part
        ratios[:, k] = np.log((1 + part) / (1 + rest))
    level = np.digitize(ratios, (-QUANTUM, 0.0, QUANTUM))
    place = 30 - 2 * np.arange(len(FILTERS))
    codes = ((level ^ level >> 1) << place).sum(axis=1)
    # how far each bit lies from turning: the upper one of a filter at zero, the lower one at either quantum
    margins = np.stack([np.abs(ratios), np.abs(np.abs(ratios) - QUANTUM)], axis=2).reshape(m, -1)
    loose = np.argpartition(margins, LOOSE, axis=1)[:, :LOOSE]
    return codes, (1 << (31 - loose)).sum(axis=1)


def fingerprint_recordings(df: DataFrame, column: str, key: str, samples: Callable[[object], np.ndarray]) -> DataFrame:
    """``key``, ``codes`` and ``loose`` (the bits of each code that noise turns first, as a mask) of each row.

    Null, unreadable or short recordings have none. One row for each row of ``df``; other columns are not read.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        got = [fingerprint(samples(x)) for x in cols["value"]]
        return {"key": cols["key"], "codes": [c for c, _ in got], "loose": [x for _, x in got]}

    return map_batches(df.selectExpr(f"`{key}` AS key", f"`{column}` AS value"), work, "key bigint, codes array<bigint>, loose array<bigint>").withColumnRenamed("key", key)


class Index:
    """The codes of a block of recordings in sorted order, behind a filter on their hashes."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(codes)
        self.order = np.argsort(self.flat, kind="stable")
        self.codes, self.first, self.many = np.unique(self.flat[self.order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(codes)), self.sizes)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.slot(self.codes)] = True

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def overlap(self, n: int, owner: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Frames that ``n`` codes, shifted by each offset, share with each recording."""
        return np.minimum(n, self.sizes[owner] - offset) - np.maximum(0, -offset)

    def histogram(self, codes: np.ndarray, loose: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, offset, votes): at how many frames a code, but for turned loose bits, stands in a recording.

        Offsets at which fewer than ``least`` frames overlap are left out.
        """
        wide = len(codes) + int(self.sizes.max()) + 1
        keys, votes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for first in range(0, len(codes), FRAMES):
            c, mask = codes[first : first + FRAMES], loose[first : first + FRAMES]
            bits = np.nonzero(np.unpackbits(mask.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))[1].reshape(len(c), LOOSE)
            probes = (c[:, None] ^ ((1 << bits) @ TURNS)).ravel()
            there = np.flatnonzero(self.seen[self.slot(probes)])
            place = np.minimum(np.searchsorted(self.codes, probes[there]), len(self.codes) - 1)
            hit = self.codes[place] == probes[there]
            there, lo, many = there[hit], self.first[place[hit]], self.many[place[hit]]
            ends = np.cumsum(many)
            at = 0
            while at < len(there):  # a code that very many frames have is worked through a bounded number at a time
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
                n = many[at:stop]
                where = self.order[np.repeat(lo[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                owner = self.owner[where]
                offset = where - self.starts[owner] - np.repeat(there[at:stop] // TURNS.shape[1] + first, n)
                long = self.overlap(len(codes), owner, offset) >= least
                key, count = np.unique(owner[long] * (2 * wide) + offset[long] + wide, return_counts=True)
                keys.append(key)
                votes.append(count)
                held += len(key)
                at = stop
                if held > 4 * HITS:
                    keys, votes = map(list, zip(summed(keys, votes)))
                    held = len(keys[0])
        key, count = summed(keys, votes) if len(keys) > 2 else (keys[-1], votes[-1])
        return key // (2 * wide), key % (2 * wide) - wide, count

    def errors(self, codes: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(wrong bits, frames that overlap) of ``codes`` shifted by each offset against each recording.

        Frames are compared from the first; wrong bits are counted no further once they are more than MAX_ERRORS allows.
        """
        frames = self.overlap(len(codes), owner, offset)
        wrong, limit, first = np.zeros(len(owner), np.int64), MAX_ERRORS * 32 * frames, np.maximum(0, -offset)
        there = self.starts[owner] + offset + first
        for low in range(0, len(owner), HITS // STRETCH):
            left, at, stretch = np.arange(low, min(len(owner), low + HITS // STRETCH)), 0, STRETCH
            while len(left):
                t = at + np.arange(stretch)
                inside = t < frames[left, None]
                mine, other = codes[np.where(inside, first[left, None] + t, 0)], self.flat[np.where(inside, there[left, None] + t, 0)]
                wrong[left] += (np.bitwise_count(mine ^ other) * inside).sum(axis=1, dtype=np.int64)
                at += stretch
                left = left[(wrong[left] <= limit[left]) & (frames[left] > at)]
                if len(left):  # few long recordings in long stretches
                    stretch = min(max(STRETCH, HITS // 8 // len(left)), int((frames[left] - at).max()))
        return wrong, frames


def summed(keys: list[np.ndarray], votes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(votes), len(key)).astype(np.int64)


def aligned(index: Index, codes: np.ndarray, loose: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(recording, offset, votes, errors) of each recording that passes; of several offsets that with most right less wrong bits."""
    owner, offset, votes = index.histogram(codes, loose, MIN_OVERLAP)
    likely = votes >= MIN_VOTES
    owner, offset, votes = owner[likely], offset[likely], votes[likely]
    wrong, frames = index.errors(codes, owner, offset)
    good = np.flatnonzero(wrong <= MAX_ERRORS * 32 * frames)
    balance = 32 * frames[good] - 2 * wrong[good]
    good = good[np.lexsort((offset[good], -balance, owner[good]))]
    good = good[np.unique(owner[good], return_index=True)[1]]
    for k in good:
        yield int(owner[k]), int(offset[k]), int(votes[k]), int(wrong[k]) / (32 * int(frames[k]))


def blocks_of(classes: DataFrame, most: int, columns: list[str], name: str) -> DataFrame:
    """Blocks of at most ``most`` recordings and about CODES codes: ids, sizes, and each of ``columns`` end to end. A table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x.column(0).to_numpy() for x in held])
            sizes = np.concatenate([np.diff(x.column(1).offsets.to_numpy()) for x in held]).astype(np.int64)
            flat = [np.concatenate([x.column(k + 1).flatten().to_numpy() for x in held]) for k in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64())) for v in (ids, sizes, *flat)], names=kinds)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = most - sum(x.num_rows for x in held)
                codes = CODES - sum(len(x.column(1).flatten()) for x in held)
                part = batch.slice(at, room)
                fits = max(int(np.searchsorted(part.column(1).offsets.to_numpy() - part.column(1).offsets.to_numpy()[0], codes, "right")) - 1, 0)
                if fits == 0 and not held:
                    fits = 1  # a recording stays whole
                if fits:
                    held.append(part.slice(0, fits))
                    at += fits
                if fits < part.num_rows or fits == room:
                    yield block()
                    held.clear()
        if held:
            yield block()

    kinds = [f"{name}_{x}" for x in ("ids", "sizes", *columns)]
    dealt = classes.repartition(max(1, -(-classes.count() // most)))
    return stage_table(dealt.select("id", *columns).mapInArrow(pack, ", ".join(f"{k} array<bigint>" for k in kinds)), f"blocks-{name}")


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids_q, sizes_q, codes_q, loose_q, ids_m, sizes_m, codes_m = (batch.column(c)[k].values.to_numpy() for c in range(7))
            index = Index(np.split(codes_m, np.cumsum(sizes_m)[:-1]))
            cuts, found = np.cumsum(sizes_q)[:-1], []
            for query, codes, loose in zip(ids_q.tolist(), np.split(codes_q, cuts), np.split(loose_q, cuts)):
                found += [(query, int(ids_m[m]), *rest) for m, *rest in aligned(index, codes, loose) if ids_m[m] != query]
            if found:
                q, m, off, votes, errors = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(m), pa.array(off, pa.int32()), pa.array(votes, pa.int64()), pa.array(errors, pa.float64())], names=["query", "match", "offset", "votes", "errors"])


def align_recordings(prints: DataFrame, key: str, is_query: Column) -> DataFrame:
    """Matches of the recordings that ``is_query`` picks, against all, of ``prints(key, codes, loose)``.

    Equal fingerprints form a class, named by its smallest key. The result has rows of two kinds: ``member`` says that
    recording ``member`` is in class ``query``; ``match`` says that, shifted by ``offset`` frames, class ``match`` has
    ``votes`` frames with the same code but for loose bits, and a share ``errors`` of wrong bits where both overlap.
    Every class is indexed, and every query is looked up among all of them, block by block; no code is too common.
    An offset with MIN_VOTES votes and MIN_OVERLAP frames is held against MAX_ERRORS on all bits; of several the one with
    the most right less wrong bits is given, of equal ones the smallest. Every recording is a member of one class,
    recordings without codes or key of none; repeated rows are repeated members; no rows give an empty result.
    """
    spark = prints.sparkSession
    named = prints.where(F.col(key).isNotNull() & (F.size("codes") > 0))
    digest = F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256).alias("digest")
    found = stage_table(named.select(F.col(key).alias("member"), "codes", "loose", digest, is_query.alias("asks")), "prints")
    least = F.min(F.struct(F.col("member").alias("id"), "codes", "loose"))
    classes = stage_table(found.groupBy("digest").agg(least.alias("least"), F.max("asks").alias("asks")).select("digest", "least.*", "asks"), "classes")
    members = found.join(classes.select("digest", "id"), "digest").select(F.lit("member").alias("kind"), F.col("id").alias("query"), "member")
    queries = blocks_of(classes.where("asks"), QUERIES, ["codes", "loose"], "q")
    cells = queries.crossJoin(blocks_of(classes, RECORDINGS, ["codes"], "m"))  # of blocks: the stated queries against all
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = cells.repartition(tasks).mapInArrow(compare_blocks, "query bigint, match bigint, offset int, votes bigint, errors double")
    matches = judged.select(F.lit("match").alias("kind"), "query", "match", "offset", "votes", "errors")
    return members.unionByName(matches, allowMissingColumns=True).select("kind", "query", "member", "match", "offset", "votes", "errors")


def noisy_excerpt(vector: list[float] | None, noise: float) -> np.ndarray:
    """A recording of the melody that begins EXCERPT notes late, with noise of that size; the same each time."""
    samples = samples_of_vector(vector)[EXCERPT * NOTE :]
    return samples + np.random.default_rng(zlib.crc32(repr(vector).encode())).normal(0, noise, len(samples))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` as a melody; those whose id is divisible by 50 are looked for among all.

    So are two noisy excerpts of each of these, made from the same rows since no two melodies of the table are alike: of
    vector k with noise NOISES[j], under the id -1 - (2 k + j). They are recordings like all others.
    """
    vectors, asked = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0
    prints = fingerprint_recordings(vectors, "embedding", "vec_id", samples_of_vector)
    for j, noise in enumerate(NOISES):
        some = vectors.where(asked).select((-1 - (2 * F.col("vec_id") + j)).alias("vec_id"), "embedding")
        prints = prints.unionByName(fingerprint_recordings(some, "embedding", "vec_id", functools.partial(noisy_excerpt, noise=noise)))
    return align_recordings(prints, "vec_id", asked | (F.col("vec_id") < 0))
