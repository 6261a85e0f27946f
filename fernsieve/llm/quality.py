"""Quality rules: counts over words and lines, and compression bands.

Zstandard's ratio of the whole text and of fixed chunks tells repetitive text (it shrinks far too well) and
incompressible text (keys, encoded data, noise) from prose. How far prose shrinks depends on its length, so the limits
do as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from fernsieve.llm.common import bytes_of, map_batches, table

SYMBOLS = b"#*$%&|<>"
WINDOW, CHUNK = 8, 4096
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Fixed limits: up to so many bytes, the smallest and the largest ratio (bytes before by bytes after) of a whole text.
#: The smallest lie between random base64 words and prose of the length; up to 80 bytes the two cannot be told apart.
BANDS = ((80, 0.0, 4.0), (120, 0.98, 4.0), (160, 1.05, 4.0), (200, 1.08, 4.0), (256, 1.13, 4.0), (320, 1.16, 4.0), (400, 1.2, 4.0), (550, 1.25, 4.0), (700, 1.28, 4.0), (1024, 1.33, 4.0), (1500, 1.38, 3.8), (2048, 1.42, 3.8), (4096, 1.45, 3.8), (16384, 1.55, 4.0), (65536, 1.6, 4.8), (1 << 62, 1.6, 6.0))
#: The same for one chunk of CHUNK bytes (the last, shorter one has those of its length), and the share of bytes in chunks outside them that rejects a text.
CHUNK_LIMITS, MAX_BAD_CHUNKS = (1.45, 4.5), 0.5
LEVEL = 3
EMPTY_LINE = re.compile(rb"[\x20\x09-\x0D]*")


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def code_points(data: bytes) -> int:
    """Characters of UTF-8 data: all bytes but those that continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    # windows are named exactly: each doubling names pairs of names
    width = 1
    while width < WINDOW:
        pair = code[: len(code) - width] * (int(code.max()) + 1) + code[width:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def count(data: bytes) -> Counts:
    words = data.split()  # of bytes: at just the six ASCII white-space characters
    seen: set[bytes] = set()
    copies = 0
    for line in data.split(b"\n"):
        if not EMPTY_LINE.fullmatch(line):
            copies += line in seen
            seen.add(line)
    return Counts(len(words), code_points(b"".join(words)), sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), copies, repeated_words(words))


def limits_of(size: int) -> tuple[float, float]:
    return next((a, b) for most, a, b in BANDS if size <= most)


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of the bytes in chunks outside their limits, and whether both lie within the bands."""
    if not data:
        return 1.0, 0.0, True
    ratio = len(data) / len(packer.compress(data))
    low, high = limits_of(len(data))
    bad = 0
    for k in range(0, len(data), CHUNK):
        c = data[k : k + CHUNK]
        least, most = CHUNK_LIMITS if len(c) == CHUNK else limits_of(len(c))
        bad += 0 if least <= len(c) / len(packer.compress(c)) <= most else len(c)
    return ratio, bad / len(data), low <= ratio <= high and bad <= MAX_BAD_CHUNKS * len(data)


def judge_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row of ``docs(doc_id, text)``.

    A null or empty text has no words and so fails the base rules. Each row is judged alone, so repeated rows get
    equal results and an empty table an empty one; other columns are not read.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            data = bytes_of(text)
            c = count(data)
            failed = c.n_words < MIN_WORDS or 100 * c.n_repeat_words > MAX_REPEAT_PERCENT * c.n_words
            ratio, bad, fits = compression(data, packer)
            for k, v in zip(out, (doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, fits and not failed, ratio, bad)):
                out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, bad_chunks double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
