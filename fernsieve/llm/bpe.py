"""BPE encoding by tree concatenation, and decoding.

A text is halved until its parts are short; the parts are encoded, and neighbours are joined by encoding a window
around the cut again, growing it until it agrees with both sides. Agreement is a token with the same bytes at the same
place in the window and in the side. That is enough to be exact: a sequence is the encoding of its text if and only
if each two neighbours in one pre-token are the encoding of theirs, and every such pair in the joined sequence
stands in the left part, in the window or in the right part, with the same end-of-word mark.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, normalizers

from fernsieve.llm.common import kept_in_worker, map_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Characters of a part that is encoded whole, first reach of a window, longest word and pre-token that is remembered.
LEAF, REACH, LONGEST_KEPT = 4096, 48, 40
#: Bytes (about) of the words and of the pre-tokens that a worker remembers, and of one entry besides its text and ids.
WORD_BYTES, PIECE_BYTES, ENTRY_BYTES = 112 << 20, 56 << 20, 200
#: Characters whose splitting and lower case are the same in Python as in the tokenizer: ASCII, Latin-1 letters, common punctuation.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡§«·»¿À-ÿ–—‘’“”…]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
END, IDS = "</w>", "<u4"
#: What Unicode calls white space; Python's own class holds the separators U+001C to U+001F as well.
SPACE = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def number(i: int) -> bytes:
    return i.to_bytes(4, "little")


def check_kind(tokenizer: Tokenizer) -> None:
    """Refuses what this encoder would get wrong: it is made for lower-case words, END at their ends and no decoder."""
    made_of = json.loads(tokenizer.to_str())
    model = made_of["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or made_of["decoder"] is not None:
        raise ValueError(f"not a vocabulary of word BPE with {END} at the end of words")
    if tokenizer.normalizer is None or tokenizer.normalizer.normalize_str("  Aß Ö-1\t").split() != ["aß", "ö-1"]:
        raise ValueError("the vocabulary is not one of lower-case text")
    sample = "it's a1b ...don't 12"
    if [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(sample)] != PIECE.findall(sample):
        raise ValueError("the vocabulary splits words by another rule")


class Words(dict):
    """Ids by word; a word met for the first time gets an empty buffer, kept in ``new`` to be filled.

    What the generation before knows is taken from it: what is not asked for in a whole generation is forgotten.
    """

    def __init__(self, before: Words | None = None) -> None:
        super().__init__()
        self.before: dict[str, bytes] = before if before is not None else {}
        if before is not None:
            before.before = {}
        self.new: dict[str, bytearray] = {}
        self.bytes = 0

    def __missing__(self, word: str) -> bytes | bytearray:
        got = self.before.get(word)
        if got is not None:
            self[word] = got
            self.bytes += ENTRY_BYTES + 3 * len(word)
            return got
        self[word] = self.new[word] = buffer = bytearray()
        return buffer


class Encoder:
    """Gives the ids that the tokenizers library gives for a whole text without special tokens added."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.part = Tokenizer.from_file(path)
        check_kind(self.part)
        self.normalizer = self.part.normalizer
        added = self.part.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = self.part.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.part.id_to_token(i) or "" for i in range(size)]
        # from here on for text that is normalized already and holds no special token
        self.part.no_truncation()
        self.part.no_padding()
        self.part.normalizer = normalizers.Sequence([])
        self.part.encode_special_tokens = True
        self.ends = np.array([t.endswith(END) for t in self.tokens])
        self.bytes = [len(t) - len(END) * t.endswith(END) for t in self.tokens]  # one character stands for a byte
        self.decimals = [str(i) for i in range(size)]
        self.pieces: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}
        self.piece_bytes = 0
        self.words = Words()

    @functools.cached_property
    def whole(self) -> Tokenizer:
        """The library's own encoder."""
        got = Tokenizer.from_file(self.path)
        got.no_truncation()
        got.no_padding()
        return got

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept_in_worker(f"encoder {path}", lambda: cls(path))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; of null or an empty text none."""
        return np.frombuffer(self.encode_many([text])[0], IDS).tolist()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit numbers."""
        parts: list[list[bytes | str]] = []
        for text in texts:
            if not text:
                parts.append([])
            elif any(s in text for s in self.special):
                parts.append([number(self.special[x]) if k % 2 else self.normal(x) for k, x in enumerate(self.special_at.split(text))])
            else:
                parts.append([self.normal(text)])
        whole = [x for part in parts for x in part if isinstance(x, str)]
        leaves = iter(self.leaves([x[k : k + LEAF] for x in whole for k in range(0, len(x), LEAF)]))
        return [b"".join(x if isinstance(x, bytes) else self.tree(x, [next(leaves) for _ in range(0, len(x), LEAF)]) for x in part) for part in parts]

    def normal(self, text: str) -> str:
        return text.lower() if PLAIN.fullmatch(text) else self.normalizer.normalize_str(text)

    def leaves(self, texts: list[str]) -> list[bytes]:
        """Ids of short normalized texts: of plain ones by their words, each of which is encoded once for all."""
        words = self.words
        found = [list(map(words.__getitem__, x.split())) if PLAIN.fullmatch(x) else None for x in texts]
        if words.new:
            self.fill_words()
        out = [self.foreign(x) if ids is None else b"".join(ids) for x, ids in zip(texts, found)]
        if words.bytes > WORD_BYTES // 2:
            self.words = Words(words)
        if self.piece_bytes > PIECE_BYTES // 2:
            self.pieces_before, self.pieces, self.piece_bytes = self.pieces, {}, 0
        return out

    def fill_words(self) -> None:
        """Put the ids of words met for the first time into the buffers that stand for them."""
        pieces, new, words = self.pieces, self.words.new, self.words
        split = list(map(PIECE.findall, new))  # no pre-token reaches over white space
        lacking = list(set(chain.from_iterable(split)).difference(pieces))
        known = [p for p in lacking if p in self.pieces_before]
        if known:
            pieces.update((p, self.pieces_before[p]) for p in known)
            self.piece_bytes += sum(ENTRY_BYTES + 3 * len(p) for p in known)
            lacking = [p for p in lacking if p not in pieces]
        for at in range(0, len(lacking), 20_000):
            some = lacking[at : at + 20_000]
            data = self.foreign(" ".join(some))
            a = 0
            for p, b in zip(some, (4 * np.flatnonzero(self.ends[np.frombuffer(data, IDS)]) + 4).tolist(), strict=True):
                pieces[p] = data[a:b]
                a = b
        ids = [b"".join(map(pieces.__getitem__, x)) for x in split]
        for buffer, x in zip(new.values(), ids):
            buffer += x
        words.update(zip(new, ids))
        for kept, some in ((words, new), (pieces, lacking)):
            for x in some:
                if len(x) > LONGEST_KEPT:
                    del kept[x]
        words.bytes += sum(ENTRY_BYTES + 3 * len(x) for x in new)
        self.piece_bytes += sum(ENTRY_BYTES + 3 * len(x) for x in lacking)
        new.clear()

    def foreign(self, text: str) -> bytes:
        return np.array(self.part.encode_batch_fast([text], add_special_tokens=False)[0].ids, IDS).tobytes()

    def tree(self, text: str, parts: list[bytes]) -> bytes:
        """Join the encodings of the consecutive leaves of normalized text, neighbours first, until one is left."""
        cuts = [*range(0, len(text), LEAF), len(text)]
        while len(parts) > 1:
            joined = [self.join(text, *cuts[k : k + 3], *parts[k : k + 2]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[2 * len(joined) :]
            cuts = [*cuts[:-1:2], cuts[-1]]
        return parts[0] if parts else b""

    def join(self, text: str, a: int, cut: int, b: int, left: bytes, right: bytes) -> bytes:
        """Join the encodings of text[a:cut] and text[cut:b]."""
        reach = REACH
        while True:
            start, stop = max(a, cut - reach), min(b, cut + reach)
            data = self.foreign(text[start:stop])
            window = np.frombuffer(data, IDS).tolist()
            before, after = self.solid(text[start:cut]), self.solid(text[cut:stop])
            # a token has a byte at least: no more of the sides can lie within the window
            tail = np.frombuffer(left[-4 * before :] if before else b"", IDS).tolist()
            head = np.frombuffer(right[: 4 * after + 4], IDS).tolist()
            p = (0, 0) if start == a else self.agree_left(tail, window, before)
            q = (len(right) // 4, len(window)) if stop == b else self.agree_right(head, window, before, after)
            if p and q and p[1] <= q[1]:
                stays = 0 if start == a else len(left) - 4 * (len(tail) - p[0])
                return left[:stays] + data[4 * p[1] : 4 * q[1]] + right[4 * q[0] :]
            reach *= 2

    @staticmethod
    def solid(text: str) -> int:
        """Bytes of a text without white space, which the tokenizer drops."""
        return len(SPACE.sub("", text).encode("utf-8", "surrogatepass"))

    def agree_left(self, left: list[int], window: list[int], before: int) -> tuple[int, int] | None:
        """Last place before the cut where the left part and the window have the same token, as indexes into both."""
        places, at, k = {}, 0, len(left)
        while k and at < before:
            k -= 1
            at += self.bytes[left[k]]
            places[before - at] = k
        found, at = None, 0
        for w, i in enumerate(window):
            if at >= before:
                break
            k = places.get(at)
            if k is not None and left[k] == i and at + self.bytes[i] <= before:
                found = (k, w)
            at += self.bytes[i]
        return found

    def agree_right(self, right: list[int], window: list[int], before: int, after: int) -> tuple[int, int] | None:
        """First place after the cut where the right part and the window have the same token."""
        places, at = {}, before
        for k, i in enumerate(right):
            if at >= before + after:
                break
            places[at] = k
            at += self.bytes[i]
        at = 0
        for w, i in enumerate(window):
            k = places.get(at)
            if k is not None and at >= before and right[k] == i:
                return (k, w)
            at += self.bytes[i]
        return None

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the ids of each whole text as an array and the text decoded from them; null text counts as empty.

    One row for each row of ``docs``, repeated rows included, null keys kept; other columns are not read, an empty table
    gives an empty result.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        e = Encoder.of(path)
        ids = [np.frombuffer(x, IDS).tolist() for x in e.encode_many(cols["text"])]
        return {"key": cols["key"], "ids": ids, "decoded": [e.decode(i) for i in ids]}

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), work, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """The digests of ``encode_documents`` made where the ids are, so that they need not leave the worker.

    Rows are handled as there: null and empty texts have no ids and decode to an empty text.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        e = Encoder.of(path)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for data in e.encode_many(cols["text"]):
            ids = np.frombuffer(data, IDS).tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(e.decimals.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return out

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())
