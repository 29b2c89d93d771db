"""Operator 1: byte-level BPE encoding and decoding.

A word is merged with a priority queue of merge ranks over a doubly linked list
of symbols. A queue entry is stale, and skipped, when one of its two symbols has
been merged meanwhile. Decoding concatenates the vocabulary's byte strings.

The encoder runs inside Arrow batches: Spark partitions the documents, no row
depends on another, and nothing is shuffled. Every worker keeps the ids of the
words that it met last; that memory is bounded (about 60 MB for words of a text).

``encode_many`` takes many texts at once. Words that are not remembered are merged
side by side as rows of an array, each by its lowest rank and leftmost first, as
the queue would; long ones go through the queue.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches, tokenizer_file

#: Chunks between spaces whose ids one worker remembers, and pre-tokens of chunks that have several; at most twice as many are held.
REMEMBERED_CHUNKS, REMEMBERED_WORDS = 1 << 17, 1 << 16
#: Longer chunks are encoded but not remembered.
REMEMBERED_LENGTH = 64
#: Characters of texts that ``encode_many`` cuts at once, some 30 bytes for each; a longer text is cut alone.
CUT_CHARACTERS = 1 << 20
#: Bytes of a word up to which it is merged as a row of an array: such a row costs its length squared.
ROW_BYTES = 48

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space that white space follows: no certain place to cut.
_SPACE_RUN = re.compile(r" \s").search


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from code point 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Memory(dict):
    """Packed ids by text, computed on first use. A full memory becomes the old one, from which what is asked for again comes back."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > REMEMBERED_LENGTH:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _runs(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``values[begin : begin + count]``, one after the other."""
    return values[np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)]


class BpeTokenizer:
    """A byte-level BPE vocabulary file: ``encode``, ``decode`` and packed forms of both."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        byte_of = {c: i for i, c in enumerate(alphabet)}
        self.byte_ids = [vocab[c] for c in alphabet]
        #: Merge rank and resulting id by pair of ids.
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.pieces: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.pieces |= {i: s.encode() for s, i in self.specials.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._split = regex.compile(PATTERN).findall
        self._words = _Memory(self._word, REMEMBERED_WORDS)
        self._spaced = _Memory(lambda chunk: self._chunk(" " + chunk), REMEMBERED_CHUNKS)  # by the chunk without its space
        self._many: dict[str, bytes] = {}  # the same for ``encode_many``
        pairs = sorted((left * len(self.pieces) + right, *found) for (left, right), found in self.ranks.items())
        self._pairs, self._pair_ranks, made = (np.array([x[k] for x in pairs], np.int64) for k in range(3))
        self._no_rank = len(merges)
        self._merged = np.zeros(self._no_rank, np.int64)  # ids by rank
        self._merged[self._pair_ranks] = made
        self._byte_ids = np.array(self.byte_ids, np.int64)
        self._byte_ranks = self._ranks(self._byte_ids[:, None], self._byte_ids[None, :])

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to the symbols of one word, lowest rank and leftmost first."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks = self.ranks
        symbols = symbols[:]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if found := ranks.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: a neighbour was merged after this entry was queued
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((merged, symbols[k])):
                    heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], merged))):
                heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.byte_ids
        return array("I", self.merge([ids[b] for b in word.encode("utf-8", "replace")])).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self._split(chunk)
        if len(found) == 1:  # remembered as a chunk
            return self._word(found[0])
        words = self._words
        return b"".join([words[w] for w in found])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space before a character that isn't white space always begins a
        pre-token, so the text can be cut there and the chunks looked up.
        """
        first, *rest = text.split(" ")
        if not rest:
            return self._chunk(first) if first else b""
        if not first or not rest[-1] or _SPACE_RUN(text):
            return self._chunk(text)
        return self._chunk(first) + b"".join(map(self._spaced.__getitem__, rest))

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.specials or not any(s in text for s in self.specials):
            return self._plain(text)
        out, at = [], 0
        for found in self._special.finditer(text):
            out += self._plain(text[at : found.start()]), array("I", [self.specials[found[0]]]).tobytes()
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; ``_no_rank`` where no merge is known."""
        wanted = left * len(self.pieces) + right
        if not len(self._pairs):
            return np.full(wanted.shape, self._no_rank)
        at = np.minimum(self._pairs.searchsorted(wanted), len(self._pairs) - 1)
        return np.where(self._pairs[at] == wanted, self._pair_ranks[at], self._no_rank)

    def _merge_rows(self, raw: np.ndarray):
        """As ``merge`` for words of one length, a row of bytes each: places of rows and their ids, as they end. The others lose one symbol a round."""
        rows, symbols, ranks = np.arange(len(raw)), self._byte_ids[raw], self._byte_ranks[raw[:, :-1], raw[:, 1:]]
        for width in range(raw.shape[1], 1, -1):
            at = ranks.argmin(axis=1)  # the first of equal ones
            best = ranks[np.arange(len(rows)), at]
            if (over := best == self._no_rank).any():
                yield rows[over], symbols[over]
                rows, symbols, ranks, at, best = (x[~over] for x in (rows, symbols, ranks, at, best))
                if not len(rows):
                    return
            each, place, merged = np.arange(len(rows)), at[:, None], self._merged[best]
            symbols = np.where(np.arange(width - 1) <= place, symbols[:, :-1], symbols[:, 1:])
            symbols[each, at] = merged
            ranks = np.where(np.arange(width - 2) < place, ranks[:, :-1], ranks[:, 1:])
            k = np.flatnonzero(at > 0)
            ranks[k, at[k] - 1] = self._ranks(symbols[k, at[k] - 1], merged[k])
            k = np.flatnonzero(at < width - 2)
            ranks[k, at[k]] = self._ranks(merged[k], symbols[k, at[k] + 1])
        yield rows, symbols

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in their order, and how many each has; a word that repeats is merged once."""
        met = pa.array(words, pa.large_string()).dictionary_encode()
        _, ends, data = met.dictionary.buffers()
        ends, data = np.frombuffer(ends, np.int64)[: len(met.dictionary) + 1], np.frombuffer(data or b"", np.uint8)
        begin, size = ends[:-1], np.diff(ends)
        ids, count = np.zeros(len(data), np.uint32), np.zeros(len(size), np.int64)  # a word's ids begin where its bytes do
        for n in np.unique(size).tolist():
            same = np.flatnonzero(size == n)
            if n > ROW_BYTES:
                for k in same.tolist():
                    own = self.merge(self._byte_ids[data[begin[k] : begin[k] + n]].tolist())
                    count[k] = len(own)
                    ids[begin[k] : begin[k] + len(own)] = own
                continue
            for rows, found in self._merge_rows(data[begin[same][:, None] + np.arange(n)]):
                width = found.shape[1]
                count[same[rows]] = width
                ids[begin[same[rows]][:, None] + np.arange(width)] = found
        at = met.indices.to_numpy()
        return _runs(ids, begin[at], count[at]), count[at]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens, cut as in ``_plain``."""
        whole = [x[:1] == " " or x[-1:] == " " or _SPACE_RUN(x) is not None for x in texts]
        chunks = pc.split_pattern(pa.array(["" if w else x for x, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        first = chunks.offsets.to_numpy()[:-1]  # a text has one chunk at least
        met = chunks.values.dictionary_encode()
        unit = met.indices.to_numpy().astype(np.int64)
        heads = [self._split(x if w else x.partition(" ")[0]) for x, w in zip(texts, whole, strict=True)]
        later = np.zeros(len(met.dictionary), bool)
        later[np.delete(unit, first)] = True
        wanted = met.dictionary.filter(pa.array(later)).to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        place = np.cumsum(later) - 1
        unit = place[unit]
        unit[first] = len(wanted) + np.arange(len(texts))

        memory = self._many
        unknown = [c for c in wanted if c not in memory]
        if len(memory) + len(unknown) > 2 * REMEMBERED_CHUNKS:  # full: only what is asked for now stays
            memory = self._many = {c: memory[c] for c in wanted if c in memory}
        words = self._split(" " + " ".join(unknown)) if unknown else []
        ends = [k for k, w in enumerate(words) if w[0] == " "][1:]  # a chunk holds no space but the one before it
        ends += [len(words)] if unknown else []
        for head in heads:
            words += head
            ends.append(len(words))
        ids, count = self._merge_words(words)
        packed = ids.astype("<u4").tobytes()
        at = (4 * np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], ends)).astype(np.int64)]).tolist()
        made = [packed[i:j] for i, j in zip(at, at[1:])]
        memory.update(zip(unknown, made))  # the heads come after them
        held = [memory[c] for c in wanted] + made[len(unknown) :]
        for chunk in unknown:
            if len(chunk) > REMEMBERED_LENGTH:
                del memory[chunk]

        size = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        count = size[unit]
        packed = _runs(np.frombuffer(b"".join(held), "<u4"), (np.cumsum(size) - size)[unit], count).tobytes()
        at = (4 * np.concatenate(([0], np.cumsum(count)))[np.append(first, len(unit))]).tolist()
        return [packed[i:j] for i, j in zip(at, at[1:])]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode_packed`` of each text."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            if self.specials and any(s in text for s in self.specials):
                out[k] = self.encode_packed(text)
            elif text:
                cut.append(k)
                held += len(text)
            if cut and (held >= CUT_CHARACTERS or k + 1 == len(texts)):
                for i, packed in zip(cut, self._encode_cut([texts[i] for i in cut]), strict=True):
                    out[i] = packed
                cut, held = [], 0
        return out

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_packed(self, packed: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in array("I", packed)]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(array("I", ids).tobytes())


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BpeTokenizer:
    """One tokenizer for each vocabulary file and Python worker."""
    return BpeTokenizer(path)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add the array of token ids of a text column; a null text counts as empty.

    Other columns pass unchanged, whatever their names; a column already named
    ``ids`` is replaced.
    """
    small_batches(df.sparkSession)
    path = path or tokenizer_file()

    @F.arrow_udf("array<long>")
    def ids_of(texts: pa.Array) -> pa.Array:
        model = tokenizer(path)
        return pa.array([model.encode(x or "") for x in texts.to_pylist()], pa.list_(pa.int64()))

    return df.withColumn(ids, ids_of(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of an array of token ids; a null array gives an empty text."""
    small_batches(df.sparkSession)
    path = path or tokenizer_file()

    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        model = tokenizer(path)
        return pa.array([model.decode(x or []) for x in rows.to_pylist()], pa.string())

    return df.withColumn(text, text_of(F.col(ids)))


def encode_digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text and return counts and digests of both results.

    Returns ``key, n_tokens, ids_sha256, decoded_sha256``, one row for each input
    row; repeated rows stay. A null text counts as empty.
    """
    small_batches(df.sparkSession)
    path = path or tokenizer_file()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = tokenizer(path)
        for keys, texts in rows_of(batches, "k", "x"):
            counts, hashes, decoded = [], [], []
            for x in texts:
                packed = model.encode_packed(x or "")
                counts.append(len(packed) >> 2)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(model.decode_packed(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()) if kind == "bigint" else pa.array(keys), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
