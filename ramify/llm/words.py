"""Words of many texts at once: a byte automaton over Arrow's UTF-8 buffers.

A table of 256 classes turns every byte into its lower-case form, or into zero
where no word can hold it. Differences of that mask are the word boundaries. Codes
of words (CRC-32, 64-bit hashes) advance by one byte over all words at once, the
longest first, so that each step is a slice of whole arrays.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Words of digits, ASCII letters and anything beyond ASCII, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of a word that are handled step by step over all words; the few longer ones are handled one by one.
STEPS = 48


def _classes() -> np.ndarray:
    """Each byte's lower-case form; zero where it ends a word."""
    out = np.zeros(256, np.uint8)
    out[0x30:0x3A] = np.arange(0x30, 0x3A)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes, from the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CLASSES, CRC = _classes(), _crc_table()
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_FULL = np.uint32(0xFFFFFFFF)


def word_list(text: str | None) -> list[str]:
    """The plain form: words of one text as strings."""
    return WORD.findall((text or "").translate(_LOWER))


@dataclass
class Words:
    """All words of a batch: lower-case bytes, and each word's start, length and text; ``first[i]`` is text i's first word."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def pairs(self) -> np.ndarray:
        """Numbers of the words that have a next one in their text."""
        return np.flatnonzero(self.text[1:] == self.text[:-1])


def words_of(texts: pa.Array) -> Words:
    """Find the words of a string array; null texts hold none."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = CLASSES[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = data != 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = bounds[1:] > bounds[:-1]  # a word ends with its text
    before[bounds[:-1][full]] = False
    after[bounds[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - start
    first = np.searchsorted(start, bounds)
    return Words(data, start, length, np.repeat(np.arange(n), np.diff(first)), first)


def _advance(words: Words, chosen: np.ndarray, state: np.ndarray, step, whole) -> np.ndarray:
    """``state`` of the chosen words after all their bytes; ``step(state, bytes)`` takes one byte of each, ``whole`` all bytes of one."""
    size = words.length[chosen]
    order = np.argsort(-size, kind="stable")
    size, start, out = size[order], words.start[chosen][order], state[order]
    long = int(np.searchsorted(-size, -STEPS, side="left"))  # size > STEPS
    for i in range(long):
        out[i] = whole(out[i], words.data[start[i] : start[i] + size[i]].tobytes())
    left = out[long:]
    begin = start[long:]
    ends = np.searchsorted(-size[long:], -np.arange(STEPS), side="left")
    for at in range(STEPS):
        active = int(ends[at])  # size > at
        if not active:
            break
        left[:active] = step(left[:active], words.data[begin[:active] + at])
    back = np.empty_like(out)
    back[order] = out
    return back


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _crc_whole(state: np.uint32, data: bytes) -> int:
    return zlib.crc32(data, int(state ^ _FULL)) ^ 0xFFFFFFFF


def crcs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned CRC-32 of every word, and of every two consecutive words joined by a space."""
    every = np.arange(len(words.start))
    one = _advance(words, every, np.full(len(every), _FULL), _crc_step, _crc_whole)
    left = words.pairs()
    two = _advance(words, left + 1, _crc_step(one[left], np.full(len(left), 0x20, np.uint8)), _crc_step, _crc_whole)
    return one ^ _FULL, two ^ _FULL


_PRIME = np.uint64(0x100000001B3)


def _hash_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (state ^ byte) * _PRIME


def _hash_whole(state: np.uint64, data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, int(state))


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling 64-bit hashes (signed) of all runs of ``k`` words, text by text, and how many each text has."""
    every = np.arange(len(words.start))
    own = _advance(words, every, np.full(len(every), np.uint64(0xCBF29CE484222325)), _hash_step, _hash_whole)
    own ^= own >> np.uint64(29)
    own *= np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(32)
    n = max(len(own) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    whole = words.text[:n] == words.text[k - 1 : k - 1 + n]
    return rolled[whole].view(np.int64), np.maximum(words.counts - (k - 1), 0)
