"""Operator 9: URL filters in a sorted, memory-mapped array of 64-bit digests.

Rules and listed hosts are compiled into one file: sorted xxhash keys, and beside
them the full strings. Spark hands the file to every executor, where workers map
it into memory. A batch of URLs makes all its candidate strings (each domain
suffix with each path prefix of a length that rules have), probes their keys in
one vectorised binary search, and compares full strings, so that colliding keys
can't give a wrong verdict. The longest rule that fits wins.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

#: Entries that one compiled file may hold (about 5 GB); it goes to every executor, so it is bounded.
MOST_ENTRIES = 50_000_000

#: The rules of the registered query as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Hosts blocked, with their subdomains, where no rule fits.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")

_HEAD = 4  # 64-bit numbers at the file's start: entries, bytes of strings, path lengths, 0


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def compile_rules(rules: Iterable[Sequence[str]], listed_hosts: Iterable[str] = (), most: int = MOST_ENTRIES) -> bytes:
    """The file's bytes. An entry's string is its kind, host and path; of repeated entries the last rule counts."""
    entries: dict[tuple[str, str], int] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict must be allow or block, not {verdict}")
        entries["r" + host.lower(), path] = int(verdict == "block")
    for host in listed_hosts:
        entries["l" + host.lower(), ""] = 1
    if len(entries) > most:
        raise ValueError(f"{len(entries)} entries; one file holds {most}")
    strings = [(host + path).encode() for host, path in entries]
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    paths = np.array([len(path.encode()) for _, path in entries], np.int64)[order]
    actions = np.array(list(entries.values()), np.int64)[order]
    strings = [strings[i] for i in order]
    ends = np.cumsum([0, *map(len, strings)]).astype(np.int64)
    blob = b"".join(strings)
    lengths = np.unique(paths).astype(np.int64)
    head = np.array([len(strings), len(blob), len(lengths), 0], np.int64)
    return b"".join(x.tobytes() for x in (head, keys[order], ends, paths, actions, lengths)) + blob


class DigestArray:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, size, n_lengths, _ = (int(x) for x in whole[: 8 * _HEAD].view(np.int64))
        at = 8 * _HEAD

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            part = whole[at : at + 8 * count].view(kind)
            at += 8 * count
            return part

        self.keys, self.ends = take(n, np.uint64), take(n + 1, np.int64)
        self.paths, self.actions = take(n, np.int64), take(n, np.int64)
        self.lengths = take(n_lengths, np.int64).tolist()
        self.blob = whole[at : at + size]

    def string(self, i: int) -> bytes:
        return self.blob[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The entry of each candidate string, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not candidates or not len(self.keys):
            return found
        keys = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # entries whose keys collide stand side by side
                if self.string(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def judge(self, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str]]:
        """Hosts, paths, rules and verdicts of a batch of URLs."""
        parts = [split_url(u) for u in urls]
        candidates: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            name, way = host.encode(), path.encode()
            labels = name.split(b".")
            for k in range(len(labels)):
                suffix = b".".join(labels[k:])
                candidates.append(b"l" + suffix)
                owner.append(i)
                for n in self.lengths:
                    if n <= len(way):
                        candidates.append(b"r" + suffix + way[:n])
                        owner.append(i)
        rules: list[str | None] = [None] * len(urls)
        verdicts, longest = ["allow"] * len(urls), [-1] * len(urls)
        for c, j in enumerate(self.find(candidates).tolist()):
            if j < 0:
                continue
            i, text = owner[c], candidates[c]
            if text[:1] == b"r" and len(text) > longest[i]:
                longest[i], rules[i] = len(text), text[1:].decode()
                verdicts[i] = "block" if self.actions[j] else "allow"
            elif text[:1] == b"l" and longest[i] < 0:
                verdicts[i] = "block"
        return [h for h, _ in parts], [p for _, p in parts], rules, verdicts


@lru_cache(maxsize=8)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Sequence[str]] = RULES,
    listed_hosts: Iterable[str] = LISTED_HOSTS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row.

    A rule fits its host and all subdomains where the URL's path starts with the
    rule's. Without a fitting rule, ``rule`` is null and the verdict is block for
    listed hosts and their subdomains and allow for all others, null and broken
    URLs among them. Repeated rows stay.
    """
    spark = pages.sparkSession
    small_batches(spark)
    compiled = compile_rules(rules, listed_hosts)
    name = f"digests-{hashlib.sha256(compiled).hexdigest()[:24]}.bin"
    if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        path = os.path.join(tempfile.mkdtemp(), name)  # the driver's own copy, which Spark hands to every executor
        with open(path, "wb") as file:
            file.write(compiled)
        spark.sparkContext.addFile(path)

    def run(batches):
        for ids, urls in rows_of(batches, "id", "url"):
            columns = _mapped(name).judge(urls)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=[key, "host", "path", "rule", "verdict"]
            )

    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"))
    return rows.mapInArrow(run, f"`{key}` bigint, host string, path string, rule string, verdict string")
