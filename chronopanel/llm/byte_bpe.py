"""Byte-level BPE encoding and decoding with a rank table.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are entries themselves; a
miss is merged with a heap of candidate pairs over linked bytes. Both tiers look ranks up in the same hash,
and every hit is confirmed against the stored entry. A task resolves each distinct pre-token once.

The vocabulary (a fixed file, not data) is read by the driver and travels with the function.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: distinct pre-tokens a task remembers before it starts afresh
REMEMBERED = 200_000


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots."""

    PER_BUCKET = 2

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, n // self.PER_BUCKET + 1
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            members[xxhash.xxh64_intdigest(k) % self.buckets].append(i)
        digests = [xxhash.xxh64_intdigest(k) for k in keys]
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                slots = {self._place(digests[i], d) for i in members[b]}
                if len(slots) == len(members[b]) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in members[b]:
                s = self._place(digests[i], d)
                self.keys[s], self.values[s] = keys[i], values[i]
        free = (s for s in range(n) if self.keys[s] is None)
        for b in range(self.buckets):
            if len(members[b]) == 1:  # a single key takes any free slot, named outright
                s = next(free)
                self.shift[b] = -s - 1
                self.keys[s], self.values[s] = keys[members[b][0]], values[members[b][0]]

    def _place(self, digest: int, d: int) -> int:
        return ((digest >> 17) * (2 * d + 1) + d * 0x9E3779B1 >> 7) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        digest = xxhash.xxh64_intdigest(key)
        d = self.shift[digest % self.buckets]
        slot = -d - 1 if d < 0 else self._place(digest, d)
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(token: bytes, rank) -> list[int]:
    """Ids of a pre-token: the pair of least rank is merged first, the leftmost of equal ones."""
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = rank(token[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue  # one of the two has been merged since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            r = rank(token[i:after[end]])
            if r is not None:
                push(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0:
            r = rank(token[left:end])
            if r is not None:
                push(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        r = rank(token[i:after[i]])
        if r is None:
            raise ValueError(f"byte {token[i:after[i]]!r} is not in the vocabulary")
        out.append(r)
        i = after[i]
    return out


class Ranks(dict):
    """Byte string to rank (None: no entry); remembers what the perfect hash has answered."""

    def __init__(self, table: PerfectHash):
        super().__init__()
        self.table = table

    def __missing__(self, key: bytes) -> int | None:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.table.get(key)
        return found


class Encoder(dict):
    """Pre-token to ids; remembers what it has resolved."""

    def __init__(self, ranks: PerfectHash, pattern: str):
        super().__init__()
        self.ranks, self.rank = ranks, Ranks(ranks).__getitem__
        # \s as Unicode defines white space, without the four separators that Python adds
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = token.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = self[token] = (whole,) if whole is not None else tuple(merge_bytes(raw, self.rank))
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split(text))), "<u4")


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]


def encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text (null: empty) as a binary of little-endian unsigned 32-bit integers."""
    table = PerfectHash(*read_ranks(path))

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(table, pattern)
        for texts in batches:
            yield texts.map(lambda t: encoder.encode(t).tobytes())

    return ids_of(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The bytes of the ids that ``encode`` gave."""
    keys, values = read_ranks(path)
    entries = dict(zip(values, keys))

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield blobs.map(lambda b: None if b is None else b"".join(map(entries.__getitem__, np.frombuffer(b, "<u4").tolist())))

    return bytes_of(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256 and decoded_sha256 of every text, in one pass: the ids are
    decoded where they are made. A null text is empty: no tokens, the digests of nothing. Repeated rows and
    null ids stay; an empty table stays empty."""
    table = PerfectHash(*read_ranks(path))
    keys, values = read_ranks(path)
    entries = dict(zip(values, keys))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(table, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                ids = encoder.encode(t)
                back = b"".join(map(entries.__getitem__, ids.tolist()))
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, digests(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("d")).select(*keep, "d.*")
