"""Byte strings of a given length that also start earlier, by merging Burrows-Wheeler transforms.

Texts are dealt to buckets by minimiser (``superwindows``), so equal strings meet. In a bucket the distinct
pieces form shards; each shard has its suffixes sorted once, and only its transform (the symbol before each
suffix) goes on. The shards are merged by refining an interleave: starting from the shards one after the
other, each round deals the entries by their preceding symbol, after h rounds the interleave is the order
of all suffixes by their first h symbols. An entry that borders cut off in round
h + 1 has a common prefix of h symbols with its neighbour and keeps its place; intervals without a border
after the last round are the repeated strings. No suffix of the union is sorted again.

A symbol is four bytes: each text is read in its four phases as strings of four-byte symbols, so 100 bytes
take 25 rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fields, names, ragged
from .substring_dedup import covered
from .superwindows import Pieces, by_value, byte_symbols, grown, identified, mixed, powers, repeated_spans, with_spans

WIDTH = 100
GRAM = 16
SYMBOL = 4
#: bytes of pieces merged at once, and bytes of a shard of them
MERGED_BYTES, SHARD_BYTES = 150_000, 50_000


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.append(0, np.cumsum(k[1:] != k[:-1]))
    return out


def _suffix_order(code: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Positions in the order of their first ``width`` bytes; ``code`` covers SYMBOL bytes, and what lies
    behind ``end`` counts as least."""
    n, have, rank = len(code), SYMBOL, code.astype(np.int64)
    here = np.arange(n)
    while True:
        radix = max(n, int(rank.max(initial=0)) + 1) + 2
        key, reach = rank, have
        for _ in range(2 if radix ** 3 < 1 << 63 else 1):  # three ranks in a key if they fit
            far = here + min(reach, width - have)
            key = key * radix + np.where(far < end, rank[np.minimum(far, n - 1)] + 1, 0)
            reach = min(reach + have, width)
        have = reach
        if have >= width:
            return np.argsort(key)
        rank = _ranks(key)


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes, refined for ``rounds`` rounds. Gives, for each entry in
    shard order, its place in the merged order (equal suffixes: the first place of their interval), and the
    symbols that it has in common with its nearest neighbour (at most ``rounds``).

    In a shard the entries with one symbol before them keep their order when that symbol is put in front; so
    ``step``, the entry that begins with it, comes from the transform alone. A round deals only the entries
    whose step still shares its interval; one that stands alone has found its place."""
    before = np.concatenate(transforms)
    n, at = len(before), 0
    step = np.empty(n, np.int32)
    for t in transforms:
        step[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    common, place, alone = np.full(n, rounds, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    entry = np.arange(n, dtype=np.int32)
    for h in range(rounds):
        after = step[entry]
        dealt = np.flatnonzero(~alone[after])
        entry, after = entry[dealt], after[dealt]
        symbol = before[entry]
        order = np.argsort(symbol, kind="stable")
        # from the second round on an interval has one first symbol, and places tell more than symbols
        key = (place[entry] if h else symbol)[order]
        entry = after[order]
        mine = place[entry]
        old, new = np.ones(len(entry), bool), np.ones(len(entry) + 1, bool)
        np.not_equal(mine[1:], mine[:-1], out=old[1:])
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        new[1:-1] |= old[1:]
        first, opened = np.flatnonzero(new[:-1]), np.flatnonzero(old)
        moved = first - opened[np.cumsum(old[first]) - 1]  # every old interval opens a new one
        place[entry] = np.repeat((mine[first] + moved).astype(np.int32), np.diff(np.append(first, len(entry))))
        cut = entry[np.flatnonzero(new[1:] & new[:-1])]
        alone[cut], common[cut] = True, h
        if len(cut) == len(entry):  # every suffix stands alone
            break
    return place, common


def equal_windows(text: list[bytes], count: np.ndarray, width: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Group number of every window of the pieces, end to end: equal windows, equal numbers,
    in the order of the windows."""
    size = np.array([len(t) for t in text], np.int64)
    room = size + SYMBOL                       # each phase of a piece ends in a terminator of its own
    base = np.cumsum(room) - room
    n = int(room.sum())
    data = np.zeros(n + SYMBOL, np.uint32)
    data[ragged(base, size)] = np.frombuffer(b"".join(text), np.uint8)
    wide = data[:n] << 24 | data[1:n + 1] << 16 | data[2:n + 2] << 8 | data[3:n + 3]
    ends = ragged(base + size, np.full(len(size), SYMBOL))
    alphabet, code = np.unique(wide, return_inverse=True)
    code = code.astype(np.int64) + 1
    code[ends] = 0
    kind = np.uint16 if len(alphabet) < 65_535 else np.uint32
    stop = np.repeat(base + room, room)
    first = np.repeat(base, room)
    cuts = np.flatnonzero(np.append(True, base[1:] // shard_bytes != base[:-1] // shard_bytes))
    edges = np.append(base[cuts], n)
    transforms, places = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        order = a + _suffix_order(code[a:b], stop[a:b] - a, width)
        previous = order - SYMBOL
        transforms.append(np.where(previous >= first[order], code[np.maximum(previous, 0)], 0).astype(kind))
        places.append(order)
    group = np.empty(n, np.int32)
    group[np.concatenate(places)] = merge_transforms(transforms, width // SYMBOL)[0]
    return group[ragged(base, count)]


def with_repeats(text: list[bytes], count: np.ndarray, width: int) -> np.ndarray:
    """Which pieces have a window whose hash occurs more than once among the windows of all pieces. Equal windows have
    equal hashes, so no piece that others repeat is missed; what the hash mixes up is told apart by the merge."""
    size = np.array([len(t) for t in text], np.int64)
    base = np.cumsum(size) - size
    power, inverse = powers(int(size.sum()) + 1)
    total = np.zeros(len(power), np.uint64)
    np.cumsum((np.frombuffer(b"".join(text), np.uint8).astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    at = ragged(base, count)
    key = mixed((total[at + width] - total[at]) * inverse[at])
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    found = np.zeros(len(text), bool)
    found[np.searchsorted(base, at[np.append(order[same], order[same + 1])], "right") - 1] = True
    return found


def settle_bytes(width: int):
    def settle(pieces: Pieces):
        out = [[np.zeros(0, np.int64)] for _ in range(4)]

        def add(row, start, stop):
            for o, x in zip(out, (part.doc_id[row], part.text_hash[row], start, stop)):
                o.append(x)

        for part in by_value(pieces, MERGED_BYTES):
            same: dict[bytes, int] = {}
            which = np.array([same.setdefault(t, len(same)) for t in part.text], np.int64)
            # the first of equal pieces; the later ones go as a whole
            order = np.lexsort((part.start, part.text_hash, part.doc_id, which))
            head = order[np.flatnonzero(np.append(True, which[order][1:] != which[order][:-1]))]
            mine = head[which]
            later = np.flatnonzero((part.doc_id != part.doc_id[mine]) | (part.text_hash != part.text_hash[mine]) | (part.start != part.start[mine]))
            add(later, part.start[later], part.start[later] + part.count[later] + width - 1)
            # a minimiser with one distinct piece has nothing to merge, unless it repeats inside
            _, inv, n = np.unique(part.value[head], return_inverse=True, return_counts=True)
            twice = np.zeros(len(head), bool)
            np.logical_or.at(twice, which, part.twice)
            use = head[(n[inv] > 1) | twice]
            # nor have pieces whose windows all stand alone: more and more as common minimisers gather by chance
            use = use[with_repeats([part.text[i] for i in use.tolist()], part.count[use], width)]
            if not len(use):
                continue
            count = part.count[use]
            group = equal_windows([part.text[i] for i in use.tolist()], count, width)
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(several):
                continue
            row, start = np.repeat(use, count), np.repeat(part.start[use], count) + ragged(np.zeros(len(use), np.int64), count)
            order = several[np.lexsort((start[several], part.text_hash[row[several]], part.doc_id[row[several]], group[several]))]
            new = np.append(True, group[order][1:] != group[order][:-1])
            first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.zeros(len(row), bool)
            again[order] = (part.doc_id[row[order]] != part.doc_id[row[first]]) | (part.text_hash[row[order]] != part.text_hash[row[first]]) | (start[order] != start[first])
            near = row[1:] == row[:-1]
            opens = again & ~np.append(False, again[:-1] & near)
            closes = again & ~np.append(again[1:] & near, False)
            add(row[opens], start[opens], start[closes] + width)
            # what holds for the first of equal pieces holds for the later ones too: they are gone already
        return [np.concatenate(o) for o in out]

    return settle


@F.pandas_udf(fields("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
def _cut(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans, wanted in rows:
        out = []
        for raw, s, full in zip(map(grown, texts), spans, wanted):
            size = len(raw)
            removed = runs = 0
            if s is not None and len(s):
                gone = covered(len(raw), s)
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((size, removed, runs, raw if full else None, hashlib.sha256(raw).hexdigest()))
        yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_earlier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """All columns of ``docs`` and, under ``dedup``, a struct of n_bytes, n_removed, n_spans (maximal removed
    runs), kept (the remaining bytes; null without ``with_bytes``) and kept_sha256.

    A byte goes if a string of ``width`` bytes (a multiple of four) covers it that also starts earlier: in a
    document with a smaller id, or earlier in the same one. A null id is smaller than all others; documents
    with one id and different texts are ordered by a hash of the text; rows equal in id and text are one
    document and get the same result. A null text is empty; an empty table stays empty."""
    if width % SYMBOL or width <= gram:
        raise ValueError("width must be a multiple of four and exceed gram")
    docs = docs.drop("dedup")
    i, h, t = identified(docs, doc_id, text)
    spans = repeated_spans(docs.select(i.alias("doc_id"), h.alias("text_hash"), t.alias("text")), byte_symbols, width, gram, settle_bytes(width), True, 3.4)
    return with_spans(docs, doc_id, text, spans).select(*names(docs), _cut("__text", "__spans", F.lit(with_bytes)).alias("dedup"))
