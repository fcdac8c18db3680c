"""Windows of symbols that share a minimiser travel together.

A window is ``width`` consecutive symbols (bytes or words) of one document; its minimiser is the least
hash of its ``gram``-long parts. Equal windows have equal minimisers, so they meet in one bucket, wherever
they are; consecutive windows with the same minimiser overlap and travel as one piece of text.

What a task does with a few megabytes of text is numpy; the rest is Spark: a first pass counts minimisers
by hash slot, a second one deals the pieces to buckets, one task handles a bucket, and the resulting spans
are joined back to the documents.

Hot minimisers (a line or passage that a large share of the documents has) would make one bucket grow with
the input. Their windows travel one by one under the hash of the whole window instead, so only equal
windows meet, and a task sends equal pieces once: later copies are settled where they are found.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import chunks, give_back, ragged, utf8

SEGMENT = 1 << 19           # symbols handled at once
LONGEST_RUN = 1 << 14       # windows in one piece
BUCKET_BYTES = 32_000_000   # pieces of text in one bucket, before compression
HOT_PIECES = 8_000          # a slot with more pieces than this, and 4 times the mean, is hot
SLOT_BLOCK = 4_096          # slots counted in one row
DEALT_BYTES = 4_000_000     # text dealt at once; up to 4 times that if there are many buckets
LEVEL = 6                   # of compression; pieces are most of what is exchanged
SPANS = "doc_id long, text_hash long, start long, stop long"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER = _INVERSE = np.zeros(0, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        _POWER, _INVERSE = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
    return _POWER[:n], _INVERSE[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Runs:
    """Consecutive windows of a document with one minimiser: first symbol, windows, minimiser, and whether
    the minimiser occurs twice inside, without which no two windows of the run can be equal."""

    start: np.ndarray
    count: np.ndarray
    value: np.ndarray
    twice: np.ndarray

    def __getitem__(self, i) -> "Runs":
        return Runs(self.start[i], self.count[i], self.value[i], self.twice[i])


def joined(parts: list[Runs]) -> Runs:
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z.astype(np.uint64), z.astype(bool))
    return Runs(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "count", "value", "twice")])


def _segment_runs(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, gram: int, hot: np.ndarray | None) -> Runs:
    """Runs of adjacent stretches ``codes[starts[i] : starts[i] + lengths[i]]``, each at least ``width`` long."""
    low, n = int(starts[0]), int(starts[-1] + lengths[-1] - starts[0])
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes[low:low + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    grams = mixed((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    w = width - gram + 1
    least, have = grams, 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = ragged(starts - low, lengths - width + 1)  # window starts
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    enters, leaves = (np.add.reduceat(x.astype(np.int32), first) for x in (grams[at + w - 1] == value, grams[at] == value))
    # in w windows one place both enters and leaves: the last gram of the first window
    one_place = (count == w) & (grams[at[first] + w - 1] == value[first])
    twice = (count > w) | (enters > 1) | (leaves > 1) | ((enters > 0) & (leaves > 0) & ~one_place)
    if count.max(initial=0) > LONGEST_RUN:
        parts = -(-count // LONGEST_RUN)
        within = ragged(np.zeros(len(parts), np.int64), parts) * LONGEST_RUN
        first, whole, twice = np.repeat(first, parts) + within, np.repeat(count, parts), np.repeat(twice, parts)
        count = np.minimum(whole - within, LONGEST_RUN)
    runs = Runs(at[first] + low, count, value[first], twice)
    if hot is not None and len(hot):
        burning = np.isin(slot_of(runs.value, hot[0]), hot[1:])
        if burning.any():
            single = ragged(runs.start[burning], runs.count[burning])
            whole = mixed((total[single - low + width] - total[single - low]) * inverse[single - low]) ^ np.uint64(0x5555)
            runs = joined([runs[~burning], Runs(single, np.ones(len(single), np.int64), whole, np.zeros(len(single), bool))])
    return runs


def runs_of(codes: np.ndarray, offsets: np.ndarray, width: int, gram: int, hot: np.ndarray | None = None) -> Runs:
    """Runs of all documents ``codes[offsets[i] : offsets[i + 1]]``; long ones in overlapping stretches."""
    lengths = np.diff(offsets)
    doc = np.flatnonzero(lengths >= width)
    windows, step = lengths[doc] - width + 1, SEGMENT
    pieces = -(-windows // step)
    within = ragged(np.zeros(len(doc), np.int64), pieces) * step
    starts = np.repeat(offsets[:-1][doc], pieces) + within
    sizes = np.minimum(np.repeat(windows, pieces) - within, step) + width - 1
    out, i = [], 0
    while i < len(starts):
        # adjacent stretches may overlap when a document is cut: then handle one at a time
        j = i + 1
        while j < len(starts) and starts[j] >= starts[j - 1] + sizes[j - 1] and starts[j] + sizes[j] - starts[i] <= SEGMENT + width:
            j += 1
        out.append(_segment_runs(codes, starts[i:j], sizes[i:j], width, gram, hot))
        i = j
    return joined(out)


def slot_of(value: np.ndarray, slots) -> np.ndarray:
    return (value % np.uint64(slots)).astype(np.int64)


@dataclass
class Symbols:
    """The documents of a chunk: symbol codes, n + 1 document offsets in symbols, and the bytes of symbol i
    at ``text[at[i] : at[i + 1]]`` (``at`` None: a symbol is a byte)."""

    codes: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    at: np.ndarray | None

    def cut(self, runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = runs.start, runs.start + runs.count + width - 1
        if self.at is not None:
            first, last = self.at[first], self.at[last]
        return first, last - first


def byte_symbols(column: pa.Array) -> Symbols:
    data, offsets = utf8(column)
    return Symbols(data, offsets, data, None)


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_symbols(column: pa.Array) -> Symbols:
    """Words with one blank after each; a word's code is a hash of its bytes (equal codes are no proof)."""
    data, offsets = utf8(column)
    blank = _IS_BLANK[data]
    start = ~blank
    start[1:] &= blank[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = ~blank[heads]
    end = ~blank  # last byte of a word
    end[:-1] &= blank[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    end[tails] = ~blank[tails]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    size = last - first + 1
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    text = np.full(at[-1], 32, np.uint8)
    kept = np.ones(at[-1], bool)
    kept[at[1:] - 1] = False
    text[kept] = data[~blank]
    codes = np.zeros(len(first), np.uint64)
    for i in range(0, len(first), 1 << 17):
        j = min(len(first), i + (1 << 17))
        part = text[at[i]:at[j]]
        inside = np.arange(len(part)) - np.repeat(at[i:j] - at[i], size[i:j] + 1)
        power = powers(int(inside.max()) + 1)[0]
        codes[i:j] = mixed(np.add.reduceat((part.astype(np.uint64) + np.uint64(1)) * power[inside], at[i:j] - at[i]))
    return Symbols(codes, np.searchsorted(first, offsets), text, at)


def packed(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for kind, length in zip(kinds, lengths):
        out.append(np.frombuffer(raw, kind, length, at))
        at += length * np.dtype(kind).itemsize
    return out


PIECE = [np.uint32, np.int64, np.int32, np.int64, np.int32, np.int32, np.bool_, np.uint8]
SPAN = [np.int64] * 4


@dataclass
class Pieces:
    """Pieces of one bucket: minimiser, document, first symbol, windows, whether it may hold a window twice,
    and the bytes."""

    value: np.ndarray
    doc_id: np.ndarray
    text_hash: np.ndarray
    start: np.ndarray
    count: np.ndarray
    twice: np.ndarray
    text: list[bytes]


def touching(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, those of one document that overlap or touch made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    far = doc * (int(stop.max()) + 1)  # documents lie one after the other
    reach = np.maximum.accumulate(far + stop)
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | ((far + start)[1:] > reach[:-1])))
    return doc[first], start[first], (reach - far)[np.append(first[1:], len(doc)) - 1]


Settle = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def dealt_bytes(buckets: int) -> int:
    """Text a task deals at once: a blob for each bucket comes of it, and small blobs compress badly."""
    return DEALT_BYTES * min(4, max(1, buckets // 256))


def dealer(symbols: Callable, width: int, gram: int, buckets: int, hot: np.ndarray, keep_first: bool):
    """Arrow batches (doc_id, text_hash, text) to rows (bucket, blob)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", dealt_bytes(buckets)):
            s = symbols(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            runs = runs_of(s.codes, s.offsets, width, gram, hot)
            if not len(runs.start):
                continue
            doc = np.searchsorted(s.offsets, runs.start, "right") - 1
            begin = runs.start - s.offsets[doc]
            at, size = s.cut(runs, width)
            # pieces whose minimiser occurs more than once in this chunk: equal ones are sent once
            _, inv, n = np.unique(runs.value, return_inverse=True, return_counts=True)
            send, spans = np.ones(len(begin), bool), []
            view, groups = s.text.data if s.text.flags.c_contiguous else s.text.tobytes(), {}
            for i in np.flatnonzero(n[inv] > 1).tolist():
                groups.setdefault(bytes(view[at[i]:at[i] + size[i]]), []).append(i)
            for same in groups.values():
                if len(same) > 1:
                    same.sort(key=lambda i: (ids[doc[i]], hashes[doc[i]], begin[i]))
                    send[same[1:]] = False
                    first = same[0]
                    whom = [i for i in same[1:] if (doc[i], begin[i]) != (doc[first], begin[first])
                            and (ids[doc[i]], hashes[doc[i]], begin[i]) != (ids[doc[first]], hashes[doc[first]], begin[first])] if keep_first else same
                    spans += whom
            bucket = (runs.value[send] >> np.uint64(8)) % np.uint64(buckets)
            order = np.flatnonzero(send)[np.argsort(bucket, kind="stable")]
            bucket = (runs.value[order] >> np.uint64(8)) % np.uint64(buckets)
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            names, blobs = [], []
            if spans:
                d, start, stop = touching(doc[spans], begin[spans], begin[spans] + runs.count[spans] + width - 1)
                blobs.append(packed([ids[d], hashes[d], start, stop]))
                # settled already: any group will do, and the blobs spread over as many as there are buckets
                names.append(buckets + zlib.crc32(blobs[-1]) % buckets)
            for a, b in zip(edges[:-1], edges[1:]):
                i = order[a:b]
                names.append(int(bucket[a]))
                # half a minimiser is enough inside a bucket: if two get mixed up, they are settled together
                blobs.append(packed([(runs.value[i] >> np.uint64(32)).astype(np.uint32), ids[doc[i]], hashes[doc[i]].astype(np.int32), begin[i], runs.count[i].astype(np.int32), size[i].astype(np.int32),
                                     runs.twice[i], s.text[ragged(at[i], size[i])]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
        give_back()

    return deal


def settler(settle: Callable[[Pieces], tuple], buckets: int):
    """One bucket's blobs to spans (doc_id, text_hash, start, stop)."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            parts = [unpacked(b.as_py(), SPAN) for b in table.column("blob")]
            out = [np.concatenate(x) for x in zip(*parts)]
        else:
            # only the minimisers first, those of all blobs at once: what occurs once is not read further
            kept, parts, at = [unpacked(b.as_py(), PIECE) for b in table.column("blob")], [], 0
            _, inv, n = np.unique(np.concatenate([p[0] for p in kept]), return_inverse=True, return_counts=True)
            often = n[inv] > 1
            for k, p in enumerate(kept):
                kept[k] = None  # the rest of its text goes as soon as it is read
                i = np.flatnonzero(often[at:at + len(p[0])] | p[6])
                at += len(p[0])
                ends = np.cumsum(p[5], dtype=np.int64)
                text, stop, size = p[7].tobytes(), ends[i].tolist(), p[5][i].tolist()
                parts.append([p[0][i], p[1][i], p[2][i].astype(np.int64), p[3][i], p[4][i].astype(np.int64), p[6][i], [text[e - c:e] for e, c in zip(stop, size)]])
            del kept, p
            pieces = Pieces(*[np.concatenate(x) for x in zip(*[p[:6] for p in parts])], [t for p in parts for t in p[6]])
            del parts
            out = settle(pieces)
            del pieces
        give_back()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "text_hash", "start", "stop"])

    return run


def by_value(pieces: Pieces, limit: int) -> Iterator[Pieces]:
    """The pieces in runs of whole minimisers of about ``limit`` bytes, equal minimisers together."""
    order = np.argsort(pieces.value, kind="stable")
    value = pieces.value[order]
    sizes = np.array([len(t) for t in pieces.text], np.int64)[order] if len(order) else np.zeros(0, np.int64)
    i = 0
    total = np.append(0, np.cumsum(sizes))
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        j = int(np.searchsorted(value, value[min(j, len(value)) - 1], "right"))
        o = order[i:j]
        yield Pieces(pieces.value[o], pieces.doc_id[o], pieces.text_hash[o], pieces.start[o], pieces.count[o], pieces.twice[o], [pieces.text[x] for x in o.tolist()])
        i = j


def hot_slots(docs: DataFrame, symbols: Callable, width: int, gram: int, size: int) -> np.ndarray:
    """Number of slots, then the hot ones. Slots grow with the input up to 2^22; hot ones are at most a
    quarter of them."""
    slots = 1 << min(22, max(14, (size // (1 << 14)).bit_length()))

    most = max(HOT_PIECES, 4 * (size // gram) // slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in chunks(batches, "text"):
            s = symbols(batch.column("text"))
            total += np.bincount(slot_of(runs_of(s.codes, s.offsets, width, gram).value, slots), minlength=slots)
        parts = [(i, packed([total[i:i + SLOT_BLOCK]])) for i in range(0, slots, SLOT_BLOCK) if total[i:i + SLOT_BLOCK].any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["first", "counts"])
        give_back()

    def hottest(table: pa.Table) -> pa.Table:
        total = sum(unpacked(x.as_py(), [np.int64])[0] for x in table.column("counts"))
        return pa.table({"slot": pa.array(table.column("first")[0].as_py() + np.flatnonzero(total > most), pa.int64())})

    counts = docs.select("text").mapInArrow(count, "first long, counts binary")
    return np.array([slots, *sorted(r["slot"] for r in counts.groupBy("first").applyInArrow(hottest, "slot long").collect())], np.int64)


def repeated_spans(docs: DataFrame, symbols: Callable, width: int, gram: int, settle: Callable[[Pieces], tuple], keep_first: bool, inflation: float) -> DataFrame:
    """Spans (in symbols) of ``docs`` (doc_id, text_hash, text) that ``settle`` finds repeated, merged per
    document into a sorted array ``spans`` of structs (start, stop)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(size * inflation / BUCKET_BYTES))
    hot = hot_slots(docs, symbols, width, gram, size)
    pieces = docs.mapInArrow(dealer(symbols, width, gram, buckets, hot, keep_first), "bucket long, blob binary")
    spans = pieces.groupBy("bucket").applyInArrow(settler(settle, buckets), SPANS)
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


@F.pandas_udf(T.BinaryType())
def shrunk(texts: pd.Series) -> pd.Series:
    """Texts compressed one by one, for an exchange."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return texts.map(lambda t: pack(t.encode("utf-8")))


def grown(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def with_spans(docs: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """``docs`` with __text (compressed) and __spans (null: none); if its text is not asked for afterwards,
    texts are exchanged in compressed form only."""
    i, h, t = identified(docs, doc_id, text)
    keyed = docs.withColumns({"__i": i, "__h": h, "__text": shrunk(t)})
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    return keyed.join(spans, (F.col("__i") == F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")


def identified(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column, Column]:
    """doc_id (null: the least long), 32-bit hash of the text (tells rows of one id apart), and the text
    (null: empty)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), F.hash(t).cast("long"), t
