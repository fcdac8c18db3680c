"""Word windows that occur more than once anywhere, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to its bucket, where sorting counts
the windows exactly (``superwindows`` deals them out). Every word a repeated window covers is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fields, give_back, names, ragged
from .superwindows import Pieces, by_value, grown, identified, mixed, powers, repeated_spans, with_spans, word_symbols

WINDOW = 35
GRAM = 4
#: bytes of pieces sorted at once
SORTED_BYTES = 4_000_000


def _window_hashes(text: list[bytes], count: np.ndarray, width: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """Hashes of all windows of the pieces, end to end, and the words of each piece."""
    words = [t.split() for t in text]
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for p in words for w in p), np.int64)
    codes = mixed(codes.astype(np.uint64) + np.uint64(1))
    power, inverse = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:-1], out=total[1:])
    lengths = np.array([len(p) for p in words], np.int64)
    at = ragged(np.cumsum(lengths) - lengths, count)
    return mixed((total[at + width] - total[at]) * inverse[at]), words


def repeated_windows(text: list[bytes], count: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
    """For every window of distinct pieces, each found ``times`` times: does it occur twice or more?"""
    hashes, words = _window_hashes(text, count, width)
    piece = np.repeat(np.arange(len(count)), count)
    within = ragged(np.zeros(len(count), np.int64), count)
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    group = np.cumsum(new) - 1
    # equal hashes are no proof: compare each window with the first of its group
    first = order[np.flatnonzero(new)][group]
    other = np.flatnonzero(first != order)
    for i in other.tolist():
        a, b = order[i], first[i]
        x, y = words[piece[a]], words[piece[b]]
        if x[within[a]:within[a] + width] != y[within[b]:within[b] + width]:
            exact: dict[tuple, int] = {}
            group = np.array([exact.setdefault(tuple(words[piece[j]][within[j]:within[j] + width]), len(exact)) for j in order.tolist()])
            break
    n = np.bincount(group, weights=times[piece[order]].astype(np.float64))
    out = np.zeros(len(hashes), bool)
    out[order] = n[group] > 1
    return out


def settle_words(width: int):
    def settle(pieces: Pieces):
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for part in by_value(pieces, SORTED_BYTES):
            same: dict[bytes, int] = {}
            which = np.array([same.setdefault(t, len(same)) for t in part.text], np.int64)
            heads = np.unique(which, return_index=True)[1]
            count = part.count[heads]
            hit = repeated_windows(list(same), count, np.bincount(which), width)
            begins = np.cumsum(count) - count
            at = ragged(begins[which], part.count)  # windows of every occurrence
            row = np.repeat(np.arange(len(which)), part.count)
            within = ragged(np.zeros(len(which), np.int64), part.count)
            flag = hit[at]
            start = flag & ~np.append(False, flag[:-1] & (row[1:] == row[:-1]))
            stop = flag & ~np.append(flag[1:] & (row[1:] == row[:-1]), False)
            r = row[start]
            for o, x in zip(out, (part.doc_id[r], part.text_hash[r], part.start[r] + within[start], part.start[r] + within[stop] + width)):
                o.append(x)
        return [np.concatenate(o) for o in out]

    return settle


def covered(n: int, spans) -> np.ndarray:
    """Which of n positions the spans (start, stop) cover."""
    step = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        for s in spans:
            step[s["start"]] += 1
            step[s["stop"]] -= 1
    return np.cumsum(step[:-1]) > 0


@F.pandas_udf(fields("n_words long, n_removed long, kept string, kept_sha256 string"))
def _cut(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans, wanted in rows:
        out = []
        for text, s, full in zip(map(grown, texts), spans, wanted):
            words = text.split()
            gone = covered(len(words), s)
            removed = int(gone.sum())
            left = b" ".join(words if not removed else [w for w, g in zip(words, gone.tolist()) if not g])
            out.append((len(words), removed, (left if removed else text).decode("utf-8") if full else None, hashlib.sha256(left).hexdigest()))
        yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "kept_sha256"])
    give_back()


def repeated_word_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash and ``spans`` (sorted, of word positions) of the documents with a repeated window."""
    i, h, t = identified(docs, doc_id, text)
    return repeated_spans(docs.select(i.alias("doc_id"), h.alias("text_hash"), t.alias("text")), word_symbols, width, gram, settle_words(width), False, 3.2)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and, under ``dedup``, a struct of n_words, n_removed, kept (the kept words
    joined by one space, or the text as it was if none is removed; null without ``with_text``) and kept_sha256
    (of the kept words joined by one space).

    Every word in a window of ``width`` words whose word sequence also starts elsewhere goes, all
    occurrences alike. A null text has no words; a text shorter than a window stays; a repeated row is an
    occurrence of its own; documents with one id and different texts are different documents; an empty
    table stays empty."""
    docs = docs.drop("dedup")
    both = with_spans(docs, doc_id, text, repeated_word_spans(docs, doc_id, text, width, gram))
    return both.select(*names(docs), _cut("__text", "__spans", F.lit(with_text)).alias("dedup"))
