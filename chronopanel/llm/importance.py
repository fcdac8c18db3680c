"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

1. One Arrow pass counts hashed n-gram features of all documents, another those of the target texts: one array
   of bucket counts a task, summed by Spark.
2. The log-ratio of the two distributions is an array with one gain for each bucket (``buckets`` numbers, whatever
   the input). A second Arrow pass scores a document by the floored mean of its features' gains; a hashed Gumbel
   number turns the top of the scores into a draw without replacement.
3. The eligible documents are sorted by (score down, id up) with a least-significant-digit radix sort: the
   composite key is cut into digits; each pass counts the digits of every block of rows, prefix sums of these
   counts give where the rows of a (digit, block) begin, and a row's place is that beginning plus its rank among
   the rows of its digit and block. Each pass is stable, so after the last one the places are the final ranks.
   A pass moves only (place, key); no task holds more than a block of rows and its digit counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import stage
from .common import chunks, ragged, utf8

BUCKETS, SEED, LEAST_WORDS, PERCENT, GRAMS = 10_000, 2024, 20, 10, 1
#: bits of a digit of the radix sort, and rows of a block
DIGIT_BITS, BLOCK_ROWS = 12, 250_000
#: features longer than this are hashed one by one
LONG = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes of words: digits, letters, and all bytes of characters beyond ASCII
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc32(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start : start + length], all features byte by byte at once."""
    table = _crc_table()
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    longer = int(np.searchsorted(-size, -LONG, "left"))
    crc = out[longer:]
    at, left = begin[longer:], size[longer:]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        crc[:n] = table[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = ~out
    for i in range(longer):
        out[i] = zlib.crc32(data[begin[i]:begin[i] + size[i]])
    result = np.empty_like(out)
    result[order] = out
    return result


def features(data: np.ndarray, ends: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end (bytes, n + 1 offsets): the bucket of every feature, text by text; features of each
    text; words of each text."""
    low = _LOWER[data]
    word = _WORD[low]
    n = len(ends) - 1
    # a word does not reach over the border of two texts
    edge = np.zeros(len(low) + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    stops = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    doc = np.searchsorted(ends, begins, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    if grams > 1:  # words of a text joined by one space each
        size = stops - begins + 1
        line = np.full(int(size.sum()), 32, np.uint8)
        to = np.cumsum(size) - size
        line[ragged(to, size - 1)] = low[ragged(begins, size - 1)]
        low, begins, stops = line, to, to + size - 1
    last = np.append(0, np.cumsum(n_words))[1:][doc] if len(doc) else doc
    of, found = [], []
    for g in range(grams):
        first = np.flatnonzero(np.arange(len(begins)) + g < last)
        of.append(doc[first])
        found.append(crc32(low, begins[first], stops[first + g] - begins[first]).astype(np.int64) % buckets)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return found[order], np.bincount(of, minlength=n), n_words


def bucket_counts(texts: DataFrame, text: str, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text"):
            total += np.bincount(features(*utf8(batch.column("text")), grams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket."""
    k = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    ratio = [(float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _draw(doc_id: Column, seed: int) -> Column:
    """floor(1000 x Gumbel number) from the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))


def scores(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found, n, n_words = features(*utf8(batch.column("text")), grams, buckets)
            upto = np.append(0, np.cumsum(gain[found]))
            stop = np.cumsum(n)
            total = upto[stop] - upto[stop - n]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words.astype(np.int64), n.astype(np.int64), weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = t.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed))


def _shifted(key: str, low: int | None) -> Column:
    """A long column less its least value, as bits without a sign; 0 for null."""
    if low is None:
        return F.lit(0).cast("long")
    d = F.col(key).cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")
    d = F.when(d >= F.lit(str(1 << 63)).cast("decimal(38,0)"), d - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(d)
    return F.coalesce(d.cast("long"), F.lit(0).cast("long"))


def radix_ranks(rows: DataFrame, row: str, keys: list[str], block_rows: int = BLOCK_ROWS, bits: int = DIGIT_BITS) -> DataFrame:
    """(``row``, ``rank``) of each row: 1, 2, 3 ... in ascending order of the long columns ``keys`` (nulls last).
    ``row`` is a long that names a row. Rows equal in all keys get consecutive ranks in any order.

    A key is shifted by its least value and has as many digits as its range needs, so the number of passes
    depends on the range of the keys, not on the rows."""
    ends = [f(k).alias(f"{f.__name__}_{i}") for i, k in enumerate(keys) for f in (F.min, F.max, F.count)]
    span = rows.agg(F.count("*").alias("n"), *ends).first()
    blocks = max(1, -(-span["n"] // block_rows))
    digits = []  # least significant first
    for i in reversed(range(len(keys))):
        if span[f"count_{i}"]:
            for low in range(0, (span[f"max_{i}"] - span[f"min_{i}"]).bit_length(), bits):
                digits.append(F.shiftrightunsigned(f"k{i}", low).bitwiseAND((1 << bits) - 1))
        if span[f"count_{i}"] < span["n"]:
            digits.append(F.col(f"none{i}").cast("long"))
    kept = [c for i in range(len(keys)) for c in (f"k{i}", f"none{i}")]
    cols = [c for i, k in enumerate(keys) for c in (_shifted(k, span[f"min_{i}"]).alias(f"k{i}"), F.col(k).isNull().alias(f"none{i}"))]
    now = stage(rows.select(F.col(row).alias("row"), F.col(row).alias("place"), F.pmod(F.xxhash64(row), F.lit(blocks)).alias("block"), *cols), "radix")
    for digit in digits or [F.lit(0).cast("long")]:
        dealt = now.withColumn("digit", digit)
        counts = stage(dealt.groupBy("digit", "block").count(), "digits")
        totals = counts.groupBy("digit").agg(F.sum("count").alias("total"))  # at most 2^bits rows
        base = totals.select("digit", (F.sum("total").over(Window.orderBy("digit")) - F.col("total")).alias("base"))
        within = F.sum("count").over(Window.partitionBy("digit").orderBy("block")) - F.col("count")
        begin = counts.withColumn("within", within).join(F.broadcast(base), "digit").select("digit", "block", (F.col("base") + F.col("within")).alias("begin"))
        ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1)
        moved = ranked.join(begin, ["block", "digit"]).withColumn("place", F.col("begin") + F.col("nth"))
        now = stage(moved.select("row", "place", F.expr(f"place div {block_rows}").alias("block"), *kept), "radix")
    return now.select(F.col("row").alias(row), (F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", grams: int = GRAMS,
             buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``: of the rows with at least ``least_words``
    words, ``percent`` hundredths (floored) with the highest scores have a rank, ties to the smaller id.

    Null and empty texts have no feature and weight 0; a null id is drawn under the name ``null`` and comes last
    among equal scores; repeated rows are rows of their own with equal scores (in consecutive ranks); an empty
    table stays empty, and with an empty target every bucket has target count 0. Extra columns are not read."""
    gain = gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    every = stage(scores(docs, gain, doc_id, text, grams, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = every.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranks = radix_ranks(able.withColumn("down", -F.col("score")), "row", ["down", "doc_id"]).where(F.col("rank") <= drawn)
    return every.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
