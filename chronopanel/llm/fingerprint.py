"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

The shingles of a text are hashed once. The top bits of a hash name its bin, each bin keeps its least hash,
an empty bin borrows the value of the filled bin that a hash of (empty bin, filled bin) ranks first (optimal
densification: each empty bin draws its own order of the others), and the low bits of the 128 values are
packed into a hex string. Likeness is the share of equal values, corrected for values equal by chance.

A fingerprint is a function of its row: no exchange. What a document's successor has (``compare_edits``)
comes from a window over blocks of ids: block borders are quantiles of the ids, and the first row of each
block is copied to the block before it, so no window spans the table and texts are exchanged once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import BLANKS

BINS, LOW_BITS, SHINGLE = 128, 8, 5
_BIN_SHIFT = 64 - BINS.bit_length() + 1
#: bytes of text in a block of ids, until there are MOST_BLOCKS of them
BLOCK_BYTES = 8_000_000
MOST_BLOCKS = 4_096
_ASCII_BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _BIN_SHIFT)


def _shingles(text: Column) -> Column:
    """Hashes of all runs of five words; of all words if there are fewer; empty without a word."""
    trimmed = F.btrim(text, F.lit(_ASCII_BLANKS))

    def of_words(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, many).otherwise(F.array(F.xxhash64(w)))

    words = F.transform(F.split(trimmed, BLANKS), lambda w: F.xxhash64(w))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(_let(words, of_words))


def minhash(text: Column) -> Column:
    """The BINS low-order values of a text (null: empty) as an array; empty for a text without a word."""
    low = lambda h: h.bitwiseAND((1 << LOW_BITS) - 1)

    def densified(heads: Column) -> Column:
        def fill(bins: Column) -> Column:
            def value(j: Column) -> Column:
                rank = lambda h: F.shiftleft(F.xxhash64(j, _bin(h)), LOW_BITS).bitwiseOR(low(h))
                borrowed = low(F.array_min(F.transform(heads, rank)))
                return _let(F.array_position(bins, j), lambda at: F.when(at > 0, low(F.get(heads, (at - 1).cast("int")))).otherwise(borrowed))
            return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), value)

        return (F.when(F.size(heads) == 0, heads).when(F.size(heads) == BINS, F.transform(heads, low))
                .otherwise(_let(F.transform(heads, _bin), fill)))

    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))

    # signed order keeps a bin together, but puts the upper half of the bins first
    ordered = lambda heads: F.when(F.size(heads) == BINS, F.concat(F.filter(heads, lambda x: x >= 0), F.filter(heads, lambda x: x < 0))).otherwise(heads)
    hashes = F.sort_array(_shingles(F.coalesce(text, F.lit(""))))
    return _let(_let(hashes, firsts), lambda heads: _let(ordered(heads), densified))


def packed(values: Column) -> Column:
    """Two hex digits a bin; an empty string without a word."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: two texts without a word are alike, one is unlike any other."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / BINS
    chance = 2.0 ** -LOW_BITS
    corrected = F.greatest((equal - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def _block(borders: list[int], value: Column) -> Column:
    """How many borders lie at or below the value, by a coarse and a fine step."""
    step = max(1, math.isqrt(len(borders)))
    groups = [borders[i:i + step] for i in range(0, len(borders), step)]
    if not groups:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    coarse = count(longs([g[0] for g in groups]))
    fine = F.array(*[longs(g) for g in groups])
    return _let(coarse, lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + count(F.get(fine, c - 1))))


def with_next(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, Window]:
    """Rows (block, extra, doc_id, text_hash, ``columns``) and the window in which the next row is the
    document's successor: ascending doc_id (null first), then text hash; after the last the first. Rows with
    ``extra`` are copies that only serve as successors."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, min(MOST_BLOCKS, round(size / BLOCK_BYTES)))
    borders: list[int] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        borders = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("q")).first()["q"] or []))
    keyed = docs.withColumn("block", _block(borders, F.col("doc_id")))
    first = sorted((r["block"], r["k"]) for r in keyed.groupBy("block").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).collect())
    before = {b: first[i - 1][0] for i, (b, _) in enumerate(first)}
    blocks = len(borders) + 1
    ids, hashes, targets = [None] * blocks, [None] * blocks, [None] * blocks
    for b, k in first:
        ids[b], hashes[b], targets[b] = k["doc_id"], k["text_hash"], before[b]
    arr = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])
    at = lambda xs, kind: F.get(arr(xs, kind), F.col("block"))
    leads = F.col("doc_id").eqNullSafe(at(ids, "bigint")) & (F.col("text_hash") == at(hashes, "bigint"))
    here, copy = F.struct(F.col("block"), F.lit(False).alias("extra")), F.struct(at(targets, "int").alias("block"), F.lit(True).alias("extra"))
    spread = keyed.withColumn("place", F.explode(F.when(leads, F.array(here, copy)).otherwise(F.array(here))))
    rows = spread.select("place.block", "place.extra", "doc_id", "text_hash", *columns)
    return rows, Window.partitionBy("block").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text_hash")


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last quarter of code points (rounded down) replaced by the first as many of the
    next document's text.

    A null text is empty and has the empty fingerprint. Rows repeating an id follow each other in the order
    of a hash of their texts; a single row is its own successor; an empty table stays empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows, window = with_next(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_hash")), ["text"])
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    rows = rows.withColumn("follow", F.coalesce(F.lead("text").over(window), F.lit("")))
    rows = rows.withColumn("n_chars", n.cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("follow"), F.lit(1), tail)))
    rows = rows.select("block", "extra", "doc_id", "text_hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), minhash(F.col("text")).alias("own"),
                       F.when(~F.col("extra"), minhash(F.col("edited"))).alias("new"))
    rows = rows.withColumn("next", F.lead("own").over(window)).where("NOT extra")
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("new")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
