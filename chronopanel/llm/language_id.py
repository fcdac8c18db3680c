"""Language identification by error-correcting output codes.

Each language has a codeword of bits; each bit has a binary classifier over hashed byte n-grams (a linear
log-odds between the languages whose bit is 1 and those whose bit is 0). A text's bits are decoded by loss:
the codeword with the least sum of logistic losses wins, each bit weighed by how reliable it is for that
language. If the second codeword is nearly as close, the text is flagged as ambiguous.

Fitting is one pass of n-gram counts per language over all labelled rows, summed by Spark; the driver holds
``SLOTS`` numbers per language. The bits' reliabilities come from a bounded sample (``SAMPLE`` rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import stage
from .common import chunks, fields, ragged, utf8

SIZES = (2, 3, 4)
SLOTS = 1 << 14
SAMPLE = 2_000
#: least probability-like score of an answer that is not flagged
CLEAR = 0.6
UNKNOWN = "und"
#: with at most so many languages every split of them is a bit
EXHAUSTIVE = 7

# letters lower-cased, other ASCII as blanks, bytes of other characters as they are
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 / -1: all splits for few languages, else distinct random rows."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    rng, width = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n)))
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all():
            return code


def ngram_slots(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the slot of every position of all texts (SLOTS where the text ends before) and
    the n + 1 text offsets. A text is framed by blanks."""
    data, offsets = utf8(column)
    size = np.diff(offsets)
    framed = np.full(len(data) + 2 * len(size) + 4, 32, np.uint8)
    starts = offsets[:-1] + 2 * np.arange(len(size))
    framed[ragged(starts + 1, size)] = _FOLD[data]
    n = len(framed) - 4
    wide = framed.astype(np.uint32)
    wide = wide[:n] | wide[1:n + 1] << 8 | wide[2:n + 2] << 16 | wide[3:n + 3] << 24
    bounds = np.append(starts, n)
    for k in SIZES:
        part = wide & np.uint32((1 << 8 * k) - 1) if k < 4 else wide
        slot = ((part + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int32)
        for back in range(1, k):
            slot[bounds[1:] - back] = SLOTS
        yield slot, bounds


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # language x bit, +1 / -1
    weights: np.ndarray   # slot x bit; the last row is zero
    trust: np.ndarray     # language x bit, rows sum to 1

    def margins(self, column: pa.Array) -> np.ndarray:
        """Evidence for each bit: mean log-odds of the n-grams times the root of their number."""
        total, n = np.zeros((len(column), self.code.shape[1])), np.zeros(len(column))
        for slot, bounds in ngram_slots(column):
            total += np.add.reduceat(self.weights[slot], bounds[:-1], axis=0, dtype=np.float32)
            n += np.diff(bounds)
        return total / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword and its score among all."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        far = (loss * self.trust[None]).sum(2) * self.code.shape[1]
        best = far.argmin(1)
        near = np.exp(-(far - far.min(1, keepdims=True)))
        return best, 1 / near.sum(1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text", 1_000_000):
        langs = batch.column("lang").to_pylist()
        local = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        which = np.array([local[x] for x in langs])
        n = np.zeros(len(local) * (SLOTS + 1), np.int64)
        for slot, bounds in ngram_slots(batch.column("text")):
            n += np.bincount(np.repeat(which, np.diff(bounds)) * (SLOTS + 1) + slot, minlength=len(n))
        for x, row in zip(local, n.reshape(-1, SLOTS + 1)):
            total[x] = total.get(x, 0) + row[:SLOTS]
    for x, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(row[at], pa.int64())], names=["lang", "slot", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of ``labelled`` (lang, text); rows with a null in either are left out. Bits are weighed by their
    accuracy on ``sample`` different texts, those with the least hash (hashes are ranked, only the chosen texts move)."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).na.drop()
    found = rows.mapInArrow(_counts, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(found["lang"]))
    code = codewords(len(languages))
    if not code.size:
        return Model(languages, code, np.zeros((SLOTS + 1, 0), np.float32), np.zeros(code.shape))
    count = np.zeros((len(languages), SLOTS))
    count[np.searchsorted(languages, found["lang"]), found["slot"]] = found["n"]
    share = (count + 0.5) / (count.sum(1, keepdims=True) + 0.5 * SLOTS)
    weights = np.zeros((SLOTS + 1, code.shape[1]), np.float32)
    for j, bit in enumerate(code.T):
        weights[:SLOTS, j] = np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    least = stage(hashed.select("h", "lang").distinct().orderBy("h", "lang").limit(sample), "sample")
    held = hashed.join(F.broadcast(least), ["h", "lang"]).dropDuplicates(["h", "lang"]).select("lang", "text")
    right, seen = np.ones(code.shape), np.ones((len(languages), 1))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1_000_000):
            which = np.searchsorted(languages, batch.column("lang").to_pylist())
            ok = model.margins(batch.column("text")) * code[which] > 0
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([x.tobytes() for x in ok], pa.binary())], names=["lang", "ok"])

    for r in held.mapInArrow(hits, "lang long, ok binary").groupBy("lang", "ok").count().collect():
        right[r["lang"]] += np.frombuffer(r["ok"], bool) * r["count"]
        seen[r["lang"]] += r["count"]
    accuracy = right / seen
    model.trust = accuracy / accuracy.sum(1, keepdims=True)
    return model


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score (0 to 1) and ambiguous. A null text, one without a letter, or a model
    without languages gives ``und`` with score 0; a model of one language gives that with score 1."""

    @F.arrow_udf(fields("lang_pred string, score double, ambiguous boolean"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for part in chunks([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", 1_000_000):
                if model.code.size:
                    best, score = model.decode(model.margins(part.column("text")))
                else:
                    best, score = np.zeros(part.num_rows, int), np.ones(part.num_rows)
                names += [model.languages[i] for i in best.tolist()]
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(score < CLEAR, pa.bool_())],
                                             names=["lang_pred", "score", "ambiguous"])

    letters = F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    p = run(F.coalesce(text.cast("string"), F.lit("")))
    return F.struct(F.when(letters, p["lang_pred"]).otherwise(UNKNOWN).alias("lang_pred"), F.when(letters, p["score"]).otherwise(0.0).alias("score"),
                    (letters & p["ambiguous"]).alias("ambiguous"))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by the CRC of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    """The struct of ``predict`` for the rows of ``docs``, learned from those of its labelled rows that are
    not held out. Empty tables, repeated rows and null ids or labels are fine."""
    model = fit(docs.where(~held_out(F.col(doc_id))).select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    return predict(F.col(text), model)
