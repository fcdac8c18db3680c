"""Sequences of a fixed length from whole documents, by first-fit decreasing.

Documents are tokenized and cut into pieces of at most one sequence. The pieces are packed independently in
random groups of documents (a hash of the document): within a group the longest piece goes first, into the
first open sequence that has room, which a tournament tree of the free room finds in a logarithm of steps.
A group holds about ``GROUP_DOCS`` documents at any size of the input, and only piece lengths reach it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import chunks, give_back

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 16_384
#: distinct words a task remembers before it starts afresh
REMEMBERED = 600_000
PIECES = "doc_id long, text_hash long, start long, length long, doc_tokens long, ids binary"


# fixed values: how the tokenizer's file splits lower-cased text
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of words (bytes, without white space) as bytes of little-endian unsigned 32-bit integers.

    The library's own pipeline takes most of its time to normalize and split. For words of Latin letters
    that is done here for all new words of a chunk at once (lower case, split, bytes as characters); the
    library's model then encodes their parts in one call, and its tokens that close a part tell where each
    word ends. Any other word goes through the library as a whole. Both give the library's ids.

    Words are kept in two halves: when the newer one is full it becomes the older one, so what is met again
    in time stays known."""

    def __init__(self, tokenizer: Tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.half, self.new, self.old = tokenizer, max(1, remembered // 2), {}, {}
        self.parts = {}
        self.plain = Tokenizer(tokenizer.model)  # the model alone, on parts between blanks
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.split = regex.compile(_SPLIT + r"|\n").findall
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown and b != 32]
        self.shown = np.arange(256, dtype="<u4")  # character of a byte; the blank stays the separator
        self.shown[hidden] = 256 + np.searchsorted(sorted([*hidden, 32]), hidden)
        self.closes = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of each text, a list of words."""
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        known = self.new
        missing = list(set().union(*texts).difference(known))
        if self.old:
            found = [(w, self.old[w]) for w in missing if w in self.old]
            known.update(found)
            missing = [w for w in missing if w not in known] if found else missing
        if missing:
            self.learn(missing)
        return [b"".join(map(known.__getitem__, words)) for words in texts]

    def learn(self, words: list[bytes]) -> None:
        shown = [w.decode("utf-8") for w in words]
        latin = [(t.isascii() or max(t) < "\u0250") and t.isprintable() and "<|" not in t for t in shown]
        other = [t for t, own in zip(shown, latin) if not own]
        if other:
            ids = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
            self.new.update(zip([w for w, own in zip(words, latin) if not own], ids))
            words, shown = [w for w, own in zip(words, latin) if own], [t for t, own in zip(shown, latin) if own]
        if words:
            parts = self.split("\n".join(shown).lower())
            self.learn_parts(parts)
            ids, at = list(map(self.parts.__getitem__, parts)), 0
            for w in words:
                end = parts.index("\n", at)
                self.new[w] = ids[at] if end == at + 1 else b"".join(ids[at:end])
                at = end + 1

    def learn_parts(self, parts: list[str]) -> None:
        """Ids of all ``parts`` under ``self.parts``; a line end closes the parts of the last word too."""
        parts.append("\n")
        if len(self.parts) >= 2 * self.half:
            self.parts.clear()
        self.parts["\n"] = b""
        missing = list(set(parts).difference(self.parts))
        if missing:
            raw = " ".join(missing)
            if not raw.isascii():
                raw = self.shown[np.frombuffer(raw.encode("utf-8"), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.plain.encode_batch_fast([raw], add_special_tokens=False)[0].ids, "<u4")
            stop = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            ids, at = ids.tobytes(), 0
            for part, end in zip(missing, stop.tolist(), strict=True):
                self.parts[part] = ids[at:end]
                at = end


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, text_hash, start, length, doc_tokens (of the document, with ``end_id``), and
    ids as a binary of little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never looks across it, so each distinct word is encoded once in a
    task. A null text is empty and gives one piece with ``end_id`` alone; repeated rows are documents of
    their own."""
    with open(path, encoding="utf-8") as f:
        model = f.read()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        known = WordIds(Tokenizer.from_str(model))
        tail = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, "text", 1_000_000):
            texts = [t.split() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            cols = [[], [], [], [], [], []]
            for d, h, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), known.of(texts)):
                ids += tail
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at:at + 4 * length]
                    for c, x in zip(cols, (d, h, at // 4, len(piece) // 4, len(ids) // 4, piece)):
                        c.append(x)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "text_hash", "start", "length", "doc_tokens", "ids"])
        del known
        give_back()

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(tokenize, PIECES)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ``lengths`` must not increase."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1)).bit_length()
    free = [room] * (2 * leaves)  # free[i] is the most room in any leaf below node i
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, size in enumerate(lengths.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if free[i] < size:
                i += 1
        bins[k], offsets[k] = i - leaves, room - free[i]
        free[i] -= size
        while i > 1:
            i //= 2
            most = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            if free[i] == most:
                break
            free[i] = most
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``pieces`` (doc_id, text_hash, start, length and any other columns) with sequence_id and offset.

    Each piece lies in exactly one sequence, offsets in a sequence are gapless from 0, no sequence exceeds
    ``length``. Groups come from a hash of the document, so the result does not depend on the order of the
    rows, but for rows equal in all columns, which are interchangeable. An empty table stays empty."""
    groups = max(1, round(n_docs / group_docs))
    wanted = pieces.schema.simpleString()[len("struct<"):-1]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["length", "doc_id", "text_hash", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(rows["group"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(columns="group")

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(77), "doc_id", "text_hash"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fill, wanted.replace(":", " ") + ", sequence_id long, offset long")
