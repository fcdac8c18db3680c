"""Hard negatives of anchors by slot-decomposed selection.

An anchor's positives set windows of scores that overlap: each window ends at its positive's score and begins at
a share of it. The upper limits cut the scores into disjoint slots; a row of another label falls into one slot at
most, a tile of (anchors x rows) keeps the best k of each slot, and so does every merge. The answer of a window is
the best k of its own slot and all slots below it, so one merge from the lowest slot upwards answers all windows;
what lies under a window's lower limit is cut last, since it can only follow the rows that stay.

Anchors and rows are dealt to a grid of tiles: a tile holds a bounded number of both, whatever the labels, and
scores them by a matrix product. Two rounds run over the grid, one for the positives and one for the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import stage

POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 5, 80, 100
SCALE = 256
#: most rows and anchors of a tile; with fewer rows than make ``TILES`` such tiles, smaller ones down to ``LEAST_ROWS``
TILE_ROWS, TILE_ANCHORS, LEAST_ROWS, TILES = 50_000, 10_000, 2_000, 64
#: scores held at once
TILE_CELLS = 2_000_000


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x) of the rows that take part, x the floored components as doubles."""
    x = F.transform(F.col(embedding), lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    whole = F.forall(embedding, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & whole
    # floor() gives a long: components beyond it cannot be scored exactly, see ``hard_negatives``
    small = F.forall(embedding, lambda e: F.abs(e.cast("double")) < float(1 << 30))
    x = F.when(small, x).otherwise(F.raise_error(F.lit("a component is beyond 2^30: its products leave the range of long")))
    return rows.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two matrices of whole numbers, as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**55:  # a hundredfold still fits
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("inner products leave the range of long")


def _best(found: np.ndarray, row: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of every group of ``found``, by score down, then row up."""
    order = np.lexsort((row, -score, found))
    group = found[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[nth < most]


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to tiles (down, across); the smaller copies are the anchors'."""
    downs = max(1, -(-n_rows // TILE_ROWS), min(TILES, n_rows // LEAST_ROWS))
    acrosses = max(1, -(-n_anchors // TILE_ANCHORS))
    down = F.pmod(F.xxhash64("vec_id"), F.lit(downs)).cast("int")
    across = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(acrosses)).cast("int")
    tiled_rows = rows.select("*", down.alias("down"), F.explode(F.sequence(F.lit(0), F.lit(acrosses - 1))).alias("across"))
    tiled_anchors = anchors.select("*", across.alias("across"), F.explode(F.sequence(F.lit(0), F.lit(downs - 1))).alias("down"))
    return tiled_rows.groupBy("down", "across"), tiled_anchors.groupBy("down", "across")


def _tile(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of one side."""
    dim = len(table.column("x")[0]) if table.num_rows else 0
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("x"), dim)


def _merge(df: DataFrame, by: list[str], row: str, most: int) -> DataFrame:
    """The best ``most`` of each group, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(row))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score s has
    lowest * positive_score <= 100 * s <= highest * positive_score. Scores are integer inner products of
    floor(256 x); ties go to the smaller id.

    ``is_anchor`` is a condition on ``vec_id``. Rows with a null id, label or vector, or a null or non-finite
    component take no part; an empty vector scores 0. Vectors of different lengths, and scores beyond a long, raise.
    Repeated rows are rows of their own (an anchor's copies under the same id are never its positives).
    Of an anchor's rows under one id and label, the least vector counts. An anchor without positives or negatives has no row; an empty table gives an empty result. Extra columns
    are not read."""
    part = stage(vectors(rows, vec_id, embedding, label), "vectors")
    size = part.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size["n"] and size["least"] != size["most"]:
        raise ValueError("vectors of different lengths")
    anchors = stage(part.where(is_anchor).groupBy("vec_id", "label").agg(F.min("x").alias("x")), "anchors")
    n_anchors = anchors.count()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, labels, x = _tile(left)
            a_ids, a_labels, a = _tile(right)
            for value in np.unique(a_labels):
                mine, theirs = np.flatnonzero(a_labels == value), np.flatnonzero(labels == value)
                step = max(1, TILE_CELLS // max(1, len(theirs)))
                for i in range(0, len(mine), step):
                    some = mine[i:i + step]
                    s = _products(a[some], x[theirs])
                    other = ids[theirs][None, :] != a_ids[some][:, None]
                    if s.shape[1] > positives:  # only scores that reach the last place matter
                        last = s.shape[1] - positives
                        other &= s >= np.partition(np.where(other, s, np.iinfo(np.int64).min), last, axis=1)[:, last, None]
                    at, row = np.nonzero(other)
                    keep = _best(at, ids[theirs][row], s[at, row], positives)
                    out.append((a_ids[some][at[keep]], ids[theirs][row[keep]], s[at[keep], row[keep]], np.full(len(keep), value)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor_id", "positive_id", "score", "label"), (c.astype(np.int64) for c in cols))))

    left, right = _grid(part, anchors, size["n"], n_anchors)
    found = left.cogroup(right).applyInArrow(nearest, "anchor_id long, positive_id long, score long, label long")
    # anchors are named by id and label, so that two labels under one id stay apart
    best = stage(_merge(found, ["anchor_id", "label"], "positive_id", positives), "positives")

    limits = best.groupBy(F.col("anchor_id").alias("vec_id"), "label").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))

    def slotted(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, labels, x = _tile(left)
            a_ids, a_labels, a = _tile(right)
            lists = right.column("limits").to_pylist()
            low_end = np.iinfo(np.int64).min
            upper = np.full((len(a_ids), positives + 1), low_end)  # no score is that low: an empty slot
            for i, values in enumerate(lists):
                upper[i, :len(values)] = values
            step = max(1, TILE_CELLS // len(ids))
            for i in range(0, len(a_ids), step):
                some = np.arange(i, min(i + step, len(a_ids)))
                s = _products(a[some], x)
                open_ = labels[None, :] != a_labels[some][:, None]
                for slot in range(positives):
                    top, under = upper[some, slot, None], upper[some, slot + 1, None]
                    # the lowest score of interest in the slot is that of the slot's own window
                    inside = open_ & (100 * s <= highest * top) & (100 * s >= lowest * top) & (top > low_end)
                    inside &= ~((100 * s <= highest * under) & (under > low_end))
                    full = inside.sum(1) > 4 * negatives
                    if full.any():  # most of a crowded slot is cut before it is sorted
                        many = np.flatnonzero(full)
                        least = np.partition(np.where(inside[many], s[many], low_end), s.shape[1] - negatives, axis=1)[:, s.shape[1] - negatives]
                        inside[many] &= s[many] >= least[:, None]
                    at, row = np.nonzero(inside)
                    keep = _best(at, ids[row], s[at, row], negatives)
                    at, row = at[keep], row[keep]
                    out.append((a_ids[some][at], a_labels[some][at], np.full(len(at), slot), ids[row], s[at, row]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor_id", "label", "slot", "negative_id", "score"), (c.astype(np.int64) for c in cols))))

    left, right = _grid(part, anchors.join(limits, ["vec_id", "label"]), size["n"], n_anchors)
    found = left.cogroup(right).applyInArrow(slotted, "anchor_id long, label long, slot long, negative_id long, score long")
    kept = _merge(found, ["anchor_id", "label", "slot"], "negative_id", negatives)
    # at most negatives rows in each of at most positives slots: from the lowest slot upwards
    one = F.struct((-F.col("score")).alias("down"), F.col("negative_id").alias("id"))
    slots = kept.groupBy("anchor_id", "label").agg(F.sort_array(F.collect_list(F.struct(F.col("slot").alias("slot"), one.alias("row")))).alias("slots"))
    joined = best.select("anchor_id", "label", "positive_id", F.col("score").alias("positive_score")).join(slots, ["anchor_id", "label"])
    joined = joined.join(limits.withColumnRenamed("vec_id", "anchor_id"), ["anchor_id", "label"])
    mine = F.array_position("limits", F.col("positive_score")) - 1
    below = F.filter("slots", lambda r: (r["slot"] >= mine) & (-r["row"]["down"] * 100 >= F.col("positive_score") * lowest))
    answer = F.slice(F.transform(below, lambda r: r["row"]), 1, negatives)
    out = joined.select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("nth", "row"))
    return out.select("anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"), "positive_score",
                      (-F.col("row.down")).alias("negative_score"))
