"""Connected components of a table of links.

Each round deals the links to tasks by an end, joins what meets in a task (union by least member) and hands on
one star for each class the task has seen. Rounds that deal every link to both of its ends alternate with
rounds that deal it to its larger end only: the first bring far ends together, the second leave one link a node.
A task holds at most about ``TASK_LINKS`` links unless one node alone has more; a node with very many links is
first cut into hashed parts, each of which leaves one link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import BROADCAST_ROWS, stage

#: links a task joins at once
TASK_LINKS = 500_000
#: rounds after which something is wrong (each at least halves the longest chain)
MOST_ROUNDS = 60


def merged_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each class) after joining the classes of a[i] and b[i]."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        high, low = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
        label = label.copy()
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def star_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its class) of every node of the links that is not itself the least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = merged_labels(np.arange(len(nodes)), at[:len(u)], at[len(u):])
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _joined(dealt: DataFrame) -> DataFrame:
    """The stars of each part of ``dealt`` (part, u, v)."""

    def join(table: pa.Table) -> pa.Table:
        u, v = star_links(table.column("u").to_numpy(), table.column("v").to_numpy())
        return pa.table({"u": u, "v": v})

    return dealt.groupBy("part").applyInArrow(join, "u long, v long").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """``root``, the least member of its component, of every ``node`` of the links (two long columns) that is
    not itself the least. Links of a node with itself, repeated links and links with a null end count for nothing."""
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = stage(links.distinct(), "links")
    for turn in range(MOST_ROUNDS):
        n = links.count()
        parts = max(1, -(-2 * n // task_links))
        ends = links.withColumn("at", F.col("u"))
        if turn % 2 == 0 and parts > 1:
            ends = ends.union(links.select("u", "v", F.col("v").alias("at")))
        # a node with more links than a task takes is cut into parts by the other end
        busy = stage(ends.groupBy("at").agg(F.count("*").alias("most")).where(F.col("most") > task_links), "busy") if parts > 1 else None
        part = F.pmod(F.xxhash64("at"), F.lit(parts))
        if busy is not None and (n_busy := busy.count()):
            ends = ends.join(F.broadcast(busy) if n_busy <= BROADCAST_ROWS else busy, "at", "left")
            piece = F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("most") / task_links))
            part = F.when(F.col("most").isNull(), part).otherwise(F.xxhash64("at", piece))
        links = stage(_joined(ends.select(part.alias("part"), "u", "v")), "links")
        # settled: each node hangs on one root, and no root hangs on another
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries"))
        ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("carries").alias("carries"))
        if parts == 1 or ends.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("carries") > 0))).isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
