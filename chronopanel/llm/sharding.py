"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows lie in P hashed partitions of known sizes. How many rows of partition p go to cell c (a cell is
a run of slots of one shard, its size known in advance) is drawn exactly: the matrix rows are multivariate
hypergeometric given what the cells still lack. Each partition is then put in random order and cut by its
matrix row (permute locally, exchange), and each cell is put in random order again, which gives the slots.
Every assignment with the exact shard sizes is equally likely.

Only the counts of the partitions pass through the driver (at most ``MAX_PARTS`` numbers); the rows take
two hash exchanges, by partition and by cell, both of bounded groups.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import names

#: rows of a partition or a cell, until there are MAX_PARTS of them
ROWS = 20_000
#: size of the plan (not of the data): partitions, and cells, of which the matrix is made
MAX_PARTS = 2_048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken without replacement; by inversion from the mode outwards,
    which takes about a standard deviation of steps at any population."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p = math.exp(lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)
                 - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1))
    u = rng.random() - p
    if u <= 0:
        return mode
    up = down = mode
    pu = pd = p
    while True:
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
        if (up >= high or pu < 1e-18) and (down <= low or pd < 1e-18):  # what rounding left over
            return mode


def communication_matrix(sizes: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Exact draw of the matrix with row sums ``sizes`` and column sums ``cells`` (of equal totals)."""
    rng, left, out = random.Random(seed), list(cells), []
    for size in sizes:
        row, rest, need = [], sum(left), size
        for c, have in enumerate(left):
            k = hypergeometric(rng, have, rest - have, need) if need else 0
            row.append(k)
            rest -= have
            need -= k
            left[c] -= k
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, key: list[str], shards: int = 24, seed: int = 20_240_601, rows: int = ROWS) -> DataFrame:
    """All columns of ``df``, with shard (0 to ``shards`` - 1) and slot (gapless from 0 in its shard).
    Shard sizes differ by one row at most. The result depends on the columns ``key``, ``seed`` and the
    number of rows only, not on how the table lies in files.

    Nulls in ``key`` are values like others; rows equal in all of ``key`` are in arbitrary order among
    themselves and get slots of their own; an empty table gives an empty one; columns of ``df`` named
    shard or slot are replaced."""
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    n = df.count()
    spark = df.sparkSession
    parts = max(1, min(MAX_PARTS, math.ceil(n / rows)))
    per_shard = [n // shards + (j < n % shards) for j in range(shards)]
    cuts = max(1, min(MAX_PARTS // shards, math.ceil(n / shards / rows)))
    cells = [(j, q, size // cuts + (q < size % cuts)) for j, size in enumerate(per_shard) for q in range(cuts)]
    first = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int")
    sizes = {r["__part"]: r["count"] for r in df.select(first.alias("__part")).groupBy("__part").count().collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], [c[2] for c in cells], seed)
    ends = []
    for p, row in enumerate(matrix):
        total, upto = 0, []
        for k in row:
            total += k
            upto.append(total)
        ends.append((p, upto))
    plan = spark.createDataFrame(ends, T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))]))
    offsets, place = {}, []
    for j, q, size in cells:
        place.append((len(place), j, offsets.get(j, 0)))
        offsets[j] = offsets.get(j, 0) + size
    where = spark.createDataFrame(place, "__cell int, shard int, __offset long")
    order = lambda salt: [F.xxhash64(F.lit(seed + salt), *key), *[F.col(k) for k in key]]
    local = df.withColumn("__part", first).withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*order(1))))
    dealt = local.join(plan, "__part").withColumn("__cell", F.size(F.filter("__ends", lambda e: e < F.col("__i")))).drop("__ends", "__part", "__i")
    again = Window.partitionBy("__cell").orderBy(*order(2))
    out = dealt.withColumn("__slot", F.row_number().over(again)).join(where, "__cell")
    return out.select(*names(df), "shard", (F.col("__offset") + F.col("__slot") - 1).alias("slot"))
