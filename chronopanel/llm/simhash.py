"""Near-duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints come from one Arrow pass. Distinct ones are joined with themselves in the trie of their bits:
pairs of nodes are traversed together, a pair that branches to different sides adds one differing bit, and
a pair is dropped when its differing bits exceed the budget.

To deal the traversal to tasks, five tries are laid over five rotations of the bits: of at most four
differing bits, one of five blocks of bits holds none, so in the rotation that has this block first the two
fingerprints share the node below it. A task traverses the subtrees of many such nodes at once (numpy arrays
of node pairs, level by level). A node with very many fingerprints is cut into hashed parts that meet
pairwise. A task emits a spanning forest of the links it finds, never all pairs of a group; components are
then found by Spark joins on those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components, merged_labels
from ..shared import BROADCAST_ROWS, stage
from . import jaccard_join
from .common import chunks

BITS, BUDGET, SHINGLE = 64, 4, 4
#: words of a shingle, hundredths of Jaccard similarity from which texts are one group, and from which the search
#: for candidates is certain
GROUP_SHINGLE, GROUP_LEAST, GROUP_SURE = 5, 80, 85
#: fingerprints a task traverses together
TASK_ROWS = 150_000
#: a node with more fingerprints is cut into parts
NODE_ROWS = 20_000
#: node pairs on one level of a traversal handled at once
FRONTIER = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' 64-bit hashes; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    first, last = start[:n].tolist(), stop[len(words) - n:].tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(first, last)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[i:i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and ``fp`` (a signed long with the fingerprint's bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            fp = np.array([fingerprint(t.as_py().encode("utf-8"), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """Bit blocks (from, width) of which one is free of differences within the budget."""
    n = budget + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def traverse(trie: np.ndarray, node: np.ndarray, skip: int, budget: int) -> np.ndarray:
    """Class labels of sorted rows (node, trie) where rows of one node link if their ``trie`` bits differ in
    at most ``budget`` places. The first ``skip`` bits are equal within a node.

    The budget is raised step by step: pairs of subtrees that lie in one class already are not traversed
    again, so a dense group costs its links, not its pairs."""
    n = len(trie)
    label = np.arange(n)
    bits = [((trie >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int8) for d in range(skip, BITS)]
    ones = [np.append(0, np.cumsum(b, dtype=np.int32)) for b in bits]
    edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    roots = np.stack([edge, np.append(edge[1:], n)])
    for most in range(1, budget + 1):
        changes = np.append(0, np.cumsum(label[1:] != label[:-1]))
        a0, a1 = roots
        keep = a1 - a0 > 1
        stack = [(0, a0[keep], a1[keep], a0[keep], a1[keep], np.zeros(int(keep.sum()), np.int8))]
        while stack:
            depth, a0, a1, b0, b1, used = stack.pop()
            if len(a0) > FRONTIER:
                for i in range(0, len(a0), FRONTIER):
                    s = slice(i, i + FRONTIER)
                    stack.append((depth, a0[s], a1[s], b0[s], b1[s], used[s]))
                continue
            # one class already: both subtrees uniform, and alike
            done = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (label[a0] == label[b0])
            single = (a1 - a0 == 1) & (b1 - b0 == 1) & ~done
            if single.any():
                x, y = a0[single], b0[single]
                near = np.bitwise_count(trie[x] ^ trie[y]) <= most
                if near.any():
                    label = merged_labels(label, x[near], y[near])
                    changes = np.append(0, np.cumsum(label[1:] != label[:-1]))
            rest = ~(done | single)
            if not rest.any():
                continue
            a0, a1, b0, b1, used = a0[rest], a1[rest], b0[rest], b1[rest], used[rest]
            if depth == len(ones):
                continue
            one = ones[depth]
            am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
            self_ = a0 == b0
            parts = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1), (am[~self_], a1[~self_], b0[~self_], bm[~self_], used[~self_] + 1)]
            u0, u1, v0, v1, w = (np.concatenate(x) for x in zip(*parts))
            ok = (u1 > u0) & (v1 > v0) & (w <= most) & ~((u0 == v0) & (u1 - u0 == 1))
            if ok.any():
                stack.append((depth + 1, u0[ok], u1[ok], v0[ok], v1[ok], w[ok].astype(np.int8)))
    return label


def dealt(distinct: DataFrame, budget: int = BUDGET, task_rows: int = TASK_ROWS, node_rows: int = NODE_ROWS) -> DataFrame:
    """The nodes (turn, block, pair) of each ``fp`` and the task of each node; a task has about ``task_rows``
    rows, the parts of crowded nodes included."""
    cut = blocks(budget)
    node_rows = min(node_rows, task_rows)
    n = distinct.count()
    rows = distinct.select("fp", F.posexplode(F.array(*[F.shiftrightunsigned("fp", BITS - a - w).bitwiseAND((1 << w) - 1) for a, w in cut])).alias("turn", "block"))
    crowded = rows.groupBy("turn", "block").count().where(F.col("count") > node_rows)
    crowded = stage(crowded.select("turn", "block", "count", F.ceil(F.col("count") / (node_rows / 2)).cast("int").alias("parts")), "nodes")
    more = crowded.agg(F.sum(F.col("count") * (F.col("parts") - 1)).alias("n")).first()["n"] or 0
    tasks = max(1, round((n * len(cut) + more) / task_rows))
    if not more:
        out = rows.withColumn("pair", F.lit(0))
    else:
        # every two of a crowded node's parts meet in one task
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(q, F.col("part")) * 65_536 + F.greatest(q, F.col("part")))
        out = rows.join(crowded.drop("count"), ["turn", "block"], "left").withColumn("part", part)
        out = out.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others))).drop("parts", "part")
    return out.withColumn("task", F.pmod(F.xxhash64("turn", "block", "pair"), F.lit(tasks)))


def links(distinct: DataFrame, budget: int = BUDGET, task_rows: int = TASK_ROWS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of ``fp`` within ``budget`` bits. ``distinct`` holds
    each fingerprint once and is read twice: stage it."""
    cut = blocks(budget)

    def join(table: pa.Table) -> pa.Table:
        fp, turn, block, pair = (table.column(c).to_numpy() for c in ("fp", "turn", "block", "pair"))
        fp = fp.view(np.uint64)
        _, node = np.unique(np.stack([turn.astype(np.int64) << 32 | block, pair.astype(np.int64)]), axis=1, return_inverse=True)
        node = node.reshape(-1)
        out = []
        for t in np.unique(turn).tolist():
            a, w = cut[t]
            mine = np.flatnonzero(turn == t)
            bits = fp[mine] << np.uint64(a) | (fp[mine] >> np.uint64(BITS - a) if a else np.uint64(0))
            order = np.lexsort((bits, node[mine]))
            label = traverse(bits[order], node[mine][order], w, budget)
            tied = np.flatnonzero(label != np.arange(len(label)))
            own = fp[mine][order]
            out.append(np.stack([own[tied], own[label[tied]]]))
        a, b = np.concatenate(out, axis=1).view(np.int64)
        return pa.table({"a": a, "b": b})

    return dealt(distinct, budget, task_rows, node_rows).groupBy("task").applyInArrow(join, "a long, b long")


def _classes(docs: DataFrame, doc_id: str, text: str, budget: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of the rows; the root of each distinct fingerprint; the first row of each root."""
    prints = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = stage(prints.groupBy("fp").agg(first), "classes")
    found = components(links(classes.select("fp"), budget))
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return prints, member.select("fp", "root"), member.groupBy("root").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest id
    reachable over links of at most ``budget`` differing bits).

    Null and wordless texts have fingerprint zero and link like any other; a shorter text than a shingle is
    one shingle; a null id is never smallest, and a component of null ids alone has a null component_id;
    repeated rows are in one component; an empty table stays empty."""
    prints, member, roots = _classes(docs, doc_id, text, budget, shingle)
    ids = member.join(roots, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    out = prints.join(ids, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _keep(docs: DataFrame, roots: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are the first row of a root (struct ``first``); ``rows`` (doc_id, text_hash) are all
    rows. What goes is broadcast if it is counted to be little; otherwise the texts are exchanged once."""
    hashed = ["doc_id", "text_hash"]
    keys = stage(rows.groupBy(*hashed).agg(F.count("*").alias("times")), "keys")
    first = stage(roots.select("first.doc_id", "first.text_hash"), "first")
    gone = stage(keys.alias("k").join(first.alias("f"), F.expr("k.doc_id <=> f.doc_id AND k.text_hash = f.text_hash"), "left_anti").select(*hashed), "gone")
    few = gone.count() <= BROADCAST_ROWS
    other = (F.broadcast(gone) if few else first).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    kept = keyed.join(other, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left_anti" if few else "left_semi")
    if not keys.where("times > 1").isEmpty():  # texts are shuffled for this only where rows repeat
        kept = kept.dropDuplicates([doc_id, "__key"])
    return kept.drop("__key")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest id (null last), then the
    smallest hash of its text; of rows equal in both, one."""
    prints, _, roots = _classes(docs.select(doc_id, text), doc_id, text, budget, shingle)
    return _keep(docs, roots, prints, doc_id, text)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = GROUP_SHINGLE, least: int = GROUP_LEAST) -> DataFrame:
    """As ``one_per_component``, with groups that also take in what the bits miss: two texts are linked if their
    fingerprints differ in at most ``budget`` bits or the Jaccard similarity of their shingle sets is at least
    ``least`` hundredths. The trie cannot carry the budget that such a similarity needs (14 of 64 bits), so the
    second kind of links comes from the join of shingle sets; the groups are the components of both. Candidates of
    that join are certain from ``GROUP_SURE`` hundredths on; below, by the chance of
    the hashes (none of 2,000 pairs of similarity 0.8 was missed at each of 46, 100, 146, 320 and 600 shingles).

    Texts without a word are copies of each other; a null id comes last; of repeated rows one stays; an empty
    table stays empty; extra columns are kept as they are."""
    narrow = docs.select(doc_id, text)
    prints, member, _ = _classes(narrow, doc_id, text, budget, shingle)
    rows, sets = jaccard_join.classes(narrow, doc_id, text, shingle, least, sure=max(least, GROUP_SURE))
    # texts without a word have no set: all of them are the set 0
    rows = stage(rows.withColumn("name", F.coalesce("name", F.lit(0).cast("long"))), "rows")
    pairs = prints.select("text_hash", "fp").distinct().join(rows.select("text_hash", "name").distinct(), "text_hash")
    pairs = stage(pairs.join(member, "fp").select("root", "name").distinct(), "pairs")
    head = pairs.groupBy("root").agg(F.min("name").alias("head"))
    bits = pairs.join(head, "root").where("name <> head").select(F.col("name").alias("a"), F.col("head").alias("b"))
    alike = sets.where("name <> root").select(F.col("name").alias("a"), F.col("root").alias("b"))
    found = components(bits.union(alike)).withColumnRenamed("node", "name").withColumnRenamed("root", "group")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    firsts = rows.groupBy("name").agg(first).join(found, "name", "left").groupBy(F.coalesce("group", "name")).agg(F.min("first").alias("first"))
    return _keep(docs, firsts, rows, doc_id, text)
