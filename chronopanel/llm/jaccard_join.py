"""Jaccard self-join of word n-gram sets: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. One Arrow pass makes the sorted 64-bit hashes of every text's distinct n-grams. Sets are sorted into bands by
   size such that linked sets lie in one band or in neighbouring ones.
2. Two sets of a band pair differ in at most d elements if they link, so with the hash range cut into d + z
   segments at least z segments hold the same elements in both. Sets that share a segment become candidates. They
   are gathered into candidate groups: only one set for each segment leaves a chunk of texts, the others are tied to
   it there, so a segment that a third of all rows share is one row a chunk.
3. The sets of a group meet in tiles: a small group in one, a large one in tiles of two blocks of neighbouring
   bands. In a tile the sets go by size; a set is compared with the larger ones up to the size limit that are not in
   its class yet. The bits set in one signature only bound the overlap from above; pairs that pass are intersected
   exactly. A tile hands on a spanning forest of the links it found, never the pairs of a group.
4. Components of these links give the classes.

Every bound is exact: no link is lost, and no set, segment or group is capped. An n-gram is named by 64 bits of a
hash, and so is a set.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components, star_links
from ..shared import BROADCAST_ROWS, stage
from .common import chunks, give_back, ragged, utf8

GRAM, LEAST = 4, 85
#: segment keys of a bucket, and elements of the sets of a tile
BUCKET_KEYS, TILE_ELEMENTS = 300_000, 2_000_000
#: cells of a signature matrix built at once, and bytes of text hashed at once
CELLS, TEXT_BYTES = 1 << 25, 1_500_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd numbers of 64 bits."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def gram_sets(data: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of texts end to end (bytes, n + 1 offsets): all sets sorted, text by text, and
    their n + 1 offsets. A text with fewer words than ``gram`` has its whole sequence as its only n-gram."""
    n = len(ends) - 1
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    if not len(begins):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    stops = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    size = stops - begins
    # a word's hash: sum over its bytes of a number of the byte times a power of its place
    at = ragged(np.zeros(len(size), np.int64), size)
    power = np.ones(int(size.max()), _U)
    power[1:] = _U(0x9E3779B97F4A7C15)
    power = np.cumprod(power)
    values = _numbers(256, 1)[_LOWER[data[word]]] * power[at]
    words = mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(_U))
    doc = np.searchsorted(ends, begins, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    last = np.cumsum(n_words)[doc]
    i = np.arange(len(words))
    first = np.flatnonzero((i + gram <= last) | ((i + n_words[doc] == last) & (n_words[doc] < gram)))
    total = np.zeros(len(first), _U)
    for k, factor in enumerate(_numbers(gram, 2)):
        inside = first + k < last[first]
        total += np.where(inside, words[np.minimum(first + k, len(words) - 1)] * factor, _U(k + 1))
    h, of = mix(total), doc[first]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
    h, of = h[new], of[new]
    return h, np.append(0, np.cumsum(np.bincount(of, minlength=n)))


def set_names(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits naming each set; 0 for an empty one."""
    upto = np.append(_U(0), np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D))))
    n = ends[1:] - ends[:-1]
    return np.where(n > 0, mix(upto[ends[1:]] - upto[ends[:-1]] + n.astype(_U)), _U(0))


class Bands:
    """Bands of set sizes: linked sets lie in one band or in two neighbouring ones. Segments are cut such that sets
    of similarity ``sure`` or more always share one; with ``sure`` above ``least`` the others share one unless the
    elements in which they differ hit, by the chance of their hashes, every segment that says enough."""

    def __init__(self, least: int, largest: int, sure: int | None = None):
        self.least = least
        top = [0, 1]
        while top[-1] < largest:
            top.append(max(top[-1] * 100 // least, top[-1] + 1))
        self.top = np.array(top)
        self.parts, self.spare, self.light = (np.array(x) for x in zip(*(self._cut(sure or least, t) for t in top)))

    @staticmethod
    def _cut(least: int, top: int) -> tuple[int, int, int]:
        """Segments of a band, how many of them at least agree in linked sets, and the size up to which a segment
        says little. Such light segments are left out where others must agree as well."""
        differ = top * (100 - least) // least
        if not differ:
            return 1, 1, 0
        for light in (1, 0):
            spare = 1
            for _ in range(50):
                mean = top / (differ + spare)
                share = (differ + spare) * math.exp(-mean) * (1 + light * mean)
                want = 1 + math.ceil(share + 3 * math.sqrt(share))
                if want <= spare or want > differ:
                    break
                spare = want
            if want <= spare and spare <= 2 + differ // 5 or not light:
                break
        return differ + spare, spare, light

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, sizes, "left")


def segment_keys(h: np.ndarray, ends: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the segments of every set, in its own band and as a larger set in the band below. Of any two
    linked sets one key is the same."""
    sizes = ends[1:] - ends[:-1]
    band, which, keys = bands.of(sizes), [], []
    for down in (0, 1):
        b = band - down
        some = np.flatnonzero((sizes > 0) & (b > 0))
        if down:  # the largest partner of the band below
            some = some[sizes[some] * bands.least <= bands.top[b[some]] * 100]
        if not len(some):
            continue
        b, n = b[some], sizes[some]
        of = np.repeat(np.arange(len(some)), n)
        x = h[ragged(ends[some], n)]
        parts = bands.parts[b]
        segment = ((x >> _U(32)) * parts[of].astype(_U) >> _U(32)).astype(np.int64)
        new = np.append(True, (of[1:] != of[:-1]) | (segment[1:] != segment[:-1]))
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(x)))
        owner, place = of[at], segment[at]
        content = np.add.reduceat(mix(x), at)
        spare, light = bands.spare[b], bands.light[b]
        heavy = np.bincount(owner[count > light[owner]], minlength=len(some))
        filled = np.bincount(owner, minlength=len(some))
        small_too = parts - heavy >= spare  # light segments alone may be all that agrees
        none_too = parts - filled >= spare  # and so may empty ones
        keep = (count > light[owner]) | small_too[owner]
        owner, place, content = owner[keep], place[keep], content[keep]
        hollow = np.flatnonzero(none_too)
        if len(hollow):
            every = np.repeat(hollow, parts[hollow]), ragged(np.zeros(len(hollow), np.int64), parts[hollow])
            width = int(parts.max()) + 1
            free = ~np.isin(every[0] * width + every[1], of[at] * width + segment[at])
            owner, place = np.append(owner, every[0][free]), np.append(place, every[1][free])
            content = np.append(content, np.zeros(int(free.sum()), _U))
        keys.append(mix(content ^ mix(b[owner].astype(_U) << _U(32) | place.astype(_U))))
        which.append(some[owner])
    return (np.concatenate(which), np.concatenate(keys)) if keys else (np.zeros(0, np.int64), np.zeros(0, _U))


def _runs(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets that share a key, as links of each run's least set with the others; the places of the runs' firsts."""
    order = np.lexsort((sets, keys))
    k, s = keys[order], sets[order]
    first = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    head = s[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    tied = s != head
    return s[tied], head[tied], order[first]


def linked(h: np.ndarray, ends: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of sets within each group, as (place, place)."""
    sizes = ends[1:] - ends[:-1]
    order = np.lexsort((sizes, group))
    edge = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    out = []
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        mine = order[a:b]
        if len(mine) > 1:
            out += _tile_links(h, ends, mine, sizes[mine], least)
    u, v = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return u, v


def _signatures(h: np.ndarray, ends: np.ndarray, mine: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bitmaps of the sets: bit (hash mod width) is set for each element."""
    width = 1 << min(14, max(6, int(2 * np.median(sizes)).bit_length()))
    rows = max(1, CELLS // width)
    out = []
    for i in range(0, len(mine), rows):
        some, n = mine[i:i + rows], sizes[i:i + rows]
        bits = np.zeros((len(some), width), bool)
        bits[np.repeat(np.arange(len(some)), n), (h[ragged(ends[some], n)] & _U(width - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, axis=1).view(_U))
    return np.concatenate(out)


def _tile_links(h: np.ndarray, ends: np.ndarray, mine: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links among the sets ``mine``, ascending in size, that join their classes."""
    found = []
    label = np.arange(len(mine))
    maps = _signatures(h, ends, mine, sizes) if len(mine) > 2 else None
    reach = np.searchsorted(sizes, sizes * 100 // least, "right")
    for i in range(len(mine) - 1):
        other = np.arange(i + 1, reach[i])
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        both = sizes[i] + sizes[other]
        if maps is not None:
            a, b = maps[i], maps[other]
            overlap = np.minimum(sizes[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), sizes[other] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
            able = overlap * (100 + least) >= least * both
            other, both = other[able], both[able]
            if not len(other):
                continue
        own = h[ends[mine[i]]:ends[mine[i] + 1]]
        x = h[ragged(ends[mine[other]], sizes[other])]
        hit = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
        overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
        for j in other[overlap * (100 + least) >= least * both].tolist():
            if label[j] != label[i]:
                found.append((mine[i], mine[j]))
                label[label == label[j]] = label[i]
    return found


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _sets(docs: DataFrame, doc_id: str, text: str, gram: int, least: int, sure: int) -> DataFrame:
    """Rows of three kinds: a row of ``docs`` (doc_id, text_hash, n, name); a bucket's segment keys and the names of
    their sets; candidate links found inside a chunk (bucket -1)."""
    longest, size = docs.agg(F.max(F.octet_length(_text(text))), F.sum(F.octet_length(_text(text)))).first()
    bands = Bands(least, (longest or 0) // 2 + 1, sure)
    # about a third of a key for each element and an element for each six bytes
    buckets = max(1, round((size or 0) / 6 * 0.4 * (100 - sure) / 15 / BUCKET_KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            h, ends = gram_sets(*utf8(batch.column("text")), gram)
            names, n = set_names(h, ends), ends[1:] - ends[:-1]
            _, one = np.unique(names, return_index=True)  # copies in the chunk count once
            some_h, some_n = h[ragged(ends[one], n[one])], n[one]
            which, keys = segment_keys(some_h, np.append(0, np.cumsum(some_n)), bands)
            owner = names[one][which]
            u, v, first = _runs(keys, owner)
            u, v = star_links(u.view(np.int64), v.view(np.int64)) if len(u) else (np.zeros(0, np.int64),) * 2
            keys, owner = keys[first], owner[first]
            bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)  # keys ascend, and so do buckets
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
            stop = np.append(cut[1:], len(keys))
            # within a bucket 32 bits name a key: the few that share them by chance only make a group larger
            low = keys.astype(np.uint32)
            blobs = [(-1, u.tobytes(), v.tobytes())] + [(int(bucket[a]), low[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(cut, stop)]
            k, rows = len(blobs), batch.num_rows
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column("doc_id"), none]), pa.concat_arrays([batch.column("text_hash"), none]),
                pa.concat_arrays([pa.array(n.astype(np.int64)), none]), pa.concat_arrays([pa.array(names.view(np.int64)), none]),
                pa.array([None] * rows + [b[0] for b in blobs], pa.int64()), pa.array([None] * rows + [b[1] for b in blobs], pa.binary()),
                pa.array([None] * rows + [b[2] for b in blobs], pa.binary())], names=["doc_id", "text_hash", "n", "name", "bucket", "keys", "sets"])
        give_back()

    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(_text(text)).alias("text_hash"), _text(text).alias("text"))
    return t.mapInArrow(run, "doc_id long, text_hash long, n long, name long, bucket long, keys binary, sets binary")


def _candidates(parts: DataFrame) -> DataFrame:
    """Links (u, v) that tie the sets of each candidate group together."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(utf8(batch.column(c))[0].tobytes(), np.int64) for c in ("keys", "sets"))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def across(table: pa.Table) -> pa.Table:
        keys, sets = (np.frombuffer(utf8(table.column(c))[0].tobytes(), kind) for c, kind in (("keys", np.uint32), ("sets", _U)))
        u, v, _ = _runs(keys, sets)
        u, v = star_links(u.view(np.int64), v.view(np.int64)) if len(u) else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": u, "v": v})

    blobs = parts.select("bucket", "keys", "sets")
    found = blobs.where("bucket >= 0").groupBy("bucket").applyInArrow(across, "u long, v long")
    return found.union(blobs.where("bucket = -1").select("keys", "sets").mapInArrow(inside, "u long, v long"))


def _tiles(members: DataFrame, bands: Bands, tile: int) -> DataFrame:
    """The tiles of each set (name, group, n ...): a group of up to ``tile`` elements is one tile, a larger one is
    cut into blocks of each band that meet pairwise within the band and with those of the next band."""
    total = members.groupBy("group").agg(F.sum("n").alias("elements"))
    large = stage(total.where(F.col("elements") > tile), "large")
    sized = members.join(large, "group", "left")
    if large.isEmpty():
        return sized.drop("elements").withColumn("tile", F.xxhash64("group"))
    tops = bands.top.tolist()  # a few hundred numbers
    band = F.size(F.filter(F.lit(tops), lambda t: t < F.col("n")))
    split = stage(sized.where(F.col("elements").isNotNull()).withColumn("band", band), "split")
    blocks = split.groupBy("group", "band").agg(F.ceil(F.sum("n") / (tile / 2)).cast("int").alias("blocks"))
    near = split
    for d, c in ((0, "here"), (1, "above"), (-1, "below")):
        near = near.join(blocks.select("group", (F.col("band") - d).alias("band"), F.col("blocks").alias(c)), ["group", "band"], "left")
    block = F.pmod(F.xxhash64("name"), F.col("here")).cast("int")

    def with_(count, lower, upper):
        return F.when(F.col(count).isNull(), F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda j: F.xxhash64("group", lower(j)[0], lower(j)[1], upper(j)[0], upper(j)[1])))
    own = F.col("band"), block
    tiles = F.concat(with_("here", lambda j: (own[0], F.least(own[1], j)), lambda j: (own[0], F.greatest(own[1], j))),
                     with_("above", lambda j: own, lambda j: (own[0] + 1, j)), with_("below", lambda j: (own[0] - 1, j), lambda j: own))
    spread = near.withColumn("tile", F.explode(tiles)).select("name", "n", "doc_id", "text_hash", "group", "tile")
    small = sized.where(F.col("elements").isNull()).select("name", "n", "doc_id", "text_hash", "group", F.xxhash64("group").alias("tile"))
    return small.union(spread)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, least: int = LEAST, tile: int = TILE_ELEMENTS,
            sure: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n, name of its set), and (name, root, component_id) of every nonempty set. ``sure``:
    the similarity from which candidates are certain (see ``Bands``), ``least`` if it is not given."""
    parts = stage(_sets(docs, doc_id, text, gram, least, sure or least), "sets")
    rows = parts.where("bucket IS NULL").select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("name")).alias("name"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = stage(rows.where("name IS NOT NULL").groupBy("name").agg(first, F.min("n").alias("n")), "distinct")
    groups = components(_candidates(parts), "u", "v")
    groups = stage(groups.select(F.col("node").alias("name"), F.col("root").alias("group")).union(groups.select("root", "root").distinct()), "groups")
    members = stage(sets.join(groups, "name").select("name", "group", "n", "first.doc_id", "first.text_hash"), "members")
    largest = members.agg(F.max("n"), F.sum("n")).first()
    bands = Bands(least, largest[0] or 0)
    tiles = _tiles(members, bands, tile)
    tasks = max(1, round((largest[1] or 0) / (tile / 4)))

    def join(table: pa.Table) -> pa.Table:
        name, where = table.column("name").to_numpy(), table.column("tile").to_numpy()
        _, one = np.unique(np.stack([where, name]), axis=1, return_index=True)  # a repeated row counts once
        texts = pa.RecordBatch.from_arrays([table.column("text").take(pa.array(one)).combine_chunks()], names=["text"])
        parts = [gram_sets(*utf8(part.column("text")), gram) for part in chunks([texts], "text", TEXT_BYTES)]
        del texts
        give_back()
        h, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts])
        ends = np.append(0, np.cumsum(sizes))
        _, group = np.unique(where[one], return_inverse=True)
        u, v = linked(h, ends, group, least)
        return pa.table({"u": name[one][u], "v": name[one][v]})

    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(_text(text)).alias("__hash"), _text(text).alias("text"))
    if members.count() <= BROADCAST_ROWS and (placed := stage(tiles, "tiles")).count() <= BROADCAST_ROWS:
        tiles = F.broadcast(placed)  # few sets have a candidate: the texts need not be exchanged to find theirs
    met = texts.join(tiles, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash")))
    met = met.select("name", "tile", "text", F.pmod("tile", F.lit(tasks)).alias("task"))
    found = components(met.groupBy("task").applyInArrow(join, "u long, v long"), "u", "v")
    member = sets.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    roots = member.groupBy("root").agg(F.min("first").alias("first"))
    return rows, member.select("name", "root").join(roots, "root").select("name", "root", F.col("first.doc_id").alias("component_id"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, least: int = LEAST, tile: int = TILE_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: the smallest id reachable over links of n-gram
    sets whose intersection is at least ``least`` hundredths of their union.

    Null, empty and wordless texts have an empty set and are linked with nothing; equal sets link; a null id is
    never smallest, and a component of null ids alone has a null component_id; repeated rows are in one component;
    an empty table stays empty. Extra columns are not read."""
    rows, named = classes(docs, doc_id, text, gram, least, tile)
    out = rows.join(named.select("name", "component_id"), "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
