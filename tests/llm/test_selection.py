"""Importance resampling, hard negatives and the Jaccard join against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import hard_negatives, importance, jaccard_join
from test_queries import SF, run, table  # noqa: F401
from test_small import docs, empty  # noqa: F401

# --- importance resampling


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def resampled(rows, target, grams=1, buckets=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i:i + g]).encode()) % buckets for g in range(1, grams + 1) for i in range(len(w) - g + 1)]
    source = Counter(b for _, t in rows for b in features(t)[1])
    goal = Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(source.values()), sum(goal.values())
    out, able = [], []
    for d, t in rows:
        n, fs = features(t)
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in fs]
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None])
        if n >= least:
            able.append(out[-1])
    for i, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:len(able) * percent // 100]):
        r[4] = i + 1
    return out


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op11_query(spark, table):  # noqa: F811
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = run(spark, "op11_importance_resampling")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert by_repr(got.collect()) == by_repr(resampled([r[:2] for r in table], target))


@pytest.mark.parametrize("grams,percent", [(1, 60), (3, 100)])
def test_resampling(spark, docs, empty, grams, percent):  # noqa: F811
    target = spark.createDataFrame([("The quick brown fox and é",), (None,), ("漢字 jumps lazily over w7x1",)], "text string")
    goal = [r.text for r in target.collect()]
    got = importance.resample(docs, target, grams=grams, buckets=97, least_words=3, percent=percent).collect()
    want = resampled(docs.select("doc_id", "text").collect(), goal, grams, 97, 3, percent)
    # rows equal in score and id may swap their ranks
    key = lambda r: (r[0], r[3], r[4])
    assert sorted((tuple(r[:4]) for r in got), key=repr) == sorted((tuple(r[:4]) for r in want), key=repr)
    assert sorted(map(key, got), key=repr) == sorted(map(key, want), key=repr)
    assert importance.resample(empty, target).count() == 0
    assert {r.rank for r in importance.resample(docs, empty, percent=100).collect()} >= {1, 2}


def test_features_of_long_words_and_borders():
    texts = ["abc", "def" * 100, "", "x1-Y2_z", "ÀÉ" * 40 + " ab"]
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, n, words = importance.features(np.frombuffer("".join(texts).encode(), np.uint8), ends, 1, 1 << 32)
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    assert found.tolist() == [zlib.crc32(w.encode()) for ws in want for w in ws] and n.tolist() == words.tolist() == list(map(len, want))


@pytest.mark.parametrize("block_rows,bits", [(7, 3), (1000, 12)])
def test_radix_ranks(spark, block_rows, bits):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.randrange(-9, 9), 5, 5, 5]), rng.choice([None, -(1 << 63), (1 << 63) - 1, rng.randrange(300)])) for i in range(90)]
    got = importance.radix_ranks(spark.createDataFrame(rows, "row long, a long, b long").repartition(4), "row", ["a", "b"], block_rows, bits).collect()
    rank = {r.row: r["rank"] for r in got}
    order = sorted(rows, key=lambda r: rank[r[0]])
    place = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0)
    assert sorted(rank.values()) == list(range(1, 91)) and list(map(place, order)) == sorted(map(place, rows))


def test_radix_sort_spreads_a_hot_key(spark):
    rows = spark.range(30_000).selectExpr("id AS row", "IF(id % 3 = 0, 7, id % 50) AS a", "1L AS b")
    got = importance.radix_ranks(rows, "row", ["a", "b"], block_rows=2_000)
    assert got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (30_000, 1, 30_000)
    joined = rows.join(got, "row").selectExpr("a", "lag(a) OVER (ORDER BY rank) AS before")
    assert joined.where("before > a").isEmpty()


# --- hard negatives

def mined(rows, anchor, positives=5, negatives=5, lowest=80):
    """By the definition; rows (id, label, vector)."""
    good = [(i, y, [math.floor(256 * c) for c in x]) for i, y, x in rows if None not in (i, y, x) and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, y, x in {(a, b): (a, b, c) for a, b, c in sorted(good, reverse=True) if anchor(a)}.values():
        scored = sorted((-sum(p * q for p, q in zip(x, v)), j, z) for j, z, v in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            inside = [r for r in scored if r[2] != y and lowest * -s <= 100 * -r[0] <= 100 * -s]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(seed, n=400, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(1 if seed % 2 else 3)
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(c)) for c in x[i]]) for i in range(n)]
    rows[20:60] = [(i, 1, rows[0][2]) for i in range(20, 60)]  # a frequent vector
    return rows + [(None, 1, [1.0] * dim), (500, None, [1.0] * dim), (600, 1, None), (700, 1, [None] + [1.0] * (dim - 1)),
                   (800, 1, [float("nan")] * dim), (900, 1, [float("inf")] * dim), (1000, 9, [1.0] * dim), rows[7], rows[7], (1100, 2, [0.0] * dim), (-100, 2, [-1.0] * dim)]


@pytest.mark.parametrize("seed,tiles", [(1, None), (2, (40, 7)), (3, (1000, 3))])
def test_hard_negatives(spark, monkeypatch, seed, tiles):
    if tiles:
        monkeypatch.setattr(hard_negatives, "TILE_ROWS", tiles[0])
        monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", tiles[1])
        monkeypatch.setattr(hard_negatives, "TILE_CELLS", 500)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, label int, embedding array<float>, down int, across int, x string").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_stay_exact(spark):
    rows = [(i, i % 2, [float((i * 37 % 11) * 2**12 + i), float(2**13 - i)]) for i in range(60)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0)
    far = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="2\\^30|range of long"):
        hard_negatives.hard_negatives(far, F.col("vec_id") == 0).collect()
    uneven = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        hard_negatives.hard_negatives(uneven, F.col("vec_id") == 0)


# --- Jaccard join

def linked(rows, gram=4, least=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= least * max(len(a), len(b)) and 100 * len(a & b) >= least * len(a | b):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("gram,least", [(4, 85), (5, 80), (3, 50)])
@pytest.mark.parametrize("tile", [jaccard_join.TILE_ELEMENTS, 3_000])
def test_jaccard_join(spark, gram, least, tile):
    rng = random.Random(gram * least)
    texts = [t for words in (5, 8, 12, 20, 40, 90, 200, 400) for t in edited(rng, 30, words, max(1, words // 12))]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"w{rng.randrange(9**5)}" for _ in range(rng.randrange(1, 80))) + " " + passage for _ in range(60)]
    texts += [" ".join(["a", "b"][rng.randrange(2)] for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts += [t.upper().replace(" ", "\n") for t in texts[:40]] + ["", None, " \t", "ÀB", "àb"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), gram=gram, least=least, tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(linked(rows, gram, least))


def test_jaccard_join_of_awkward_rows(spark, docs, empty):  # noqa: F811
    got = jaccard_join.link_documents(docs)
    assert by_repr(got.collect()) == by_repr(linked(docs.select("doc_id", "text").collect()))
    assert jaccard_join.link_documents(empty).count() == 0
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_linked_sets_share_a_segment():
    """Pairs at the very limit of the threshold, of all sizes."""
    rng = np.random.default_rng(8)
    for least in (50, 80, 85, 95):
        bands = jaccard_join.Bands(least, 6_000)
        sets = []
        for n in [*range(1, 60), *rng.integers(60, 2_500, 40).tolist()]:
            a = rng.integers(0, 2**64, n, np.uint64)
            most = n * (100 - least) // least  # differing elements a linked pair may have
            less = int(rng.integers(0, most + 1))
            less = min(less, n - 1, (n * 100 - least * n) // 100)
            more = 0
            while 100 * (n - less) >= least * (n + more + 1):
                more += 1
            sets += [np.sort(a), np.sort(np.concatenate([a[less:], rng.integers(0, 2**64, more, np.uint64)]))]
        ends = np.cumsum([0, *map(len, sets)])
        which, keys = jaccard_join.segment_keys(np.concatenate(sets), ends, bands)
        of = [set(keys[which == i].tolist()) for i in range(len(sets))]
        for i in range(0, len(sets), 2):
            assert of[i] & of[i + 1], (least, len(sets[i]), len(sets[i + 1]))


def test_op13_query(spark, table):  # noqa: F811
    got = run(spark, "op13_ngram_jaccard_join").collect()
    assert sorted(map(tuple, got)) == sorted(linked([r[:2] for r in table]))
