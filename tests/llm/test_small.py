"""Operators against brute force on a small table with every awkward row, and on an empty one."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronopanel.llm import byte_bpe, fingerprint, host_quality, language_id, packing, sharding, simhash, substring_dedup, suffix_dedup, superwindows, url_filter

import __spark_entry__  # noqa: F401  functions travel by value

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, spans string, h string, quality string, dedup string, block int"
PASSAGE = " ".join(f"w{i * 7 % 61}x{i}" for i in range(60))


def rows():
    long = " ".join(f"v{i * i % 997}" for i in range(30_000))
    texts = [
        "The quick brown fox jumps over the lazy dog. " * 3, "", None, "\n\t  \x0b", "é", "a", "x" * 5_000, "ab" * 3_000, long, long + " tail",
        PASSAGE, "before " + PASSAGE + " after", PASSAGE.replace(" ", "\n"), "one two three four", "one two three four five", PASSAGE, PASSAGE,
        "\x00nul " * 60, "Straße Σίσυφος ΣΑΣ 漢字 😀 " * 30, "a b " * 200, "#*$%&|<> " * 30, "line\nline\nline\n" * 20,
    ]
    out = [(i, t, ["en", "de", None][i % 3], "hot" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, "a text without an id, long enough to be a document of some words", "en", "s", 1), out[10], out[10], (3, "other text, same id", "fr", "s", 2)]
    return [r + (7, "x", "y", "z", "q", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def ordered(docs, hashed=F.xxhash64):
    """Rows with their id and text hash, as the operators order them."""
    r = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), hashed(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return sorted(r, key=lambda x: (-(1 << 63) if x.doc_id is None else x.doc_id, x.h))


def tally(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# --- urls

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?a", "http://example.net", "http://example.net/en", "ftp://a.net/en/", "x://example.com/de/", "x://example.com/dex",
        "x://notexample.com/de/", "x://fr.org/fr/a/b", "x://org/fr/", "x://a.b.c.d.org/fr/#q", "x://net?/", "x://net/", "x://com.net#a", "a://b://net/", "x://É.NET/", "x://.net/", "x://net./"]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("com/d", "block"), ("b.com/", "allow"), ("b.com/", "block"), (None, "block"), ("/x", "block"), ("dot.org", "block")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        if rule is None or rule.startswith("/"):
            continue
        h, p = (rule[:rule.index("/")], rule[rule.index("/"):]) if "/" in rule else (rule, "")
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = URLS + [f"x://{h}/{p}" for h in ("b.com", "a.b.com", "dot.org", "x.dot.org") for p in ("", "d", "de/", "z")] + ["x://net/"] * 50
    pages = spark.createDataFrame([(i % 30 or None, u, "r", "h", "p") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string, path string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string"))
    assert tally(got, ["page_id", "host", "path", "rule", "verdict"]) == sorted([(i % 30 or None, *judged(u, RULES)) for i, u in enumerate(urls)], key=repr)
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


# --- quality

def test_quality_measures(docs, empty):
    got = host_quality.judge_documents(docs)
    assert got.columns == [c for c in docs.columns if c != "quality"] + ["quality"]
    want = []
    for r in docs.collect():
        t, w = r.text or "", words(r.text)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 3_000 else set()
        want.append((r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = got.select("doc_id", "quality.*").where("n_words < 3000")
    assert tally(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]) == sorted([w for w in want if w[1] < 3_000], key=repr)
    assert host_quality.judge_documents(empty).count() == 0


def test_bad_host_rejects_its_documents(spark):
    good, bad = " ".join(f"g{i}" for i in range(80)), "short"
    data = [(f"h{i % 20}", good if i % 40 else bad) for i in range(400)] + [("spam", bad)] * 90 + [("spam", good)] * 5 + [(None, bad)] * 50 + [(None, good)] * 3
    got = host_quality.judge_documents(spark.createDataFrame(data, "source string, text string")).groupBy("source", "quality.base_failed", "quality.kept").count().collect()
    kept = {(r.source, r.base_failed): r.kept for r in got}
    assert kept[("spam", False)] is False and kept[("h0", True)] is False
    assert all(kept[(f"h{i}", False)] for i in range(20)) and kept[(None, False)]


# --- near-duplicates

def print_of(t, k=4):
    w = words((t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(values, near):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash(docs, empty):
    r = ordered(docs)
    prints = [print_of(x.text) for x in r]
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for x, c in zip(r, root):
        if x.doc_id is not None:
            least[c] = min(least.get(c, 1 << 62), x.doc_id)
    want = sorted([(x.doc_id, f"{p:016x}", least.get(c)) for x, p, c in zip(r, prints, root)], key=repr)
    assert tally(simhash.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"]) == want
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_component(empty).count() == 0


def group_of(t):
    """Fingerprint and set of five-word shingles."""
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return print_of(t, 5), {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    near = min(len(a[1]), len(b[1])) * 5 >= 4 * max(len(a[1]), len(b[1])) and 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1])
    return (a[0] ^ b[0]).bit_count() <= 4 or near


def test_one_per_group(docs, empty):
    r = ordered(docs)
    root = roots([group_of(x.text) for x in r], alike)
    first = {}
    for x, c in zip(r, root):
        key = (x.doc_id is None, x.doc_id or 0, x.h)
        first[c] = min(first.get(c, key), key)
    kept = simhash.one_per_group(docs)
    got = kept.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.h) for x in got) == sorted(first.values())
    assert kept.columns == docs.columns and simhash.one_per_group(empty).count() == 0


def test_groups_find_pairs_at_each_similarity(spark):
    """Recall of pairs of random texts with edited words, by their Jaccard similarity."""
    rng = np.random.default_rng(12)
    rows, band = [], {}
    for words in (150, 600):
        for edits in (0.005, 0.01, 0.02):
            for _ in range(60):
                base = [f"w{x}" for x in rng.integers(0, 5_000, words)]
                other = list(base)
                for k in rng.choice(words, max(1, int(words * edits)), replace=False):
                    other[k] = f"e{rng.integers(0, 10**9)}"
                a, b = (group_of(" ".join(x))[1] for x in (base, other))
                j = len(a & b) / len(a | b)
                if j >= 0.8:
                    band.setdefault(0.95 if j >= 0.95 else 0.9 if j >= 0.9 else 0.8, []).append(len(rows))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert min(map(len, band.values())) > 20 and set(band) == {0.8, 0.9, 0.95}
    for pairs in band.values():  # of each pair the smaller id stays, and the other goes
        assert all(i in kept and i + 1 not in kept for i in pairs)


@pytest.mark.parametrize("task_rows", [100_000, 40])
def test_trie_join_links_what_all_pairs_link(spark, task_rows):
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, 400)]
    for _ in range(3):
        base = base ^ (one << rng.integers(0, 64, 400, dtype=np.uint64))
    x = np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1, 15, 31], np.uint64)]))
    want = roots(x.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    links = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"), 4, task_rows).collect()
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    pairs = {tuple(sorted((at[r.a], at[r.b]))) for r in links}
    assert all((int(x[a]) ^ int(x[b])).bit_count() <= 64 for a, b in pairs)
    got = roots(list(range(len(x))), lambda a, b: tuple(sorted((a, b))) in pairs)
    assert got == want


def test_tasks_grow_with_the_parts_of_a_crowded_node(spark):
    x = np.random.default_rng(10).integers(0, 1 << 51, 4_000, dtype=np.int64)  # one node in the first turn
    rows = simhash.dealt(spark.createDataFrame([(int(v),) for v in np.unique(x)], "fp long"), 4, 400).groupBy("task").count().toPandas()["count"]
    assert rows.sum() > 90_000 and rows.mean() < 500


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(7, 8), (8, 7), (9, 9)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 5 for i in range(200, 230)} | {8: 7}
    assert {k: v for k, v in got.items() if k != v} == want


# --- shards

def test_shards(spark, docs, empty):
    got = sharding.shuffle_into_shards(docs.select("doc_id", "text", "start"), ["doc_id", "text"], shards=5, rows=3).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    again = sharding.shuffle_into_shards(docs.select("doc_id", "text", "start").repartition(2), ["doc_id", "text"], shards=5, rows=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.shuffle_into_shards(empty.select("doc_id"), ["doc_id"]).count() == 0


def test_shards_are_uniform(spark):
    got = sharding.shuffle_into_shards(spark.range(6_000), ["id"], shards=4, rows=500).toPandas()
    table = np.array([[((got.id * 12 // 6_000 == a) & (got.shard == s)).sum() for s in range(4)] for a in range(12)])
    assert ((table - 125) ** 2 / 125).sum() < 70  # chi-square with 33 degrees of freedom
    assert abs(np.corrcoef(got.id, got.slot)[0, 1]) < 0.06


def test_hypergeometric_law():
    import random
    rng = random.Random(5)
    x = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(x.mean() - 6) < 0.06 and abs(x.var() - 20 * .3 * .7 * 80 / 99) < 0.12
    m = np.array(sharding.communication_matrix([5, 0, 9, 6], [7, 7, 6], 1))
    assert m.sum(0).tolist() == [7, 7, 6] and m.sum(1).tolist() == [5, 0, 9, 6]


# --- repeated strings

def earlier(docs, width):
    seen, out = {}, []
    todo = {}
    for x in ordered(docs, F.hash):
        todo[(x.doc_id, x.h)] = x.text.encode()
    for key, b in todo.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if b[i:i + width] in seen:
                gone[i:i + width] = True
            else:
                seen[b[i:i + width]] = 1
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest())))
    return dict(out)


def test_minimisers_of_a_bucket_are_counted_once(monkeypatch):
    """Blobs of a bucket grow with the input: what is done for each must not grow with the bucket."""
    blobs = [superwindows.packed([np.array([k // 2, 1000 + k], np.uint32), np.array([k, k]), np.zeros(2, np.int32), np.zeros(2, np.int64), np.ones(2, np.int32),
                                  np.full(2, 3, np.int32), np.zeros(2, bool), np.frombuffer(b"%03d---" % k, np.uint8)]) for k in range(40)]
    seen, calls, real = [], [], np.unique
    monkeypatch.setattr(np, "isin", lambda *a, **k: calls.append("isin"))
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append("unique") or real(*a, **k))
    settle = lambda pieces: seen.extend(zip(pieces.value.tolist(), pieces.doc_id.tolist(), pieces.text)) or [np.zeros(0, np.int64)] * 4
    table = pa.table({"bucket": pa.array([0] * 40, pa.int64()), "blob": pa.array(blobs, pa.binary())})
    superwindows.settler(settle, 1)(table)
    assert calls == ["unique"] and seen == [(k // 2, k, b"%03d" % k) for k in range(40)]


def test_more_buckets_get_larger_chunks():
    rng = np.random.default_rng(2)
    text = [bytes(rng.integers(97, 123, 200_000, dtype=np.uint8)).decode() for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(range(30), pa.int64()), pa.array(text)], names=["doc_id", "text_hash", "text"])
    def dealt(buckets):
        deal = superwindows.dealer(superwindows.byte_symbols, 100, 16, buckets, np.array([1 << 14], np.int64), True)
        got = [[superwindows.unpacked(b, superwindows.PIECE) for b in r.column("blob").to_pylist()] for r in deal(iter([batch]))]
        return len(got), sorted(x for blobs in got for p in blobs for x in zip(*(a.tolist() for a in p[:6])))
    (few, a), (many, b) = dealt(90), dealt(600)
    assert (few, many) == (2, 1) and a == b


def test_only_pieces_with_a_repeated_window_are_merged(monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    inside = word(100)  # starts at an odd place of its pieces
    text = [word(n) for n in (100, 140, 180, 260)] + [word(3) + inside + word(20), word(41) + inside, word(30) + bytes(130)]
    count = np.array([len(t) - 99 for t in text])
    assert suffix_dedup.with_repeats(text, count, 100).tolist() == [False] * 4 + [True] * 3
    merged, real = [], suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda t, *a: merged.extend(t) or real(t, *a))
    n = len(text)
    pieces = superwindows.Pieces(np.ones(n, np.uint32), np.arange(n), np.arange(n), np.zeros(n, np.int64), count, np.zeros(n, bool), text)
    got = sorted(zip(*[x.tolist() for x in suffix_dedup.settle_bytes(100)(pieces)]))
    assert got == [(5, 5, 41, 141), (6, 6, 31, 160)] and merged == text[4:]


@pytest.mark.parametrize("hot", [8_000, 2])
def test_earlier_bytes(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(superwindows, "HOT_PIECES", hot)
    want = earlier(docs, 100)
    got = suffix_dedup.remove_earlier(docs).select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("h"), "dedup.*").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, r.h)]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert suffix_dedup.remove_earlier(empty).count() == 0


def periodic(rng, size, period):
    unit = rng.integers(97, 123, period, dtype=np.uint8)
    return np.resize(unit, size)


def test_equal_windows_of_one_run_are_seen():
    rng = np.random.default_rng(8)
    for width, gram in ((100, 16), (35, 4)):
        for size in range(width + 1, 2 * width + 20):
            for period in (size - width, width - gram, (size - width) // 2 + 1):
                codes = periodic(rng, size, period)
                b, at = codes.tobytes(), {}
                runs = superwindows.runs_of(codes, np.array([0, size]), width, gram)
                for i, (a, c) in enumerate(zip(runs.start.tolist(), runs.count.tolist())):
                    for j in range(a, a + c):
                        at.setdefault(b[j:j + width], []).append(i)
                assert all(runs.twice[i] for same in at.values() for i in same if same.count(i) > 1)


@pytest.mark.parametrize("hot", [8_000, 2])
def test_repeats_inside_one_document(spark, hot, monkeypatch):
    monkeypatch.setattr(superwindows, "HOT_PIECES", hot)
    rng = np.random.default_rng(9)
    text = [periodic(rng, n, 70).tobytes().decode() for n in [184] * 60 + list(range(165, 205))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    want = earlier(df, 100)
    got = suffix_dedup.remove_earlier(df).select("doc_id", F.hash("text").alias("h"), "dedup.*").collect()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id, r.h)] for r in got)
    assert len(got) == 100 and sum(r.n_removed for r in got) == sum(max(0, len(t) - 70) for t in text if len(t) >= 170)
    lists = [[f"{i}w{v}" for v in periodic(rng, n, 25)] for i, n in enumerate([66] * 60 + list(range(50, 90)))]
    want = []
    for i, w in enumerate(lists):
        k = [tuple(w[j:j + 35]) for j in range(len(w) - 34)]
        want.append((i, len({j + x for j, y in enumerate(k) if k.count(y) > 1 for x in range(35)})))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)], "doc_id long, text string")
    assert tally(substring_dedup.remove_repeats(df).select("doc_id", "dedup.n_removed"), ["doc_id", "n_removed"]) == sorted(want, key=repr)


def test_merged_transforms_are_the_sorted_suffixes():
    rng = np.random.default_rng(0)
    text = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (60, 45, 44, 90, 120, 44)]
    count = np.array([len(t) - 43 for t in text])
    groups = suffix_dedup.equal_windows(text + [text[0]], np.append(count, count[0]), 44, 70)
    windows = [t[i:i + 44] for t in text + [text[0]] for i in range(len(t) - 43)]
    by_group, by_text = {}, {}
    for g, w in zip(groups.tolist(), windows):
        assert by_group.setdefault(g, w) == w and by_text.setdefault(w, g) == g
    order = [by_group[g] for g in sorted(by_group)]
    assert order == sorted(order)


@pytest.mark.parametrize("hot", [8_000, 2])
def test_repeated_words(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(superwindows, "HOT_PIECES", hot)
    n, r = {}, ordered(docs)
    for x in r:
        w = words(x.text)
        for i in range(len(w) - 34):
            k = b" ".join(w[i:i + 35])
            n[k] = n.get(k, 0) + 1
    want = []
    for x in r:
        w, gone = words(x.text), set()
        for i in range(len(w) - 34):
            if n[b" ".join(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((x.doc_id, len(w), len(gone), hashlib.sha256(b" ".join(v for i, v in enumerate(w) if i not in gone)).hexdigest()))
    got = substring_dedup.remove_repeats(docs)
    assert tally(got.select("doc_id", "dedup.*"), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want, key=repr)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.select("dedup.*").where("n_removed > 0").collect())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_long_documents_are_cut_in_overlapping_stretches(monkeypatch):
    monkeypatch.setattr(superwindows, "SEGMENT", 64)
    codes = np.random.default_rng(1).integers(0, 3, 1_000).astype(np.uint64)
    offsets = np.array([0, 0, 5, 400, 440, 1_000])
    runs = superwindows.runs_of(codes, offsets, 20, 4)
    windows = np.concatenate([np.arange(s, s + c) for s, c in zip(runs.start, runs.count)])
    assert sorted(windows.tolist()) == [i for a, b in zip(offsets[:-1], offsets[1:]) for i in range(a, b - 19)]


def test_spans_settled_in_a_chunk_are_few_and_spread_over_groups():
    rng, buckets, seen, n = np.random.default_rng(6), 16, {}, 0
    for k in range(64):
        text = bytes(rng.integers(97, 123, 4_000, dtype=np.uint8)).decode()
        batch = pa.record_batch({"doc_id": pa.array([3 * k, 3 * k + 1, 3 * k + 2]), "text_hash": pa.array([1, 1, 1]), "text": [text, text, "X" + text[:-9] + "Y"]})
        deal = superwindows.dealer(superwindows.byte_symbols, 100, 16, buckets, np.array([1, 0]), True)  # all is hot
        for bucket, blob in zip(*[c.to_pylist() for c in next(deal(iter([batch])))]):
            if bucket >= buckets:
                spans = list(zip(*[x.tolist() for x in superwindows.unpacked(blob, superwindows.SPAN)]))
                assert spans == [(3 * k + 1, 1, 0, 4_000), (3 * k + 2, 1, 1, 3_992)]
                seen[bucket], n = seen.get(bucket, 0) + 1, n + 1
    assert n == 64 and len(seen) > buckets // 2 and max(seen.values()) < 16


def test_touching_spans_become_one():
    rng = np.random.default_rng(7)
    doc, start = rng.integers(0, 5, 200), rng.integers(0, 400, 200)
    stop = start + rng.integers(1, 6, 200)
    covered = {(d, i) for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()) for i in range(a, b)}
    got = list(zip(*[x.tolist() for x in superwindows.touching(doc, start, stop)]))
    assert [(d, i) for d, a, b in got for i in range(a, b)] == sorted(covered)
    assert all(d != e or b < c for (d, _, b), (e, c, _) in zip(got, got[1:]))


# --- language

def test_language(spark, docs, empty):
    en, de = "the house and the garden of my father were large ", "das haus und der garten von meinem vater waren groß "
    data = [(i, (en if i % 2 else de) + f"{i}", "en" if i % 2 else "de") for i in range(80)]
    data += [(100, None, "en"), (101, "123 !!", "de"), (102, "", None), (103, en, None), (104, en * 3_000, "en"), (None, de, "de")] + data[:3]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = df.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), language_id.identify(df).alias("p")).select("doc_id", "held_out", "p.*").collect()
    assert len(out) == len(data)
    got = {r.doc_id: r for r in out}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and got[103].lang_pred == got[104].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    one = df.where("lang = 'en'")
    assert {r.p.lang_pred for r in one.where("doc_id < 90").select(language_id.identify(one).alias("p")).collect()} == {"en"}
    assert {r.p.lang_pred for r in df.select(language_id.predict(F.col("text"), language_id.fit(df.limit(0))).alias("p")).collect()} == {"und"}
    assert empty.select(language_id.identify(empty)).count() == 0
    assert docs.select(language_id.identify(docs).alias("p")).count() == docs.count()


def test_codewords():
    for n in (2, 3, 4, 7, 9, 40):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all()


# --- packing

def test_word_ids_are_the_library_s_when_words_are_forgotten():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known, rng = packing.WordIds(library, remembered=400), np.random.default_rng(3)
    signs = [chr(c) for c in [*range(33, 127), *range(0xA0, 0x250), *range(0x300, 0x310), 0x4E2D, 0x3C3, 0x1F600, 0x200B, 0x2028, 0x85, 0xFB01]]
    signs += ["<|endoftext|>", "<|", "'s", "'ll"]
    for _ in range(60):
        text = [" ".join("".join(rng.choice(signs, rng.integers(1, 9))) for _ in range(rng.integers(0, 12))) for _ in range(8)]
        for t, ids in zip(text, known.of([t.encode().split() for t in text])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert known.old

def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.token_pieces(docs, path), docs.count(), group_docs=8).toPandas()
    tokenizer = Tokenizer.from_file(path)
    by_doc = {}
    for (d, h), part in got.groupby(["doc_id", "text_hash"], dropna=False):
        by_doc[(None if d != d else int(d), int(h))] = part
    for r in ordered(docs):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        part = by_doc[(r.doc_id, r.h)].sort_values("start", kind="stable")
        times = len(part[part.start == 0])
        assert (part.doc_tokens == len(ids)).all() and part.length.sum() == len(ids) * times
        for p in part.itertuples():
            assert p.ids == ids[p.start:p.start + p.length].tobytes()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2_048
    assert packing.pack(packing.token_pieces(empty, path), 0).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.sort(np.random.default_rng(2).integers(1, 101, 500))[::-1]
    free, want = [], []
    for s in sizes.tolist():
        i = next((i for i, f in enumerate(free) if f >= s), len(free))
        if i == len(free):
            free.append(100)
        want.append((i, 100 - free[i]))
        free[i] -= s
    assert list(zip(*map(list, packing.first_fit_decreasing(sizes, 100)))) == want


# --- fingerprints

def test_fingerprints(docs, empty):
    r, got = ordered(docs), fingerprint.compare_edits(docs)
    want = []
    for i, x in enumerate(r):
        n = len(x.text)
        edited = x.text[:n - n // 4] + r[(i + 1) % len(r)].text[:n // 4]
        want.append((x.doc_id, n, hashlib.sha256(edited.encode()).hexdigest()))
    assert tally(got, ["doc_id", "n_chars", "edited_sha256"]) == sorted(want, key=repr)
    by_text = {}
    for x in docs.select(fingerprint.packed(fingerprint.minhash(F.col("text"))).alias("f"), F.coalesce("text", F.lit("")).alias("t")).collect():
        assert by_text.setdefault(x.t, x.f) == x.f and len(x.f) == (256 if x.t.encode().split() else 0)
    assert fingerprint.compare_edits(empty).count() == 0
    single = fingerprint.compare_edits(docs.where("doc_id = 0")).first()
    assert single.near_next == 1


def test_likeness_estimates_jaccard(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 30_000)
    rng = np.random.default_rng(4)
    text = [" ".join(f"u{v}" for v in rng.integers(0, 10_000, n)) for n in rng.integers(5, 900, 120)]
    got = sorted(fingerprint.compare_edits(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    error = []
    for i, r in enumerate(got):
        t, m = text[i], len(text[i]) // 4
        a, b = ({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split(), (t[:len(t) - m] + text[(i + 1) % len(text)][:m]).split()))
        error.append(r.near_edited - len(a & b) / len(a | b))
        assert r.near_next < 0.06
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.06


# --- byte-level BPE

def test_byte_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in ordered(docs):
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    assert tally(got, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=repr)
    back = docs.select("text", byte_bpe.decode(byte_bpe.encode(F.col("text"), path, public_tokenizers.PATTERN), path).alias("b"))
    assert all(bytes(r.b).decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(2_000)]
    table = byte_bpe.PerfectHash(keys, list(range(2_000)))
    assert sorted(table.keys) == sorted(keys) and [table.get(k) for k in keys] == list(range(2_000)) and table.get(b"no") is None
    assert byte_bpe.PerfectHash([], []).get(b"x") is None


def test_groups_without_broadcasts(docs, monkeypatch):
    """What is exchanged where much goes is the same."""
    want = tally(simhash.one_per_group(docs), ["doc_id", "text"])
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(simhash.jaccard_join, "BROADCAST_ROWS", -1)
    assert tally(simhash.one_per_group(docs), ["doc_id", "text"]) == want
