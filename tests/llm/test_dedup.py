"""Exact dedup, SimHash and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import helpers
import numpy as np
import xxhash
from pyspark.sql import functions as F

from moodline.llm import simhash, substrings, suffix
from moodline.llm.common import keep_rows, row_hash
from moodline.llm.components import component_roots
from moodline.llm.exact_dedup import exact_dedup


def norm(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups_and_one_row_stays(spark):
    rows = helpers.awkward_rows()
    got = exact_dedup(helpers.awkward(spark)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], keep[norm(r[1])], len(groups[norm(r[1])])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_translation_of_non_ascii(spark):
    docs = spark.createDataFrame([(1, "ÀB😀C"), (2, "Àb😀c"), (3, "àb😀c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_hot_group_of_copies(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id"))
        .alias("text"))
    got = exact_dedup(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def test_keep_rows_keeps_columns_and_one_repeated_row(spark):
    docs = helpers.clashing(spark)
    decided = exact_dedup(docs, carry={"row_hash": row_hash(docs["text"])})
    out = keep_rows(docs, decided.filter("kept"))
    assert out.columns == docs.columns
    assert out.count() == decided.filter("kept").count()


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < n else [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for text in [None, "", " \n", "a", "A b\x0bc", "a b c d", "a b c d e a b c d e É é", "x " * 100]:
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def brute_components(values, radius):
    v = np.array(values, np.int64).view(np.uint64)
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {values[i]: values[find(i)] for i in range(len(v))}


def near_values():
    rng = np.random.default_rng(3)
    out = set()
    for base in rng.integers(-2**63, 2**63 - 1, 60):
        x = int(base) % (1 << 64)
        for _ in range(int(rng.integers(1, 8))):
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            out.add(x)
    for _ in range(300):  # one dense group
        x = 0x0123456789ABCDEF
        for bit in rng.choice(12, rng.integers(0, 5), replace=False):
            x ^= 1 << int(bit * 5)
        out.add(x)
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    values = near_values()
    want = brute_components(values, 4)
    for hot in (4096, 40):  # whole buckets, then split ones
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
        assert found.count() < 15 * 5 * len(values)
        roots = {r.node: r.root for r in component_roots(found).collect()}
        assert all(roots.get(v, v) == want[v] for v in values)


def test_bit_sliced_distance_for_other_radii():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 8, 300, dtype=np.uint64)
    planes = simhash.bit_planes(v)
    lanes = np.full(planes.shape[1] - 1, np.iinfo(np.uint64).max, np.uint64)
    for radius in range(1, 8):
        for shift in (1, 63, 64, 65, 130):
            words, hit = simhash.near_lanes(planes, lanes.copy(), np.arange(len(lanes)), shift, radius)
            bits = np.zeros(len(lanes) * 64, bool)
            for w, h in zip(words, hit, strict=True):
                bits[w * 64:w * 64 + 64] = [int(h) >> i & 1 for i in range(64)]
            near = np.bitwise_count(v[:-shift] ^ v[shift:]) <= radius
            assert (bits[:300 - shift] == near).all()


def test_component_id_is_the_smallest_reachable_id(spark):
    got = simhash.near_dedup(helpers.awkward(spark)).collect()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {4}
    assert {r.component_id for r in got if r.doc_id in (11, 12)} == {11}
    assert {r.component_id for r in got if r.doc_id is None} == {None}


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    roots = {r.node: r.root for r in component_roots(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}


# -- substrings ---------------------------------------------------------------

def test_suffix_sort_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        depth = rng.choice([1, 2, 3, 7, 8, 20])
        pieces = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40)))
                  for _ in range(rng.randint(1, 8))]
        pieces.append(pieces[0][:30] + b"b" + pieces[0])
        count = Counter(p[i:i + depth] for p in pieces for i in range(len(p) - depth + 1))
        want = [[i for i in range(len(p) - depth + 1) if count[p[i:i + depth]] > 1] for p in pieces]
        assert [list(map(int, x)) for x in suffix.repeated_starts(pieces, depth)] == want


def brute_removal(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = Counter(hash(r[i:i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[hash(r[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_removed_strings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "of", "é", "word", "x"] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages, line = [prose(60) for _ in range(5)], prose(20)
    texts = [None, "", "a" * 199, "a" * 1000, "ab" * 400, "The " * 300, "z" * 200]
    for _ in range(120):
        t = prose(rng.randint(5, 80))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice([" ", "\n"]) + rng.choice(passages)[:rng.randint(50, 500)] + " " + prose(rng.randint(0, 50))
        if rng.random() < 0.4:
            t += " " + line + " " + prose(40)
        texts.append(t)
    for i in range(20):
        t = texts[10 + i % 3]
        k = rng.randrange(len(t))
        texts.append(t[:k] + "QQ" + t[k + 2:])
    texts += texts[50:55]
    want = brute_removal(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for hot in (4000, 5):  # plain buckets, then split ones
        monkeypatch.setattr(substrings, "HOT_PIECES", hot)
        got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == dict(enumerate(want))


def test_pieces_cover_all_windows_over_block_edges(monkeypatch):
    rng = random.Random(0)
    raw = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = substrings.pieces_of(raw)
    assert whole[1].sum() == len(raw) - substrings.LENGTH + 1
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    parts = substrings.pieces_of(raw)
    assert parts[1].sum() == whole[1].sum() and (np.diff(parts[0]) > 0).all()


def test_buckets_of_fingerprints_that_share_many_bits_become_small(spark):
    import time
    rng = np.random.default_rng(5)
    shared = np.uint64(0x0123_4567_89AB_CDEF) & np.uint64((1 << 30) - 1)
    values = (rng.integers(0, 1 << 34, 60_000).astype(np.uint64) << np.uint64(30)) | shared
    planted = []
    for i in range(0, 2000):
        flips = rng.choice(64, 4, replace=False)
        near = values[i] ^ np.uint64(sum(1 << int(b) for b in flips))
        planted.append((values[i], near))
    every = np.unique(np.concatenate([values, np.array([b for _, b in planted], np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in every.view(np.int64).tolist()], "fp long").repartition(8)
    t = time.monotonic()
    got = simhash.links(df, 4)
    found = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got.collect()}
    assert time.monotonic() - t < 120
    parent = {int(v): int(v) for v in every}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in found:
        assert bin(a ^ b).count("1") <= 4
        parent[find(a)] = find(b)
    assert all(find(int(a)) == find(int(b)) for a, b in planted)
    # a sample against all others by brute force
    for v in rng.choice(every, 60, replace=False):
        for w in every[np.bitwise_count(every ^ v) <= 4]:
            assert find(int(v)) == find(int(w))
    rows = df.selectExpr("0L AS key", "fp", f"{(1 << 22) - 1}L AS used")  # one bucket of all
    sizes = [p.groupBy("key").count().agg({"count": "max"}).first()[0] for p in simhash.small_buckets(rows, 4)]
    assert max(s or 0 for s in sizes) <= simhash.HOT_ROWS
