import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from motorlake.llm import simhash
from motorlake.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, bits=2):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "one two three", "ÄB äb C c", "a b c a b c a b c", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_corpus(corpus):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_groups(sorted(texts), fps)
    rows = simhash.simhash_groups(corpus).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{fp:016x}" for i, fp in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def planted(n=400, seed=5):
    """Random fingerprints, chains that link over several steps, and a tight ball."""
    chance = np.random.default_rng(seed)
    fps = set(map(int, chance.integers(0, 1 << 63, n)))
    for start in list(fps)[:20]:
        for _ in range(6):
            start ^= (1 << int(chance.integers(0, 64))) | (1 << int(chance.integers(0, 64)))
            fps.add(start)
    centre = int(chance.integers(0, 1 << 63))
    fps |= {centre ^ sum(1 << int(b) for b in chance.integers(0, 20, 4)) for _ in range(300)}
    return np.array(sorted(fps), np.uint64)


@pytest.mark.parametrize(("sample", "shard", "rows", "leaf"), [(1 << 16, 1 << 13, 1 << 20, 256), (256, 64, 300, 8), (1 << 16, 8, 1, 8)])
def test_links_join_what_brute_force_joins(spark, sample, shard, rows, leaf):
    """With shards that fit at once, that are dealt out again over several rounds, and that no tree divides."""
    fps = planted()
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps.view(np.int64).tolist())], "node bigint, fp bigint")
    found = {r["node"]: r["component"] for r in components(simhash.near_links(nodes, sample=sample, shard=shard, shard_rows=rows, leaf=leaf)).collect()}
    want = brute_groups(list(range(len(fps))), [int(f) for f in fps])
    assert {i: found.get(i, i) for i in want} == want


def test_shards_are_dealt_out_again(spark):
    fps = planted()
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps.view(np.int64).tolist())], "node bigint, fp bigint")
    fit, dense = simhash.dealt(nodes, sample=128, shard=32, shard_rows=150)
    assert len(fit) > 1
    assert all(r["n"] <= 150 for rows in fit for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect())
    homes = [r["node"] for rows in [*fit, *(rows for rows, _ in dense)] for r in rows.where("home").collect()]
    assert sorted(homes) == list(range(len(fps)))


def test_rows_dealt_at_fourteen_million_fingerprints():
    """The tree for 14 million fingerprints, drawn from SAMPLE of them, and how many shards a fingerprint comes to."""
    chance = np.random.default_rng(2)
    total = 14_000_000
    tree = simhash.build_tree(chance.integers(0, 1 << 63, simhash.SAMPLE, np.uint64) * np.uint64(2), total, leaf=simhash.SHARD)
    some = chance.integers(0, 1 << 63, 50_000, np.uint64) * np.uint64(2)
    rows, leaves, home = simhash.places(tree, some)
    scaled = np.bincount(leaves) * total / len(some)
    print(len(scaled), len(rows) / len(some), scaled.max())
    assert len(scaled) > 1000 and home.sum() == len(some)
    assert len(rows) / len(some) < 40 and scaled.max() < simhash.SHARD_ROWS


def test_every_close_pair_meets_at_home():
    fps = planted()
    tree = simhash.build_tree(fps, len(fps), leaf=16)
    rows, leaves, home = simhash.places(tree, fps)
    assert np.array_equal(np.sort(rows[home]), np.arange(len(fps)))
    where = {}
    for r, leaf, h in zip(rows.tolist(), leaves.tolist(), home.tolist()):
        where.setdefault(leaf, {})[r] = h
    for a in range(len(fps)):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 2:
                assert any(a in x and b in x and (x[a] or x[b]) for x in where.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (202, 200), (300, 299)] + [(1000, i) for i in range(1001, 1100)] + [(5, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(61)} | {200: 200, 201: 200, 202: 200, 299: 299, 300: 299} | {i: 1000 for i in range(1000, 1100)}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_edges(documents):
    rows = documents([(5, "same words here now"), (3, "same words here now"), (3, "same words here now"), (9, None), (8, ""), (None, "same words here now"), (None, "quite another text that stands alone"), (4, "another text of its own entirely")])
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.simhash_groups(rows).collect() if r["component_id"] is not None)
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 3), (8, 8), (9, 8)]
    assert simhash.simhash_groups(rows.limit(0)).count() == 0
