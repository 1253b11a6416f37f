"""The pipeline's near-duplicates against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm import near, simhash

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in root}


def test_stage_keeps_one_of_each_component(spark):
    """Given documents, with pairs of similarity 0.8 to 0.9 whose fingerprints differ in over three bits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["id"]: r["component_id"] for r in near.clusters(docs).collect()} == want
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == set(want.values())


def test_all_open_pairs_are_compared(spark, monkeypatch):
    """Chains of edited texts that share many keys, with and without the rounds of stars."""
    rng = random.Random(3)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    for _ in range(6):
        words = [word() for _ in range(120)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice((1, 2, 3, 4))):
                words[rng.randrange(120)] = word()
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_components(rows)
    assert 6 < len(set(want.values())) < len(rows)
    for stars, tile, shingles in ((1, 4096, 1 << 20), (1, 5, 1 << 20), (1, 4096, 300), (2, 4096, 1 << 20)):
        monkeypatch.setattr(near, "STARS", stars)
        monkeypatch.setattr(near, "TILE", tile)
        monkeypatch.setattr(near, "TILE_SHINGLES", shingles)
        assert {r["id"]: r["component_id"] for r in near.clusters(docs.withColumn("x", F.lit(1))).collect()} == want


def test_links_across_roots():
    rng = random.Random(6)
    found = [near.np.unique(near.np.array([rng.randrange(40) for _ in range(rng.randrange(8, 20))], near.np.int64)) for _ in range(60)]
    found += [near.np.unique(near.np.append(x[1:], 99)) for x in found[:20]]
    cls, root = near.np.arange(80), near.np.array([rng.randrange(12) for _ in range(80)])
    want = set()
    for a, b in combinations(range(80), 2):
        x, y = set(found[a].tolist()), set(found[b].tolist())
        if root[a] != root[b] and 5 * len(x & y) >= 4 * len(x | y):
            want.add((min(root[a], root[b]), max(root[a], root[b])))
    got = near._across(cls, root, found)
    assert {tuple(sorted((root[a], root[b]))) for a, b in got} == want and len(got) == len(want) > 3
    for a, b in got:
        x, y = set(found[a].tolist()), set(found[b].tolist())
        assert 5 * len(x & y) >= 4 * len(x | y)
