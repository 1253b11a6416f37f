"""The fingerprints' part in the pipeline's near-duplicates."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm import near, simhash


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """With no class filed under minima, the stage still joins texts whose fingerprints differ in three bits or fewer and that are
    similar enough, and no others."""
    rng = random.Random(4)
    rows = []
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k in range(4):
            rows.append((len(rows), " ".join(words[:-1] + [f"end{k}"])))
    rows += [(len(rows), "a b"), (len(rows) + 1, "A b"), (len(rows) + 2, None), (len(rows) + 3, " ")]
    docs, links = spark.createDataFrame(rows, "doc_id long, text string"), near.links
    monkeypatch.setattr(near, "links", lambda filed, sets, candidates: links(filed.limit(0), sets, candidates))
    got = {r["id"]: r["component_id"] for r in near.clusters(docs).collect()}
    sets = {i: near.shingles((t or "").encode()) for i, t in rows}
    prints, root = {i: simhash.majority(x) for i, x in sets.items()}, {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        shared = len(near.np.intersect1d(sets[a], sets[b]))
        if (prints[a] ^ prints[b]).bit_count() <= 3 and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert len(set(root.values())) < 20  # fingerprints reach most of the edited texts
    assert got == root


def test_alike_fingerprints_of_unlike_sets_stay_apart(spark):
    """Classes of one fingerprint are candidates, which the exact similarity judges."""
    classes = spark.createDataFrame([(1, 5, 7), (2, 6, 7), (3, 5, 6), (4, 9, -(2**40))], "cls long, n int, fp long")
    pairs = {tuple(sorted((r["a"], r["b"]))): tuple(sorted((r["n"], r["m"]))) for r in near.printed(classes).collect()}
    assert pairs == {(1, 2): (5, 6), (1, 3): (5, 5)}
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5, 6]), (3, [1, 2, 7, 8, 9])], "cls long, found array<long>")
    none = classes.select(F.lit(0).cast("long").alias("key"), "cls", "n").limit(0)
    assert [(r["a"], r["b"]) for r in near.links(none, sets, near.printed(classes)).collect()] == [(1, 2)]
