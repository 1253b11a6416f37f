"""Importance resampling, near-duplicate embeddings and hard negatives against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import balltree, importance, multiindex
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_importance", "op12_multiindex", "op13_balltree"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    a, b = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


# ---------------------------------------------------------------- importance


def brute_importance(docs, target, ngram, buckets, least, percent):
    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in low).split(" ")
        words = [w for w in words if w]
        runs = [" ".join(words[k : k + n]) for n in range(1, ngram + 1) for k in range(len(words) - n + 1)]
        return words, [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = (Counter(b for x in side for b in found(x)[1]) for side in ([d[1] for d in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, at = found(text)
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted((r[:4] for r in out), key=str), rank


@pytest.mark.parametrize("ngram", [1, 2])
def test_importance(spark, ngram):
    """Copies, nulls, no words, separators that aren't spaces, other scripts, a very long text, repeated rows and null ids."""
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "NULL", "日本", "a b", "İx"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(60)]
    docs = [(k, texts[k % 45]) for k in range(120)] + [(200, None), (201, ""), (202, "--- ..."), (203, "a_b-c\x00d\x7fe"), (204, " ".join(rng.choice(vocabulary, 60_000))), (5, texts[5]), (5, texts[5]), (None, texts[0]), (None, None)]
    target = [texts[1], texts[2], None, "w1 w1 w2"]
    want, rank = brute_importance(docs, target, ngram, 97, 10, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "n": F.lit(1), "digest": F.lit(None).cast("string"), "rank": F.lit(0)}).repartition(7)
    got = importance.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), ngram=ngram, buckets=97, least_words=10, percent=30).collect()
    assert sorted(((r["id"], r["n_features"], r["weight"], r["score"]) for r in got), key=str) == want
    mine = {}
    for r in got:
        if r["rank"] is not None:
            mine.setdefault((r["id"], r["n_features"], r["weight"], r["score"]), []).append(r["rank"])
    assert {k: sorted(v) for k, v in mine.items()} == rank


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resampled(none, some).count() == 0
    (row,) = importance.resampled(some, none, least_words=1, percent=100).collect()
    assert row["n_features"] == 3 and row["rank"] == 1


# ---------------------------------------------------------------- multi-index


def brute_links(rows, linked=0.98):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= linked:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    root[find(b)] = find(a)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            r = find(k)
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], n[k], least.get(find(k)), rows[k][0] is not None and rows[k][0] == least.get(find(k))) for k in range(len(rows))), key=str)


def planted_vectors():
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(90, 12)), []
    for k in range(260):
        v = base[k % 90] if k < 90 else base[rng.integers(0, 25)] + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.1, 0.15])
        rows.append((k, [float(x) for x in v * rng.choice([1.0, 2.0])], int(k % 3)))
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]  # copies
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [-0.0] * 11 + [0.0], 1), (403, [1.0] * 11 + [float("nan")], 1), (404, [1.0] * 11 + [None], 1), (405, rows[1][1], None), (406, [], 1), (407, [float("inf")] + [1.0] * 11, 1)]
    rows += [(408, [1.0, 2.0], 1), (409, [2.0, 4.1], 1), (410, [3.0], 2), (411, [5.0], 2), (412, [-5.0], 2), (413, [1e-200] * 12, 2), (414, [1e200] * 12, 2), (0, rows[0][1], 0), (None, rows[2][1], 2), (None, [7.0] + [0.0] * 11, 2)]
    return rows


@pytest.mark.parametrize("cell,tile", [(1024, 1024), (8, 16), (2, 7)])
def test_multiindex(spark, monkeypatch, cell, tile):
    """Every link is found and counted, whatever the number of codewords and the size of tiles."""
    monkeypatch.setattr(multiindex, "CELL", cell)
    monkeypatch.setattr(multiindex, "TILE", tile)
    rows = planted_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"n": F.lit(1), "cls": F.lit("x"), "key": F.lit(None).cast("string")}).repartition(5)
    got = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in multiindex.clusters(df).collect()), key=str)
    assert got == brute_links(rows)


def test_multiindex_recall_target(spark, monkeypatch):
    """A target under 1 visits fewer cells and still reaches it on noise in random directions."""
    monkeypatch.setattr(multiindex, "CELL", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 16))
    near = base + rng.normal(size=base.shape) * 0.15
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole, part = (sum(r["n_links"] for r in multiindex.clusters(df, target_recall=t).collect()) for t in (1.0, 0.95))
    u = multiindex.units(np.array([r[1] for r in rows]))
    assert whole == int((np.triu(u @ u.T >= 0.98, 1)).sum()) * 2 and 0.9 * whole <= part <= whole


def test_multi_sequence_stops_where_the_sums_do():
    rng = np.random.default_rng(4)
    a, b = rng.random((20, 6)), rng.random((20, 9))
    row, i, j = multiindex.multi_sequence(a, b, 0.5)
    want = {(r, x, y) for r in range(20) for x in range(6) for y in range(9) if a[r, x] + b[r, y] <= 0.5}
    assert len(row) == len(want) and set(zip(row.tolist(), i.tolist(), j.tolist())) == want


def test_reach_is_a_lower_bound():
    rng = np.random.default_rng(5)
    words, x, y = rng.normal(size=(9, 5)), rng.normal(size=(60, 5)), rng.normal(size=(200, 5))
    own = multiindex.distances(y, words).argmin(1)
    bound = multiindex.reach(x, words)[1]
    true = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (bound[:, own] <= true + 1e-9).all() and (bound > 0).any()


def test_multiindex_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multiindex.clusters(none).count() == 0
    one = spark.createDataFrame([(4, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in multiindex.clusters(one).collect()] == [(4, 0, 4, True)]


# ---------------------------------------------------------------- ball trees


def brute_negatives(rows, every=10, positives=5, negatives=5, low=80, of=100):
    ok = [(k, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in ok:
        if i % every:
            continue
        score = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j, other) for m, j, other, w in ok if m != k and len(w) == len(v)]
        for p, j, _ in sorted((s for s in score if s[2] == label), key=lambda s: (-s[0], s[1]))[:positives]:
            hard = sorted((s for s in score if s[2] != label and low * p <= of * s[0] <= of * p), key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, j, n + 1, h[1], p, h[0]) for n, h in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("part,block,leaf", [(8192, 2048, 64), (50, 7, 4)])
def test_hard_negatives(spark, monkeypatch, part, block, leaf):
    """Ties, copies, negative scores, repeated ids, other lengths, null and non-finite rows."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=6) * 0.4], int(rng.integers(0, 4))) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1], k % 4) for k in range(60)]
    rows += [(400, None, 1), (401, [1.0] * 6, None), (402, [1.0] * 5 + [None], 1), (403, [1.0] * 5 + [float("nan")], 1), (404, [1.0] * 5 + [float("inf")], 1), (None, [1.0] * 6, 1), (10, rows[10][1], 2), (10, rows[11][1], 3), (410, [0.5, 0.5], 1), (411, [0.5, 0.4], 1), (412, [0.5, 0.3], 2), (420, [], 1), (430, [1e9] * 6, 1), (431, [1e9] * 6, 1), (432, [9e8] * 6, 2), (440, [2e6, 1.0, 3.0], 1), (441, [2e6, 1.1, 3.0], 1), (442, [2e6, 1.0, 2.9], 2), (443, [1.9e6, 1.0, 2.9], 2)]
    monkeypatch.setattr(balltree.Tree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(balltree.search, "__defaults__", (part, block))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "row": F.lit(2), "id": F.lit("c")}).repartition(6)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = balltree.mined(balltree.prepared(df, label=moved), F.col("id") % 10 == 0)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == brute_negatives(rows)


def test_trees_prune_and_miss_nothing():
    """On clustered rows most leaves are skipped; the k best are those of a full search, ties by id."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 6)
    ids, row = rng.permutation(4000), np.arange(4000)
    q = x[:20]
    high = np.full(20, 1 << 40)
    high[10:] = np.quantile(q[10:] @ x.T, 0.5, axis=1).astype(int)
    low = np.where(np.arange(20) < 10, -(1 << 40), (high * 0.8).astype(int))
    search = balltree.Search(q, row[:20], low, high, 5)
    tree = balltree.Tree(x, 32)
    search.run(tree, x, ids, row, np.arange(20))
    for k in range(20):
        s = (q[k] @ x.T).astype(int)
        want = sorted((-s[m], ids[m]) for m in range(4000) if m != k and low[k] <= s[m] <= high[k])[:5]
        assert [(-a, b) for a, b, h in zip(search.score[k], search.id[k], search.held[k]) if h] == want
    leaves = sum(left < 0 for _, _, left, _ in tree.nodes)
    assert search.leaves < 0.5 * 20 * leaves


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert balltree.mined(balltree.prepared(none), F.col("id") % 100 == 0).count() == 0
