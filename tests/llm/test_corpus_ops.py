"""Chat, decontamination, substrings, toxicity, near-duplicates, URL filters and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from test_near import brute_components
from pyspark.sql import functions as F

from tessera.llm import chat, components, decontaminate, fmindex, queries, simhash, substrings, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fingerprint string, component_id string, starts string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], DOCS)


# ---------------------------------------------------------------- chat

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST]", "[/INST]", "<s>", "<sep>", "\\", "<", "[", "/", "INST", "s>", "é", "\n", " ", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "a[INST]b"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, 1, None, None), (100, 0, "assistant", None), (None, 1, "user", "x"), (101, None, "user", "first"), (101, 5, "user", "last"), (102, 1, "user", "tie b"), (104, 2, "user", "<s>"), (104, 2, "user", "<a>"), (104, 2, "user", "[INST]"), (104, 2, "user", "[A"), (104, 2, "a</s>", "x"), (104, 2, "a<z", "x"), (102, 1, "user", "tie a"), (102, 1, "user", "tie a"), (103, 0, "assistant", "z" * 100_000)]
    shuffled = rng.sample(rows, len(rows))
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(spark.createDataFrame(shuffled, TURNS))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in back[c]["turns"]] == want
        assert back[c]["loss"] == "".join(t for r, t in want if r == "assistant")
        for control in ("</s>", "<s>"):
            assert back[c]["formatted"].count(control) == sum(i == 0 or a[0] != want[i - 1][0] for i, a in enumerate(want))
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_has_no_python(spark):
    plan = chat.op4_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- decontamination


def test_masks_miss_no_window():
    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        k = decontaminate.tolerance(n)
        for bad in map(set, combinations(range(n), k)):
            assert any(all(s + o not in bad for o in m) for m in decontaminate.MASKS for s in range(n - m[-1]))
    assert decontaminate.tolerance(decontaminate.WINDOW) == decontaminate.MOST_DIFFERENT


def brute_overlaps(docs, items):
    tok, out = (lambda t: re.findall(r"[^\W_]+", (t or "").lower())), set()
    for i, t in docs:
        w = tok(t)
        for it, b in ((i, tok(t)) for i, t in items):
            n = min(decontaminate.WINDOW, len(b))
            for g in range(-len(b), len(w)):
                eq = [0 <= g + k < len(w) and w[g + k] == b[k] for k in range(len(b))]
                if b and max(sum(eq[z : z + n]) for z in range(len(b) - n + 1)) >= n - decontaminate.tolerance(n):
                    out.add((i, it))
                    break
    return out


@pytest.mark.parametrize("most", [0, 10**6])
def test_overlaps(spark, most):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou")
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 8, 9, 12, 19, 20, 21, 40))))) for k in range(14)]
    items += [(20, None), (21, ""), (22, items[8][1].upper() + "!"), (None, items[9][1])]
    docs = []
    for k in range(120):
        w = [word() for _ in range(rng.randint(0, 60))]
        b = (rng.choice(items[:14])[1]).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4, 5, 6))):
            b[rng.randrange(len(b))] = word()
        cut = rng.choice((0, 0, 0, 3))
        docs.append((k, " ".join(w + b[cut:] + [word() for _ in range(rng.choice((0, 5)))])))
    docs += [(500, None), (501, ""), (None, items[9][1]), (7, items[5][1]), (502, items[12][1] + " " + "filler " * 20_000)]
    got = decontaminate.overlaps(docs_of(spark, docs), spark.createDataFrame(items, "item_id int, text string"), most_broadcast=most)
    assert {(r["id"], r["item"]) for r in got.collect()} == brute_overlaps(docs[:-1], items) | brute_overlaps([(502, items[12][1] + " filler" * 30)], items)


def test_decontamination_stage(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    docs = docs_of(spark, [(1, "clean text"), (2, item["text"]), (None, "x " + item["text"]), (3, None), (3, None)])
    out = decontaminate.stage(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3]
    assert decontaminate.stage(spark, docs.limit(0), SF).count() == 0


# ---------------------------------------------------------------- substrings


def brute_statistics(rows, ids):
    """Longest match at each place with a row of a smaller id, by trying all."""
    out = []
    for x, i in zip(rows, ids, strict=True):
        others = [y for y, j in zip(rows, ids, strict=True) if j < i]
        for p in range(len(x)):
            out.append(max((next((k for k in range(len(x) - p + 1) if x[p : p + k + 1] != y[q : q + k + 1] or p + k >= len(x)), 0) for y in others for q in range(len(y))), default=0))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    kinds = rng.choice((1, 2, 3, 20))
    rows = [[rng.randrange(kinds) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 9))]
    rows += [rng.choice(rows)[rng.randrange(8) :] or [0] for _ in range(4)]
    ids = np.array([rng.randrange(6) for _ in rows])
    _, words = np.unique([w for x in rows for w in x], return_inverse=True)
    index = fmindex.Index(words, np.cumsum([len(x) for x in rows]), ids)
    assert fmindex.matching_statistics(index).tolist() == brute_statistics(rows, ids)


def test_wavelet_ranks():
    symbols = np.minimum(np.random.default_rng(0).geometric(0.2, 1000), 30)
    tree = fmindex.WaveletTree(symbols, 37)
    at, what = np.arange(0, 1001, 7), np.arange(0, 1001, 7) % 37
    for a, b, (x, y) in zip(at, np.minimum(at + at % 90, 1000), tree.ranks(what, np.stack([at, np.minimum(at + at % 90, 1000)])).T, strict=True):
        want = [int((symbols[:p] == (a % 37)).sum()) for p in (a, b)]
        assert [x, y] == want or (want[0] == want[1] and x == y)
    packed, bits = sum(len(x[0]) for x in tree.levels), np.bincount(symbols, minlength=37)
    share = bits[bits > 0] / 1000
    assert packed * 64 < 1000 * (1.2 - (share * np.log2(share)).sum()) + 64 * len(tree.levels)  # near the entropy


def test_words_alike_but_for_their_hash_stay(spark):
    """Two long words whose polynomial hashes agree whatever the base (Thue and Morse) are different words."""
    bit = [bin(k).count("1") & 1 for k in range(2048)]
    a, b = ("".join("ab"[x] for x in bit), "".join("ba"[x] for x in bit))
    rest = " ".join(f"w{k}" for k in range(49))
    got = substrings.removed(docs_of(spark, [(1, a + " " + rest), (2, b + " " + rest), (3, a + " " + rest)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (3, 50)]


def test_long_periodic_text(spark):
    rows = [(1, "a b " * 3000), (2, "x " + "b a " * 3000)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.removed(docs_of(spark, rows)).collect()) == [(1, 0), (2, 6000)]


def brute_removed(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    out = []
    for i, w in words:
        gone = {k + d for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for d in range(50)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most_units", [1, 20_000])
def test_op6(spark, tmp_path, monkeypatch, most_units):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou")
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(rng.randint(0, 40))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            w += s + [word() for _ in range(rng.randint(0, 30))]
        rows.append((k, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (5, rows[6][1]), (102, None), (103, ""), (None, rows[5][1]), (104, "na " * 400), (105, "na " * 300), (104, "na " * 400), (106, "é " * 60), (107, "é " * 60)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(substrings.marks, "__defaults__", (most_units, 500))
    got = [tuple(r) for r in substrings.op6_substrings(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_removed(rows), key=key)


def test_op6_of_an_empty_table(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert substrings.op6_substrings(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- toxicity


def test_label_model_finds_good_and_copied_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y)
    good, fair, poor = vote(0.95), vote(0.8), vote(0.6)
    m = toxicity.label_model(np.stack([good, fair, poor, poor, poor], 1), np.where(fair, 0.8, 0.2))
    assert ((m.posterior > 0.5) == y).mean() > (fair == y).mean() > (poor == y).mean()  # better than where it began
    assert m.accuracy[0] > m.accuracy[1] > m.accuracy[2]
    assert m.correlation[2, 3] > 0.9 and m.correlation[0, 1] == 0
    assert m.rate[1, 0] > 0.7 > 0.2 > m.rate[0, 0]  # how often the good voter fires in either class


def test_wrong_labels_are_overruled():
    """The given labels start the model and don't vote: where the voters say otherwise the posterior does, and so the classifier
    differs from one trained on the given labels."""
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.4
    votes = np.stack([np.where(y, rng.random(3000) < r, rng.random(3000) < 0.02) for r in (0.9, 0.8, 0.7, 0.6)], 1).astype(np.float32)
    given = np.where(rng.random(3000) < 0.1, ~y, y).astype(np.int8)
    weights, bias, model = toxicity.learnt(votes, given, 4)
    assert ((model.posterior > 0.5) == y).mean() > 0.97 > 0.92 > (given == y).mean()
    raw, raw_bias = toxicity._regression(votes.astype(float), given.astype(float))
    assert np.abs(np.append(weights - raw, bias - raw_bias)).max() > 0.5


def test_posteriors_and_labels(spark):
    """How often they agree on given rows, though no label votes."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    sample = toxicity.written(toxicity.labelled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels), "sample")
    names = toxicity.mine(sample)
    x, given = toxicity.found_in(sample, names)
    kept = toxicity.covering(x, given, len(names))
    _, _, model = toxicity.learnt(np.concatenate([x[:, kept], x[:, len(names) :]], 1), given, len(kept))
    assert 0.97 < ((model.posterior > 0.5) == given).mean() <= 1
    assert (model.correlation > 0).any() and len(kept) < len(names)


def brute_score(model, text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    found = [any(w == e[2:] if e[0] == "w" else len(w) > len(e) - 2 and w.startswith(e[2:]) for w in words) for e in model.entries]
    found += [bool(p.search(text)) for p in toxicity._PATTERNS.values()]
    return 1 / (1 + np.exp(-np.clip(model.bias + model.weights[np.array(found, bool)].sum(), -30, 30)))


def test_op8_scores_are_the_classifier_s(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"]: brute_score(model, r["text"] or "") for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.op8_toxicity(spark, SF).collect()}
    assert got == pytest.approx(want) and len(set(got.values())) > 3


def test_long_words_and_repeated_ids(spark):
    long = "abcdefgh" * 10
    rows = [(k, "vile " + long if k % 2 else "a fine day") for k in range(200)] * 3
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled(docs_of(spark, rows), labels, (20, 30))
    assert [r["count"] for r in sample.groupBy("toxic").count().orderBy("toxic").collect()] == [30, 20]
    assert toxicity.Matcher(["w:" + long]).present(f"x {long.upper()}!") == [0] and "w:" + long in toxicity.entries(long)


def test_toxicity_stage_and_odd_rows(spark):
    rows = [(k, "vile scum" if k % 2 else "a fine day") for k in range(300)]
    docs = docs_of(spark, [*rows, (None, None), (None, "vile scum"), (1, "a fine day"), (1000, "good " * 50_000), (1001, ""), (3, "vile scum")])
    import unittest.mock

    with unittest.mock.patch.object(toxicity, "table", lambda *_: spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")):
        out = toxicity.stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect()) == sorted([(False, k) for k in range(0, 300, 2)] + [(True, 0), (False, 1), (False, 1000), (False, 1001)])
        assert toxicity.stage(spark, docs.limit(0), SF).count() == 0


def test_op8_of_an_empty_table(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op8_toxicity(spark, str(tmp_path)).count() == 0


def test_pruned_entries():
    rows = [("p:lose", 100, 30), ("w:loser", 98, 0), ("p:lowe", 50, 0), ("p:lowei", 50, 0), ("p:loweis", 20, 0)]
    assert toxicity.pruned(rows) == ["w:loser", "p:lowei"]


def test_matcher_keeps_to_words():
    m = toxicity.Matcher(["w:scum", "p:lowei", "w:a"])
    assert m.present("SCUM, loweixy") == [0, 1] and m.present("scums xlowei lowei") == [] and m.present("") == []


def test_op8_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op8_toxicity(spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == 1000 and both.score.between(0, 1).all()
    assert (both.predicted == both.toxic).mean() > 0.95 and both[both.toxic == 0].predicted.mean() < 0.01


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, [(1, None), (1, ""), (None, "x"), (2, "scum " * 20_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r["score"] < 0.5 for r in toxicity.scores(docs, model).collect()] == [True] * 4
    rows = [(k, "scum" if k % 2 else "a fine day") for k in range(200)]
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame([(k, 1, k % 2) for k, _ in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert scores[2] > 0.5 > scores[1]


# ---------------------------------------------------------------- near-duplicates


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a b c", "A B\tc  d\xa0E É", "x " * 500, "one two three one two three four"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_golay_keys_meet_for_all_near_pairs():
    """All 43,745 ways of flipping up to three bits of some words."""
    rng = np.random.default_rng(1)
    masks = np.array([0, *(1 << a for a in range(64)), *(1 << a | 1 << b for a, b in combinations(range(64), 2)), *(1 << a | 1 << b | 1 << c for a, b, c in combinations(range(64), 3))], np.uint64)
    for word in rng.integers(0, 1 << 63, 2, dtype=np.uint64):
        row, key = simhash.fuzzy_keys(masks ^ word)
        own = key[row == 0]
        assert len(np.unique(row[np.isin(key, own)])) == len(masks)


def test_clusters(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:10]:
        x = b
        for _ in range(12):  # chains of near fingerprints
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x = x ^ (np.uint64(1) << np.uint64(bit))
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    want = list(range(len(fps)))

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if int(fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            want[max(x, y)] = min(x, y)
    groups = lambda pairs: {frozenset(g) for g in pairs.values()}
    expected: dict = {}
    for k in range(len(fps)):
        expected.setdefault(root(k), set()).add(int(fps[k]))
    for tile in (4096, 3):
        monkeypatch.setattr(simhash, "TILE", tile)
        links = simhash.links(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long"))
        got: dict = {}
        linked = components.components(links).collect()
        for r in linked:
            got.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
        assert groups(got) == {g for g in groups(expected) if len(g) > 1}


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (300, 300), (7, 3)] + [(1000, 1000 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100} | {1000 + k: 1000 for k in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_stage_and_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    near = long.replace("w150 ", "other ")
    rows = [(9, long), (4, near), (7, long), (4, near), (5, None), (6, ""), (None, long), (8, "unlike all " + "z " * 5000), (3, "short one")]
    docs = docs_of(spark, rows)
    found = {(r["id"], r["component_id"]) for r in simhash.clusters(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert (fps[9] ^ fps[4]).bit_count() <= 3
    assert found == {(9, 4), (4, 4), (7, 4), (None, 4), (5, 5), (6, 5), (8, 8), (3, 3)}
    out = simhash.stage(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 4, 5, 8]
    assert simhash.stage(spark, docs.limit(0), SF).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    out = simhash.stage(spark, docs_of(spark, [(5, a), (5, b), (9, a), (None, b), (None, "of its own"), (None, "of its own")]), SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "of its own"), (5, a), (5, b)]


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tessera.llm import common

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://a:7077"), conf=conf))


# ---------------------------------------------------------------- URL filters

PAGES = "page_id long, url string, html string, host string, path string"


def test_url_parts_and_rules(spark):
    rows = ["https://Blog.Example.COM/en/7x?q=1", "http://a.com/en/1", "http://com/en/", "xcom/en/", None, "ftp://b.net#f", "http://ex.net/de/9?a://b", "https://example.net/de/8", "http://É.org/es/", "s://h", "http://c.org/ES/", "http://excom/en/"]
    pages = spark.createDataFrame([(k, u, None, "clash", "clash") for k, u in enumerate(rows)], PAGES)
    got = {r["page_id"]: r for r in urls.judged(pages, urls.rules_table(spark)).collect()}
    assert len(got) == len(rows)
    want = [("blog.example.com", "/en/7x", "example.com/en/7"), ("a.com", "/en/1", "com/en/"), ("com", "/en/", "com/en/"), ("", "", None), ("", "", None), ("b.net", "", None), ("ex.net", "/de/9", "net/de/"), ("example.net", "/de/8", "example.net/de/8"), ("É.org", "/es/", "org/es/"), ("h", "", None), ("c.org", "/ES/", None), ("excom", "/en/", None)]
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(rows))] == want
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and got[3]["verdict"] == "allow"


def test_rules_are_those_of_the_contract(spark):
    """Each rule's own word decides, in the query and in its SQL."""
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(want)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages, urls.rules_table(spark), urls.ROUNDS).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
    con = duckdb.connect()
    con.sql("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, null)", [(k, u) for k, u in enumerate(want)])
    stated = {k: (r, v) for k, r, v in con.sql(f"select page_id, rule, verdict from ({urls.OP10_SQL})").fetchall()}
    assert stated == got


def test_hosts_of_many_labels(spark):
    """A host with 50,000 labels takes no more room than its rules need."""
    long = "a." * 50_000
    rows = [(1, f"http://{long}example.com/en/7", "", None, None), (2, f"http://{long}net/de/1", "", None, None), (3, f"http://{long}/en/1", "", None, None), (4, "http://com/en/", "", None, None)]
    got = {r["page_id"]: r["rule"] for r in urls.judged_by_rules(spark.createDataFrame(rows, PAGES).select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")), urls.rules_table(spark), spark.createDataFrame([], "host string, common boolean")).collect()}
    assert got == {1: "example.com/en/7", 2: "net/de/", 3: None, 4: "com/en/"}


def test_distrust_flows_to_linking_hosts(spark):
    page = lambda k, h, to: (k, f"http://{h}/x", "".join(f'<a href="https://{t}/">' for t in to), None, None)
    rows = [page(1, "farm.test", ["bad.com"]), page(2, "good.test", ["fine.test"]), page(3, "fine.test", []), (4, "http://bad.com/en/1", "", None, None), page(5, "far.test", ["farm.test"])]
    got = {r["host"]: r for r in urls.judged(spark.createDataFrame(rows, PAGES), urls.rules_table(spark)).collect()}
    assert got["farm.test"]["distrust"] > 0 == got["good.test"]["distrust"] and got["fine.test"]["trust"] > 0
    assert got["good.test"]["verdict"] == "allow" and got["bad.com"]["verdict"] == "block"


def test_trust_starts_at_allowed_hosts(spark):
    """A host that a rule allows is the only seed of trust; what it links to is trusted, and others are not."""
    page = lambda k, h, to, path="x": (k, f"http://{h}/{path}", "".join(f'<a href="https://{t}/">' for t in to), None, None)
    rows = [page(1, "a.example.com", ["friend.test"], "en/7"), page(2, "friend.test", []), page(3, "alone.test", []), page(4, "b.com", [], "en/1")]
    got = {r["host"]: r for r in urls.judged(spark.createDataFrame(rows, PAGES), urls.rules_table(spark)).collect()}
    assert got["friend.test"]["trust"] > 0 == got["alone.test"]["trust"] and got["a.example.com"]["trust"] > 0
    assert got["alone.test"]["verdict"] == "allow"


def test_page_rank_against_matrices(spark):
    rng = np.random.default_rng(5)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(w, 0)
    edges = [(str(i), str(j), float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
    s = np.zeros((2, n))
    s[0, :3], s[1, 3:5] = 1 / 3, 1 / 2
    got = urls.spread(spark.createDataFrame(edges, "src string, dst string, n double"), spark.createDataFrame([(str(k), float(s[0, k]), float(s[1, k])) for k in range(n)], "host string, trust double, distrust double"), rounds=5)
    want = []
    for m, seed in ((w, s[0]), (w.T, s[1])):
        p, r = m / np.maximum(m.sum(1, keepdims=True), 1), seed.copy()
        for _ in range(5):
            r = 0.15 * seed + 0.85 * r @ p
        want.append(r)
    have = {x["host"]: (x["trust"], x["distrust"]) for x in got.collect()}
    for k in range(n):
        assert have.get(str(k), (0.0, 0.0)) == pytest.approx((want[0][k], want[1][k]))


def test_op10_has_no_python(spark):
    df = urls.op10_urls(spark, SF)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    empty = spark.createDataFrame([], PAGES)
    assert urls.judged(empty, urls.rules_table(spark)).count() == 0


def test_op5_has_no_python(spark):
    assert not re.search("Python|Arrow|Pandas", decontaminate.op5_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.op8_toxicity(spark, SF).where("predicted = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in toxic}
    least = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if least[i] == i}
    held = {r["doc_id"] for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    from tessera.llm import bpe, pii

    want = {i: pii.redacted(t, pii.find(t, pii.trained())[1]) for i, t in left.items() if i not in held}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    codec = bpe.Codec(bpe.read_ranks(spark, bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1])
    assert all(codec.decode(got[i]).decode() == t for i, t in want.items())


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__kept_id", F.lit("mine")).withColumn("score", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("score != 'mine' or __kept_id != 'mine'").count() == 0 and out.count() > 100
