from __future__ import annotations

import pytest

from tessera.llm import urls


def chain(spark):
    edges = [(f"h{k}", f"h{k - 1}", 1.0) for k in range(1, 12)]
    seeds = [("h0", 0.0, 1.0)] + [(f"t{k}", 1 / 211, 0.0) for k in range(211)]
    return spark.createDataFrame(edges, "src string, dst string, n double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")


def test_distrust_reaches_the_whole_chain(spark):
    got = {r["host"]: r["distrust"] for r in urls.spread(*chain(spark)).collect()}
    want = [0.15 * 0.85**k for k in range(12)]
    assert [got[f"h{k}"] for k in range(12)] == pytest.approx(want, rel=1e-3)


def test_unsettled_ranks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_ROUNDS", 4)
    with pytest.raises(RuntimeError):
        urls.spread(*chain(spark))
