"""Tiles go through pandas a few at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import scenes as S
from tessera.operators.tiles import tiles_of


def test_tasks_hold_few_tiles(spark):
    """However many tiles an Arrow batch has, f gets HELD of them, each once and in its types."""
    image = np.arange(100 * 16, dtype="<i4").reshape(400, 4)
    tiles = tiles_of(spark, "a", image, 4).coalesce(1)

    def sizes(pdfs):
        for pdf in pdfs:
            yield pdf[["row_off"]].assign(n=len(pdf))

    rows = S.few_at_once(tiles, sizes, "row_off int, n long").collect()
    assert sorted(r["row_off"] for r in rows) == list(range(0, 400, 4)) and max(r["n"] for r in rows) == S.HELD
    known = S.each_tile(tiles.withColumns({"k": F.when(F.col("row_off") > 40, F.lit(2).cast("long")), "q": F.array(F.lit(1.0))}), lambda a, k, q: a * 0 + (-1 if k is None or k != k else int(k)) + q[0], "k", "q")
    assert {(r["row_off"] > 40, np.frombuffer(r["px"], r["dtype"])[0]) for r in known.collect()} == {(False, 0.0), (True, 3.0)}


@pytest.mark.parametrize(("size", "padded"), [(60, 64), (64, 64), (5, 8), (61, 64)])
def test_mirrored_places_of_a_tile(size, padded):
    """As among all places of the raster, of which a tile makes its own and those beyond the border only."""
    source = K._folded(np.arange(padded), size)
    for first in range(0, size, 4):
        end = min(size, first + 4)
        place, own = S._mirrored(first, end, size, padded)
        want = np.flatnonzero((source >= first) & (source < end))
        assert place.tolist() == want.tolist() and own.tolist() == (source[want] - first).tolist()
