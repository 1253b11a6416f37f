"""No plan joins row by row, but with a row of totals or an axis's few tiles."""

from __future__ import annotations

import re

import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose nested loop has one row (totals, medians, percentiles, or what is known of the one raster, whose id is a constant) or the
#: few tiles of an axis on one side.
ONE_ROW = {
    "active_cells", "capped_drift", "clahe_scene", "cluster_count", "drift_filter", "event_stream_retention", "fixed_grid", "job_listing", "mad_inliers", "minmax_norm", "override_counts", "percentile_stretch", "percentile_stretch_all", "phase_congruency_scene", "registration_report",
    "residual_stats", "search_window", "shadow_mask", "sobel_gradient", "spatial_entropy", "stratified_consensus", "structural_scene", "tile_grid", "tps_cv", "unsharp_scene", "window_crop",
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES)))
def test_nested_loops_are_with_one_row(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if re.search("NestedLoop", plan):
        assert name in ONE_ROW
