"""A Spark-native engine for raster correspondence analytics: tiles, tie points, footprints and job telemetry as DataFrames."""
