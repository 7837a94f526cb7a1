"""Spark ML: preparation, evaluation, model grids and per-series campaigns."""
