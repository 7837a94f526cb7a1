"""tickfeatures: keyed price time series -> feature tables, statistics and models on Spark."""

from .plans.features import build_features, build_features_all
from .sources.ticks import load_event_ticks, read_ticks_json, ticks_from_events

__all__ = ["build_features", "build_features_all", "load_event_ticks", "read_ticks_json", "ticks_from_events"]
