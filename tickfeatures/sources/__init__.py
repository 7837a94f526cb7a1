"""Sources and sinks: tick readers and feature-table storage."""

from .ticks import load_event_ticks, normalize_raw_ticks, read_ticks_json, ticks_from_events

__all__ = ["load_event_ticks", "normalize_raw_ticks", "read_ticks_json", "ticks_from_events"]
