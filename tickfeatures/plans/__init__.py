"""Composite plans: the feature builder, query catalogue and oracle SQL."""
