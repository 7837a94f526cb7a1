"""DataFrame operators: resample, sequence shifts, daily statistics, statistics, quality checks, splits."""
