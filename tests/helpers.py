import datetime as dt

from tickfeatures.schemas import TICKS

BASE = dt.datetime(2024, 1, 1)  # a Monday


def ticks(spark, rows):
    """rows: (zone, instance, datetime, price)."""
    return spark.createDataFrame(rows, TICKS)


def hourly(zone, instance, start, prices, step_hours=1):
    return [(zone, instance, start + dt.timedelta(hours=i * step_hours), p) for i, p in enumerate(prices)]
