"""The feature pipeline as plain SQL text, for an independent engine (DuckDB) to check.

Each builder returns CTE text over the pre-registered ``events`` view; the
final SELECTs in ``catalog.py`` round doubles exactly like ``stable_round``.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.calendar import LAST_WEEKDAY, NIGHT_LAST_HOUR, WORK_WINDOWS
from ..functions.check import sql_round
from ..schemas import EPSILON, FEATURE_COLUMNS, FEATURES, PRICE_CAPS
from ..sources.ticks import sql_ticks_from_events


def r(expr: str, alias: str | None = None) -> str:
    """Rounded double column."""
    return f"{sql_round(expr)} AS {alias or expr}"


def select_list(columns: Sequence[str], doubles: Sequence[str] = ()) -> str:
    ds = set(doubles)
    return ", ".join(r(c) if c in ds else c for c in columns)


FEATURE_DOUBLES = [f.name for f in FEATURES.fields if f.dataType.simpleString() == "double"]


def feature_select(prefix: Sequence[str] = ()) -> str:
    return select_list([*prefix, *FEATURE_COLUMNS], FEATURE_DOUBLES)


def _caps_values(caps: Sequence[tuple[str, str, float]] = PRICE_CAPS) -> str:
    return ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in caps)


def ctes(intervals: Sequence[int], eps: float = EPSILON, upto: str = "ft") -> str:
    """CTE chain: ticks, res, bk, lg, ch, ld, dl, pd, ft (stop after ``upto``)."""
    parts = [("ticks", sql_ticks_from_events())]
    res = " UNION ALL ".join(
        f"SELECT {i} AS interval_min, zone, instance, "
        f"e - (((e % {i * 60}) + {i * 60}) % {i * 60}) AS bucket_epoch, spot_price "
        f"FROM (SELECT zone, instance, CAST(floor(epoch(ts)) AS BIGINT) AS e, spot_price FROM ticks WHERE ts IS NOT NULL)"
        for i in intervals
    )
    parts.append(("res", f"SELECT interval_min, zone, instance, bucket_epoch, avg(spot_price) AS spot_price "
                         f"FROM ({res}) GROUP BY interval_min, zone, instance, bucket_epoch"))
    work = ", ".join(f"CAST(hour BETWEEN {lo} AND {hi} AS INTEGER) AS {n}" for n, (lo, hi) in WORK_WINDOWS.items())
    parts.append(("cal", (
        "SELECT *, DATE '1970-01-01' + CAST(floor(bucket_epoch / 86400) AS INTEGER) AS date, "
        "make_timestamp(bucket_epoch * 1000000) AS bucket_ts, "
        "CAST(floor((((bucket_epoch % 86400) + 86400) % 86400) / 3600) AS INTEGER) AS hour, "
        "CAST(floor((((bucket_epoch % 3600) + 3600) % 3600) / (interval_min * 60)) + 1 AS INTEGER) AS slot, "
        "CAST((((CAST(floor(bucket_epoch / 86400) AS BIGINT) + 3) % 7) + 7) % 7 + 1 AS INTEGER) AS iso_dow "
        "FROM res")))
    parts.append(("bk", (
        f"SELECT c.*, CAST(c.iso_dow <= {LAST_WEEKDAY} AS INTEGER) AS is_weekday, {work}, "
        f"CAST(c.hour <= {NIGHT_LAST_HOUR} AS INTEGER) AS is_night, "
        f"caps.cap AS cap, CAST(c.spot_price >= caps.cap AS INTEGER) AS is_irrational "
        f"FROM cal c LEFT JOIN (VALUES {_caps_values()}) caps(region, instance, cap) "
        f"ON substr(c.zone, 1, length(c.zone) - 1) = caps.region AND c.instance = caps.instance")))
    w = "OVER (PARTITION BY interval_min, zone, instance ORDER BY bucket_epoch)"
    parts.append(("lg", (
        f"SELECT *, lag(spot_price, 1) {w} AS lag_1, lag(spot_price, 2) {w} AS lag_2, "
        f"lag(spot_price, 3) {w} AS lag_3 FROM bk")))
    parts.append(("ch", (
        "SELECT *, spot_price - lag_1 AS price_change, lag_1 - lag_2 AS price_change_lag1, "
        "lag_2 - lag_3 AS price_change_lag2, "
        f"(spot_price - lag_1) >= {eps} AS inc_t, (spot_price - lag_1) <= {-eps} AS dec_t, "
        f"((spot_price - lag_1) > {-eps} AND (spot_price - lag_1) < {eps}) AS same_t "
        "FROM lg WHERE spot_price IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL")))
    parts.append(("ld0", (
        f"SELECT *, CAST(lead(inc_t, 1) {w} AS DOUBLE) AS y_increase, "
        f"CAST(lead(dec_t, 1) {w} AS DOUBLE) AS y_decrease, "
        f"CAST(lead(same_t, 1) {w} AS DOUBLE) AS y_same, lead(spot_price, 1) {w} AS y_future_price FROM ch")))
    parts.append(("ld", (
        "SELECT *, CAST(CASE WHEN y_increase > 0 THEN 2 WHEN y_same > 0 THEN 1 WHEN y_decrease > 0 THEN 0 "
        "ELSE 3 END AS DOUBLE) AS y_direction FROM ld0 "
        "WHERE y_increase IS NOT NULL AND y_decrease IS NOT NULL AND y_same IS NOT NULL "
        "AND y_future_price IS NOT NULL")))
    parts.append(("dl", (
        "SELECT interval_min, zone, instance, date, avg(spot_price) AS prev_day_avg_price, "
        "max(spot_price) AS prev_day_max_price, min(spot_price) AS prev_day_min_price, "
        "avg(price_change) AS prev_day_avg_change, max(price_change) AS prev_day_max_change, "
        "min(price_change) AS prev_day_min_change, stddev_samp(price_change) AS prev_day_std_change "
        "FROM ld GROUP BY interval_min, zone, instance, date")))
    parts.append(("pd", (
        "SELECT ld.*, d.prev_day_avg_price, d.prev_day_max_price, d.prev_day_min_price, d.prev_day_avg_change, "
        "d.prev_day_max_change, d.prev_day_min_change, d.prev_day_std_change, "
        "ld.spot_price - d.prev_day_avg_price AS diff_mean_price, "
        "abs(ld.price_change - d.prev_day_avg_change) AS abs_diff_mean_change "
        "FROM ld JOIN (SELECT * REPLACE (date + 1 AS date) FROM dl) d "
        "ON ld.interval_min = d.interval_min AND ld.zone = d.zone AND ld.instance = d.instance AND ld.date = d.date")))
    parts.append(("ft0", (
        "SELECT * REPLACE (coalesce(prev_day_std_change, "
        "avg(prev_day_std_change) OVER (PARTITION BY interval_min)) AS prev_day_std_change) FROM pd")))
    parts.append(("ft", "SELECT *, CAST(price_change > prev_day_std_change * 2.0 AS INTEGER) AS is_volatile FROM ft0"))
    names = [n for n, _ in parts]
    keep = parts[: names.index(upto) + 1]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in keep)


def feature_table_sql(interval: int) -> str:
    return f"{ctes([interval])}\nSELECT {feature_select()} FROM ft"


def feature_table_all_sql(intervals: Sequence[int]) -> str:
    return f"{ctes(intervals)}\nSELECT {feature_select(['interval_min'])} FROM ft"
