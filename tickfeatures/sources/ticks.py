"""Tick sources: raw JSON-lines price history and the test-table adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TICK_JSON

TICK_COLUMNS = ("zone", "instance", "ts", "spot_price")

# Fixed values of the test-table adapter: how rows of the ``events`` table
# stand in for price ticks (event type -> zone, user id mod 3 -> instance,
# value / 400 -> price).
EVENT_ZONES = (
    ("click", "eu-west-1a"),
    ("view", "eu-west-1b"),
    ("purchase", "us-west-2a"),
    ("signup", "us-west-2b"),
    ("error", "ap-southeast-1a"),
)
USER_INSTANCES = ("m1.medium", "c3.large", "g2.2xlarge")
PRICE_DIVISOR = 400.0


def read_ticks_json(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-lines ticks with an explicit schema and normalise them."""
    return normalize_raw_ticks(spark.read.schema(TICK_JSON).json(path))


def write_ticks_json(ticks: DataFrame, path: str) -> None:
    """Write normalised ticks as JSON lines in the source format (ISO text time, text price)."""
    ticks.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("TimeStamp"),
        F.col("spot_price").cast("string").alias("SpotPrice"),
        F.col("zone").alias("AvailabilityZone"),
        F.col("instance").alias("InstanceType"),
    ).write.mode("overwrite").json(path)


def _instant(text: Column) -> Column:
    """ISO time text as a UTC timestamp without zone, to the second. An offset at the end
    (``+02:00``, ``-0530``) is taken off; ``Z`` or no offset is UTC. Null if unreadable."""
    local = F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    part = lambda i: F.coalesce(F.regexp_extract(F.substring(text, 20, 40), r"([+-])(\d{2}):?(\d{2})$", i).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(F.substring(text, 20, 40), r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    return local - F.make_dt_interval(F.lit(0), sign * part(2), sign * part(3), F.lit(0))


def _typed_columns(of: str = "") -> list[Column]:
    """zone, instance, ts and spot_price from the text columns of a struct or frame."""
    return [
        F.col(f"{of}AvailabilityZone"),
        F.col(f"{of}InstanceType"),
        _instant(F.col(f"{of}TimeStamp")),
        F.col(f"{of}SpotPrice").try_cast("double"),
    ]


def normalize_raw_ticks(raw: DataFrame) -> DataFrame:
    """(TimeStamp, SpotPrice, AvailabilityZone, InstanceType) text -> typed ticks.

    Unparseable prices or timestamps become null instead of failing the job; offsets in
    TimeStamp are honoured.
    """
    return raw.select(*[e.alias(c) for c, e in zip(TICK_COLUMNS, _typed_columns(), strict=True)])


def checked_ticks(lines: DataFrame) -> DataFrame:
    """``zone, instance, ts, spot_price, reason, line`` of JSON lines (column ``value``).

    ``reason`` is null for a usable tick, else the first of: ``malformed`` (no JSON object),
    ``series`` (no zone or instance type), ``time``, ``price``. Blank lines are no rows.
    Nothing is lost: a rejected line comes with its text."""
    schema = T.StructType([*TICK_JSON.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("j"))
    made = dict(zip(TICK_COLUMNS, _typed_columns("j."), strict=True))
    reason = (
        F.when(F.col("j").isNull() | F.col("j._broken").isNotNull(), "malformed")
        .when(made["zone"].isNull() | made["instance"].isNull(), "series")
        .when(made["ts"].isNull(), "time")
        .when(made["spot_price"].isNull() | F.isnan(made["spot_price"]), "price")
    )
    return parsed.select(*[e.alias(c) for c, e in made.items()], reason.alias("reason"), F.col("value").alias("line"))


def read_ticks_checked(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines ticks with the reason of every rejected line (see ``checked_ticks``)."""
    return checked_ticks(spark.read.text(path))


def write_checked_ticks(checked: DataFrame, path: str) -> dict[str, int]:
    """Write usable ticks (folder ``kind=ok``) and rejected lines (a folder per reason) in one
    scan of the lines. Returns the number of rows by kind, observed during that write."""
    from pyspark.sql import Observation

    kinds = ("ok", "malformed", "series", "time", "price")
    kind = F.coalesce("reason", F.lit("ok"))
    seen = Observation()
    rows = checked.observe(seen, *[F.count_if(kind == k).alias(k) for k in kinds])
    rows = rows.select("zone", "instance", "ts", "spot_price", F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), kind.alias("kind"))
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return {k: seen.get[k] for k in kinds}


def _lookup(key: Column, pairs) -> Column:
    expr = None
    for k, v in pairs:
        expr = (F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v)))
    return expr


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Map the ``events`` test table onto ticks (zone, instance, ts, spot_price)."""
    return events.select(
        _lookup(F.col("event_type"), EVENT_ZONES).alias("zone"),
        _lookup(F.pmod(F.col("user_id"), F.lit(3)), list(enumerate(USER_INSTANCES))).alias("instance"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("value") / F.lit(PRICE_DIVISOR)).alias("spot_price"),
    )


# Columns of the ``events`` test table that the adapter reads (an explicit schema
# skips footer inference and reads only these columns).
EVENTS_READ_SCHEMA = "ts timestamp_ntz, user_id bigint, event_type string, value double"


def load_event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(spark.read.schema(EVENTS_READ_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def sql_ticks_from_events(table: str = "events") -> str:
    """The adapter as SQL text (for the DuckDB oracle)."""
    zone = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in EVENT_ZONES)
    inst = " ".join(f"WHEN ((user_id % 3) + 3) % 3 = {i} THEN '{v}'" for i, v in enumerate(USER_INSTANCES))
    return (
        f"SELECT CASE {zone} END AS zone, CASE {inst} END AS instance, "
        f"CAST(ts AS TIMESTAMP) AS ts, value / {PRICE_DIVISOR} AS spot_price FROM {table}"
    )
