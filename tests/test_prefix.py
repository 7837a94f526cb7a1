"""Prefix sums, AUC, correlations, bounded distinct, purged split, tick rejects against plain Python."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tickfeatures.ml.evaluate import auc
from tickfeatures.ml.prepare import label_index_table
from tickfeatures.operators.prefix import numbered, prefix_sums
from tickfeatures.operators.quality import schema_report
from tickfeatures.operators.split import with_purged_split
from tickfeatures.operators.stats import bounded_distinct, pearson_matrix
from tickfeatures.schemas import FEATURES
from tickfeatures.sources.ticks import checked_ticks, read_ticks_checked, write_checked_ticks


def test_prefix_sums_per_group(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(-5, 9)) for i in r.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(x["g"], x["o"]): x["s"] for x in prefix_sums(df, ["o"], {"s": F.col("v")}, ["g"]).collect()}
    for g in ("a", "b", None):
        total = 0
        for o, v in sorted((o, v) for x, o, v in rows if x == g):
            assert got[g, o] == total
            total += v
    assert prefix_sums(df.limit(0), ["o"], {"s": F.col("v")}).collect() == []


def single_partitions(df):
    """Exchanges to one partition; that of the totals (one row per partition) stands over an aggregate."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert all("HashAggregate" in lines[i + 1] or "_v0_" in lines[i + 1] for i in at)
    return len(at)


def test_numbered_spreads_one_group(spark):
    df = spark.range(20_000).withColumn("_part", F.lit("x"))
    out = numbered(df, [F.desc("id")])
    assert out.columns == ["id", "_part", "place"] and out.where("place <> 20000 - id").count() == 0
    assert single_partitions(out) <= 1


def test_label_index_has_no_unpartitioned_window(spark):
    df = spark.createDataFrame([(x,) for x in "aabbbccdz"], "y string")
    out = label_index_table(df, "y")
    assert [(r["label"], r["label_index"]) for r in out.orderBy("label_index").collect()] == [("b", 0.0), ("a", 1.0), ("c", 2.0), ("d", 3.0), ("z", 4.0)]
    assert single_partitions(out) <= 1


def test_auc_by_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(12) / 4, float(r.random() < 0.4)) for _ in range(400)]
    got = {x["g"]: x["auc"] for x in auc(spark.createDataFrame(rows, "g string, s double, y double"), "s", "y", ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for k, s, y in rows if k == g and y == want] for want in (1.0, 0.0))
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg), abs=1e-12)


def test_correlations_with_many_null_patterns(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        x = r.gauss(1e6, 3)
        row = [x, 2 * x + r.gauss(0, 5), r.gauss(0, 1), 7.0]
        rows.append(tuple(None if r.random() < 0.25 else math.nan if r.random() < 0.05 else v for v in row))
    names = ["a", "b", "c", "d"]
    got = {(x["feat1"], x["feat2"]): x["corr"] for x in pearson_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), names).collect()}
    known = lambda v: v is not None and not math.isnan(v)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = [(x[i], x[j]) for x in rows if known(x[i]) and known(x[j])]
            mx, my = (sum(v) / len(both) for v in zip(*both))
            xx, yy, xy = (sum(u * v for u, v in s) for s in ([(x - mx,) * 2 for x, _ in both], [(y - my,) * 2 for _, y in both], [(x - mx, y - my) for x, y in both]))
            if min(xx, yy) < 1e-9:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(xy / math.sqrt(xx * yy), abs=1e-9)
    assert {x["corr"] for x in pearson_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()} == {None}


def test_bounded_distinct(spark):
    rows = [(i % 4, i % 5, None, float("nan") if i % 2 else 3.0, i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d double, e int")
    got = sorted(tuple(r) for r in bounded_distinct(df, ["a", "b", "c", "d", "e"], 4).collect())
    assert got == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("d", 3.0)]


def test_purged_split_shares_no_price(spark):
    rows = [(z, "i", 60 * k) for z, n in (("a", 100), ("b", 37), ("c", 5)) for k in range(n)]
    got = with_purged_split(spark.createDataFrame(rows, "zone string, instance string, bucket_epoch bigint")).collect()
    for z in "ab":
        parts = [r["part"] for r in sorted((r for r in got if r["zone"] == z), key=lambda r: r["bucket_epoch"])]
        used = {p: {q for k, x in enumerate(parts) if x == p for q in range(k - 3, k + 2)} for p in ("train", "validation", "test")}
        assert all(used.values()) and not used["train"] & used["validation"] and not used["validation"] & used["test"]
    assert len(got) == len(rows)


FAULTS = [
    ('{"TimeStamp": "2016-02-12T05:01:00+02:00", "SpotPrice": "0.5", "AvailabilityZone": "z", "InstanceType": "i"}', None, dt.datetime(2016, 2, 12, 3, 1)),
    ('{"TimeStamp": "2016-02-12T23:01:59.250-0530", "SpotPrice": 0.5, "AvailabilityZone": "z", "InstanceType": "i", "more": 1}', None, dt.datetime(2016, 2, 13, 4, 31, 59)),
    ('{"TimeStamp": "2016-02-12T05:01:00.000Z", "SpotPrice": "0.5", "AvailabilityZone": "z", "InstanceType": "i"}', None, dt.datetime(2016, 2, 12, 5, 1)),
    ('{"TimeStamp": "2016-02-12T05:01:00", "SpotPrice": "x", "AvailabilityZone": "z", "InstanceType": "i"}', "price", dt.datetime(2016, 2, 12, 5, 1)),
    ('{"TimeStamp": "soon", "SpotPrice": "0.5", "AvailabilityZone": "z", "InstanceType": "i"}', "time", None),
    ('{"TimeStamp": "soon", "SpotPrice": "0.5", "AvailabilityZone": "z"}', "series", None),
    ('{"TimeStamp": "2016-02-12T05:01:00", "SpotPr', "malformed", None),
    ("not json", "malformed", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_rejected_lines(spark, zone, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        lines = spark.createDataFrame([(x,) for x, *_ in FAULTS] + [("",), ("  ",)], "value string")
        got = {r["line"]: r for r in checked_ticks(lines).collect()}
        assert set(got) == {x for x, *_ in FAULTS}
        for line, reason, ts in FAULTS:
            assert got[line]["reason"] == reason and (ts is None or got[line]["ts"] == ts), line
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_checked_lines_are_written_once_and_counted(spark, tmp_path):
    source = tmp_path / "lines.json"
    source.write_text("\n".join([x for x, *_ in FAULTS] * 3) + "\n\n")
    counts = write_checked_ticks(read_ticks_checked(spark, str(source)), str(tmp_path / "out"))
    assert counts == {"ok": 9, "malformed": 6, "series": 3, "time": 3, "price": 3}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("kind = 'ok'").count() == 9 and out.where("kind = 'ok' AND line IS NOT NULL").count() == 0
    assert all(json.loads(r["line"]) for r in out.where("kind = 'price'").collect())


def test_schema_report(spark):
    df = spark.createDataFrame([], FEATURES).withColumn("hour", F.col("hour").cast("bigint")).drop("slot").withColumn("extra", F.lit(1))
    bad = {r["column"]: (r["expected"], r["found"]) for r in schema_report(df, FEATURES).where("ok = 0").collect()}
    assert bad == {"hour": ("int", "bigint"), "slot": ("int", None), "extra": (None, "int")}
