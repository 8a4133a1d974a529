import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockspark.functions import exprs as X


def _one(spark, cols, schema, row):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_critical_bound_is_decimal(spark):
    # 0.90 <= 3.00 * 0.3 is true in decimal, false in double
    r = _one(spark, [X.stock_class().alias("c"), X.alert_class().alias("a"),
                     X.alert_level_strict("current_stock", "min_stock_level").alias("s")],
             "current_stock decimal(12,2), min_stock_level decimal(12,2)",
             (Decimal("0.90"), Decimal("3.00")))
    assert r.c == "Critical" and r.a == "CRITICAL"
    assert r.s == "LOW"          # the alert path uses a strict bound


def test_zero_minimum(spark):
    r = _one(spark, [X.is_low().alias("low"), X.is_critical().alias("crit"),
                     X.urgency_ratio().alias("ratio"), X.coverage_pct().alias("cov")],
             "current_stock decimal(12,2), min_stock_level decimal(12,2)",
             (Decimal("0"), Decimal("0")))
    assert r.low and r.crit and r.ratio is None and r.cov == 100.0


def test_number_grows_past_9999(spark):
    r = _one(spark, [X.formatted_number(F.lit("TXN"), F.col("n")).alias("x")], "n long", (10000,))
    assert r.x == "TXN-10000"
    r = _one(spark, [X.number_seq(F.lit("ISS-2024-0042")).alias("x")], "n long", (1,))
    assert r.x == 42


def test_labels_default_to_capitalised_code(spark):
    r = _one(spark, [X.status_label("s").alias("a"), X.role_label("r").alias("b"),
                     X.action_severity("x").alias("c")],
             "s string, r string, x string", ("partially_issued", "auditor", "DELETE"))
    assert (r.a, r.b, r.c) == ("Partial", "Auditor", "gray")


def test_time_ago_ladder(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [(now - dt.timedelta(seconds=s),) for s in (30, 600, 7200, 3 * 86400, 9 * 86400)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r.x for r in df.select(X.time_ago("ts", X.lit_value(now)).alias("x")).collect()]
    assert got == ["just now", "10 mins ago", "2 hours ago", "3 days ago", "22 Jan 2024"]


def test_initials_and_half_up_format(spark):
    r = _one(spark, [X.initials("n").alias("i"), X.thousands("v", 0).alias("f")],
             "n string, v double", ("ravi kumar singh", 2.5))
    assert r.i == "RK" and r.f == "3"
