import datetime as dt
import os
import tempfile
from decimal import Decimal

from stockspark.plans import exports as EX
from stockspark.sources import sinks


def test_append_ledger_partitions_by_month(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ledger-"), "stock_transactions")
    rows = [(1, dt.datetime(2024, 1, 5), Decimal("3.00")), (2, dt.datetime(2024, 2, 1), Decimal("1.50"))]
    df = spark.createDataFrame(rows, "product_id long, created_at timestamp_ntz, quantity decimal(12,2)")
    sinks.append_ledger(df, d, "a")
    sinks.append_ledger(df, d, "b")                  # append, not overwrite
    for batch in ("a", "b"):
        assert sorted(x for x in os.listdir(os.path.join(d, "rows", f"commit=b-{batch}")) if x.startswith("txn_month=")) == [
            "txn_month=2024-01", "txn_month=2024-02"]
    back = sinks.read_ledger(spark, d)
    assert back.count() == 4
    assert back.filter("txn_month = '2024-02'").count() == 2


def test_csv_export_with_manifest(spark, views):
    from stockspark.operators.dims import export_manifest
    from stockspark.params import DEFAULT
    rows, audit = EX.export(views, DEFAULT, "category_stock")
    man = export_manifest({"category_stock": rows}, EX.TITLES, DEFAULT.date_from, DEFAULT.date_to)
    d = tempfile.mkdtemp(prefix="export-")
    sinks.write_csv(rows, d, man)
    back = spark.read.option("header", True).csv(os.path.join(d, "rows"))
    m = spark.read.option("header", True).csv(os.path.join(d, "manifest")).first()
    assert back.count() == int(m.total_records) == rows.count()
    assert m.title == "Category-wise Stock Report"
    assert audit.first().action == "EXPORT"


def test_unknown_export_type_is_rejected(views):
    import pytest
    from stockspark.params import DEFAULT
    with pytest.raises(ValueError):
        EX.export(views, DEFAULT, "everything")


def test_export_is_logged_once(spark, views):
    from stockspark.params import DEFAULT
    from stockspark.sources.commits import CommitLog
    d = tempfile.mkdtemp(prefix="export-")
    for want in (True, False):
        assert EX.run_export(views, DEFAULT, "stock_summary", f"{d}/csv", f"{d}/audit", "e1") is want
    assert EX.run_export(views, DEFAULT, "stock_summary", f"{d}/csv2", f"{d}/audit", "e2")
    got = CommitLog(spark, f"{d}/audit").get("rows").collect()
    assert [(r.action, "stock_summary" in r.details) for r in got] == [("EXPORT", True)] * 2
    assert spark.read.option("header", True).csv(f"{d}/csv/rows").count() > 0
