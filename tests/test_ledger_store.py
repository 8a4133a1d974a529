"""The stored ledger against a sequential fold: batches in any order, repeated and failed appends."""
import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import fold
from stockspark.operators import ledger as L
from stockspark.operators.ledger_store import LedgerStore
from stockspark.sources import sinks
from stockspark.sources.commits import CommitLog

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, type string, "
          "signed_qty decimal(12,2)")


def movements(rng, n, products=12, hot=0.35):
    """n movements in time order over a few months; product 1 holds a third of them."""
    out = []
    for i in range(n):
        p = 1 if rng.random() < hot else rng.randrange(2, products)
        q = rng.choice([5, 3, 8, -4, -6, -9, 1])
        out.append((p, T0 + dt.timedelta(hours=3 * i), i, 1, "x", Decimal(q)))
    return out


def want(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        by.setdefault(r[0], []).append(r)
    out = {}
    for p, rs in by.items():
        for r, (before, after, ok) in zip(rs, fold([r[5] for r in rs])):
            out[p, r[2]] = (before, after, ok)
    return out


def got(store):
    return {(r.product_id, r.ord_key): (r.balance_before, r.balance_after, r.accepted) for r in store.rows().collect()}


def last(rows):
    after = want(rows)
    return {r[0]: after[r[0], r[2]][1] for r in sorted(rows, key=lambda r: r[1:4])}


def fresh(spark):
    return LedgerStore(spark, tempfile.mkdtemp(prefix="ledger-store-"))


def check(store, rows):
    assert got(store) == want(rows)
    assert {r.product_id: r.current_stock for r in store.snapshot().collect()} == last(rows)


def test_batches_in_order_touch_new_rows_only(spark):
    rng = random.Random(1)
    rows = movements(rng, 200)
    store = fresh(spark)
    for k in range(2):
        assert store.append(spark.createDataFrame(rows[k * 100:(k + 1) * 100], SCHEMA), f"b{k}")
    check(store, rows)
    # every chunk is live, each batch holds its own rows
    per = {r["batch"]: r["n"] for r in store.log.get("rows").groupBy(F.col("commit").alias("batch"))
           .agg(F.count("*").alias("n")).collect()}
    assert per == {f"b-b{k}": 100 for k in range(2)}


def test_batches_in_any_order(spark):
    rng = random.Random(2)
    rows = movements(rng, 300, products=6)
    cut = sorted(rng.sample(range(300), 2))
    parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, 300])]
    mixed = [rows[i] for i in rng.sample(range(300), 60)]
    parts = [[r for r in p if r not in mixed] for p in parts] + [mixed]
    rng.shuffle(parts)
    store = fresh(spark)
    seen = []
    for k, p in enumerate(parts):
        store.append(spark.createDataFrame(p, SCHEMA), str(k))
        seen += p
    check(store, rows)
    assert len(seen) == len(rows)


def test_index_bases_hold_the_live_entries(spark):
    rows = movements(random.Random(9), 150, products=5)
    parts = [rows[:50], rows[100:], rows[50:100], rows[:0]]
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ledger-store-"), base_after=2)
    for k, p in enumerate(parts):
        store.append(spark.createDataFrame(p, SCHEMA), str(k))
    assert len(store.bases.batches()) == 2
    check(store, rows)
    assert store.index().groupBy("product_id", "batch", "part", "chunk").count().where("count > 1").isEmpty()


def test_late_rows_move_clean_chunks_without_rewriting(spark):
    """A late receipt raises all later balances; chunks that refuse nothing get new starts only."""
    day = lambda d: T0 + dt.timedelta(days=d)
    first = [(1, day(0), 0, 1, "x", Decimal(50)), (2, day(0), 1, 1, "x", Decimal(5))]
    second = [(1, day(40), 2, 1, "x", Decimal(-10)), (2, day(40), 3, 1, "x", Decimal(-9))]
    third = [(1, day(80), 4, 1, "x", Decimal(-20)), (2, day(80), 5, 1, "x", Decimal(-1))]
    late = [(1, day(20), 6, 1, "x", Decimal(7)), (2, day(20), 7, 1, "x", Decimal(6))]
    store = fresh(spark)
    for k, p in enumerate((first, second, third, late)):
        store.append(spark.createDataFrame(p, SCHEMA), str(k))
    check(store, first + second + third + late)
    written = store.log.get("rows", ["3"])
    # product 2's refused row is accepted now, so its chunks are folded again; product 1's are not
    assert sorted(r.ord_key for r in written.collect()) in ([6, 7], [3, 5, 6, 7])
    assert 2 not in {r.ord_key for r in written.collect()}


def test_repeated_and_failed_appends(spark):
    rows = movements(random.Random(4), 120)
    a, b = (spark.createDataFrame(p, SCHEMA) for p in (rows[:60], rows[60:]))
    store = fresh(spark)
    assert store.append(a, "a") and not store.append(a, "a")
    commit, CommitLog.commit = CommitLog.commit, lambda self, batch: 1 / 0        # dies before the marker
    try:
        with pytest.raises(ZeroDivisionError):
            store.append(b, "b")
    finally:
        CommitLog.commit = commit
    check(store, rows[:60])
    assert store.append(b, "b")
    check(LedgerStore(spark, store.log.path), rows)
    assert store.append(b.limit(0), "nothing")
    check(store, rows)


def test_months_of_a_date_range(spark):
    rows = movements(random.Random(5), 300)
    store = fresh(spark)
    store.append(spark.createDataFrame(rows, SCHEMA), "all")
    some = store.rows("2024-02-01", "2024-02-29")
    assert "txn_month" in some._jdf.queryExecution().executedPlan().toString()
    keys = {r.ord_key for r in some.collect()}
    assert keys == {r[2] for r in rows if r[1].month == 2}
    assert L.reconcile(store.rows()).count() == 0


def test_append_of_monthly_files_is_idempotent(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ledger-"), "rows")
    df = spark.createDataFrame(movements(random.Random(6), 500), SCHEMA)
    assert sinks.read_ledger(spark, d) is None
    assert sinks.append_ledger(df, d, "2024/1") and not sinks.append_ledger(df, d, "2024/1")
    assert sinks.append_ledger(df.limit(5), d, "7")
    back = sinks.read_ledger(spark, d)
    assert back.count() == 505
    assert back.where("txn_month = '2024-02'").count() == df.where("month(created_at) = 2").count() + \
        df.limit(5).where("month(created_at) = 2").count()


def test_a_hot_month_is_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 100)
    rows = [(k % 3, T0 + dt.timedelta(minutes=k), k, 1, "x", Decimal(1)) for k in range(1000)]
    d = tempfile.mkdtemp(prefix="ledger-hot-")
    sinks.append_ledger(spark.createDataFrame(rows, SCHEMA), d, "a")
    files = sinks.read_ledger(spark, d).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) >= 8 and max(r["count"] for r in files) <= 250
