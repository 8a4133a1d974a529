"""The stored ledger sends and writes its rows once, and reads what was not changed as it was written."""

import datetime as dt
import tempfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from helpers import fold
from stockspark.operators import ledger as L
from stockspark.operators.ledger_store import LedgerStore

T0 = dt.datetime(2024, 1, 1)
MOVES = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
         "type string, quantity decimal(12,2), signed_qty decimal(12,2)")


def moves(spark, keys, products=9):
    signed = {i: (i * 5) % 11 - 5 for i in range(40)}
    rows = [(p, T0 + dt.timedelta(days=3 * i), i, 1, "x", D(abs(signed[i])), D(signed[i])) for p in range(products) for i in keys]
    return spark.createDataFrame(rows, MOVES), {i: D(q) for i, q in signed.items()}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_in_order_are_read_as_written_and_sent_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(L, "_keep", lambda df, reliable, keep=L._keep: kept.append(df) or keep(df, reliable))
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ledger-store-"))
    for name, keys in (("a", range(20)), ("b", range(20, 40))):
        df, signed = moves(spark, keys)
        store.append(df.repartition(2), name)
    rows = store.rows()
    assert not kept and "Join" not in plan(rows)
    want = {i: w[1:] for i, w in enumerate(fold([signed[i] for i in range(40)]))}
    assert {(r.product_id, r.ord_key): (r.balance_after, r.accepted) for r in rows.collect()} == {
        (p, i): want[i] for p in range(9) for i in range(40)}


def test_a_part_that_was_folded_anew_is_not_read_again(spark):
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ledger-store-"))
    for name, keys in (("a", range(0, 40, 2)), ("b", range(1, 40, 2))):
        df, signed = moves(spark, keys)
        store.append(df, name)
    rows = store.rows()
    assert "Join" not in plan(rows) and all("b-b" in f for f in rows.inputFiles())
    want = {i: w[1] for i, w in enumerate(fold([signed[i] for i in range(40)]))}
    assert {(r.product_id, r.ord_key): r.balance_after for r in rows.collect()} == {(p, i): want[i] for p in range(9)
                                                                                   for i in range(40)}
    df, _ = moves(spark, range(0, 39, 2), products=1)          # one product of nine: its chunk alone is folded anew
    store.append(df.withColumn("ord_line", F.lit(2)), "c")
    assert store.rows().count() == 9 * 40 + 20
    assert store.log.get("rows", ["c"]).count() == 40 + 20
