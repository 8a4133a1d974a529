"""Sizes of the ledger's tasks follow the rows, not the session's number of partitions."""

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import fold
from stockspark.operators import ledger as L
from stockspark.operators.ledger_store import LedgerStore
from stockspark.session import ensure_checkpoint_dir

T0 = dt.datetime(2024, 1, 1)
MOVES = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
         "type string, quantity decimal(12,2), signed_qty decimal(12,2)")


def test_more_movements_are_cut_into_more_chunks_with_the_same_balances(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_CHUNK", 10)
    qty = {p: [(p * 7 + i * 5) % 11 - 5 for i in range(6)] for p in range(40)}
    rows = [(p, T0 + dt.timedelta(days=9 * i), i, 1, "x", Decimal(abs(q)), Decimal(q)) for p, v in qty.items()
            for i, q in enumerate(v)]
    df = spark.createDataFrame(rows, MOVES)
    chunked = L.chunk_movements(df)
    assert chunked.rdd.getNumPartitions() == 24          # 240 rows, 4 shuffle partitions
    assert L.chunk_movements(df, n_chunks=3).rdd.getNumPartitions() == 3
    store = LedgerStore(spark, f"{ensure_checkpoint_dir(spark)}/scale/{uuid.uuid4().hex}")
    store.append(df.where("ord_key < 4"), "a b")
    store.append(df.where("ord_key >= 4"), "c")
    got = {(r.product_id, r.ord_key): (r.balance_after, r.accepted) for r in store.rows().collect()}
    want = {(p, i): (after, ok) for p, v in qty.items() for i, (_, after, ok) in enumerate(fold(list(map(Decimal, v))))}
    assert got == want
    last = {r.product_id: r.current_stock for r in store.snapshot().collect()}
    assert last == {p: want[p, 5][0] for p in qty}


def test_a_chunk_has_one_entry_though_its_rows_lie_in_many_months(spark, monkeypatch):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(days=40 * i), i, 1, "x", Decimal(2), Decimal(2 if i % 2 else -1))
                                for i in range(8)], MOVES)
    store = LedgerStore(spark, f"{ensure_checkpoint_dir(spark)}/scale/{uuid.uuid4().hex}")
    read = []
    monkeypatch.setattr(LedgerStore, "_part_rows", lambda self, parts: read.append(parts))
    store.append(df.repartitionByRange(1, "ord_key"), "a")
    assert not read                                       # the entries need no second reading of the rows by month
    entries = store.index().orderBy(F.col("first.ord_key")).collect()
    assert sum(e["n"] for e in entries) == 8 and entries[-1]["end"] == 500
    assert entries[0]["first"].ord_key == 0 and entries[-1]["last"].ord_key == 7
