import datetime as dt
from decimal import Decimal as D

from stockspark.operators import retry_fold
from stockspark.operators import workflow as W

T0 = dt.datetime(2024, 1, 1)


def test_only_decisions_that_can_count_are_written(spark, monkeypatch):
    written = {}

    def seen(real):
        return lambda df, name: written.setdefault(name, real(df, name))

    monkeypatch.setattr(W, "materialize", seen(W.materialize))
    monkeypatch.setattr(retry_fold, "materialize", seen(retry_fold.materialize))
    reqs = spark.createDataFrame([(r, 1, D(5), "pending") for r in "abc"],
                                 "id string, product_id long, quantity_requested decimal(12,2), status string")
    prods = spark.createDataFrame([(1, D(6), D(0))], "id long, current_stock decimal(12,2), reserved_stock decimal(12,2)")
    decs = spark.createDataFrame(
        [("1", "a", "approve", None, None, 1, T0), ("2", "a", "approve", D(5), None, 2, T0), ("3", "a", "reject", None, "x", 1, T0),
         ("4", "a", "approve", D(1), None, 1, T0), ("5", "b", "approve", D(4), None, 1, T0), ("6", "b", "approve", D(9), None, 1, T0),
         ("7", "b", "approve", D(1), None, 3, T0), ("8", "c", "reject", None, " no ", 4, T0), ("9", "c", "reject", None, "y", 1, T0)],
        "decision_id string, request_id string, decision string, qty_issued decimal(12,2), reason string, decided_by long, "
        "decided_at timestamp_ntz")
    got = {r.request_id: (r.status, r.quantity_issued, r.issued_by, r.rejection_reason, r.available_after)
           for r in W.apply_issue_decisions(reqs, prods, decs).collect()}
    assert got == {"a": ("issued", D(5), 1, None, D(1)), "b": ("partially_issued", D(1), 3, None, D(0)),
                   "c": ("rejected", None, 4, "no", None)}
    assert sorted(r.decision_id for r in written["asked"].collect()) == ["1", "3", "5", "7", "8"]
    assert sorted(r.decision_id for r in written["candidates"].collect()) == ["1", "5", "7"]
