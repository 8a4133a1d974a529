import datetime as dt
import random
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from stockspark.operators import numbering as N
from stockspark.operators import retry_fold
from stockspark.operators import workflow as W
from stockspark.sources.views import Views

T0 = dt.datetime(2024, 1, 1)


def test_kept_rows_have_the_numbers_they_have_among_all(spark):
    rnd = random.Random(3)
    rows = [(T0 + dt.timedelta(days=rnd.randrange(9)), f"r{k:03d}", rnd.choice([1, 2, 3, None]), "x" * k) for k in range(90)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, id string, employee_id long, text string")
    keep = F.col("employee_id") == 2
    some = N.number_rows(df, ["created_at", "id"], "ISS", n_parts=5, keep=keep)
    want = N.number_rows(df, ["created_at", "id"], "ISS", n_parts=5).where(keep)
    assert some.columns == want.columns
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) != []


def _tables(spark):
    d = tempfile.mkdtemp(prefix="requests-")
    spark.createDataFrame([(k, 1 + k % 3, T0, "FOP"[k % 3], "5-LOW") for k in range(30)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, "
                          "o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k, f"C{k}", "B") for k in (1, 2)],
                          "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k % 33, 1 + k % 2, 1 + k % 4, T0, 4.0) for k in range(99)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp_ntz, "
                          "l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return Views(spark, d)


def test_line_items_are_joined_once(spark):
    v = _tables(spark)
    plan = v.issue_requests._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "l_orderkey" not in joins[1]
    orders_of_known = [k for k in range(30) if 1 + k % 3 in (1, 2)]
    assert v.issue_requests.count() == 3 * len(orders_of_known)


def test_decisions_and_candidates_are_worked_out_once(spark, monkeypatch):
    written = []

    def once(real):
        return lambda df, name: written.append(name) or real(df, name)

    monkeypatch.setattr(W, "materialize", once(W.materialize))
    monkeypatch.setattr(retry_fold, "materialize", once(retry_fold.materialize))
    d = Decimal
    reqs = spark.createDataFrame([("a", 1, d(5), "pending"), ("b", 1, d(5), "pending")],
                                 "id string, product_id long, quantity_requested decimal(12,2), status string")
    prods = spark.createDataFrame([(1, d(6), d(0))], "id long, current_stock decimal(12,2), reserved_stock decimal(12,2)")
    decs = spark.createDataFrame([("1", "a", "approve", None, None, 1, T0), ("2", "b", "approve", d(1), None, 1, T0),
                                  ("3", "b", "reject", None, "no", 1, T0)],
                                 "decision_id string, request_id string, decision string, qty_issued decimal(12,2), "
                                 "reason string, decided_by long, decided_at timestamp_ntz")
    got = {r.request_id: (r.status, r.available_after) for r in W.apply_issue_decisions(reqs, prods, decs).collect()}
    assert got == {"a": ("issued", d(1)), "b": ("partially_issued", d(0))}
    assert written == ["asked", "candidates"]
