import datetime as dt
import tempfile
import uuid
from decimal import Decimal as D

from stockspark.operators.asof import asof_join
from stockspark.session import ensure_checkpoint_dir
from stockspark.sources.commits import CommitLog
from stockspark.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)
MOVES = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
         "type string, quantity decimal(12,2), signed_qty decimal(12,2)")


def moves(spark, keys, products=9):
    signed = {i: (i * 5) % 11 - 5 for i in range(40)}
    rows = [(p, T0 + dt.timedelta(days=3 * i), i, 1, "x", D(abs(signed[i])), D(signed[i])) for p in range(products) for i in keys]
    return spark.createDataFrame(rows, MOVES), {i: D(q) for i, q in signed.items()}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_versions_of_even_keys_are_dealt_out_once_and_not_kept(spark):
    left = spark.createDataFrame([(k, T0 + dt.timedelta(days=d), d) for k in range(40) for d in range(5)] + [(None, T0, 9), (3, None, 8)],
                                 "k long, t timestamp_ntz, i long")
    right = spark.createDataFrame([(k, T0 + dt.timedelta(days=2), k) for k in range(0, 40, 2)] + [(None, T0, 7)],
                                  "k long, since timestamp_ntz, v long")
    found = asof_join(left, right, "k", "t", "since")
    assert "InMemoryRelation" not in plan(found) and found.columns == ["k", "t", "i", "v"]
    for r in found.collect():
        late = r.k is not None and r.t is not None and r.k % 2 == 0 and r.i >= 2
        assert r.v == (r.k if late else None)


def test_the_first_batch_leaves_verdicts_on_alerts_alone(spark):
    d = tempfile.mkdtemp(prefix="moves-")
    moves(spark, range(10))[0].coalesce(1).write.mode("overwrite").parquet(d)
    src = spark.readStream.schema(MOVES).parquet(d)
    products = spark.createDataFrame([(p, f"P{p}", "Nos", D(3)) for p in range(8)],
                                     "id long, name string, unit string, min_stock_level decimal(12,2)")
    name = f"verdicts-{uuid.uuid4().hex}"
    alerts = S.run_alerts(src, products, name=name).count()
    written = CommitLog(spark, f"{ensure_checkpoint_dir(spark)}/stream-out/{name}").get("verdicts")
    assert 0 < alerts < 80 and written.count() == alerts
