import datetime as dt
import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import fold
from stockspark.operators import ledger as L

SCHEMA = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
          "type string, quantity decimal(12,2), signed_qty decimal(12,2)")
T0 = dt.datetime(2024, 1, 1)


def _rows(spec):
    """spec: {product: [signed qty, ...]} -> movement rows in time order."""
    out = []
    for pid, qs in spec.items():
        for i, q in enumerate(qs):
            q = Decimal(q).quantize(Decimal("0.01"))
            out.append((pid, T0 + dt.timedelta(minutes=i), i, 1,
                        "stock_in" if q >= 0 else "stock_out", abs(q), q))
    return out


def _check(spark, spec, n_chunks, opening=None, split="range"):
    df = spark.createDataFrame(_rows(spec), SCHEMA)
    op_df = None
    if opening:
        op_df = spark.createDataFrame([(k, Decimal(v)) for k, v in opening.items()],
                                      "product_id long, balance decimal(12,2)")
    got = L.ledger_apply(df, opening=op_df, n_chunks=n_chunks, split=split).select(
        "product_id", "ord_key", "balance_before", "balance_after", "accepted").collect()
    got = {(r.product_id, r.ord_key): (r.balance_before, r.balance_after, r.accepted)
           for r in got}
    assert len(got) == sum(len(v) for v in spec.values())
    for pid, qs in spec.items():
        exp = fold([Decimal(q).quantize(Decimal("0.01")) for q in qs],
                   Decimal((opening or {}).get(pid, "0")))
        for i, e in enumerate(exp):
            assert got[(pid, i)] == e, (pid, i, got[(pid, i)], e)
    snap = {r.product_id: r.current_stock
            for r in L.ledger_snapshot(df, opening=op_df, n_chunks=n_chunks,
                                       split=split).collect()}
    for pid, qs in spec.items():
        exp = fold([Decimal(q).quantize(Decimal("0.01")) for q in qs],
                   Decimal((opening or {}).get(pid, "0")))
        assert snap[pid] == exp[-1][1]


def test_refusal_case_from_fixtures(spark):
    # balance 4: +5, -9, -2 -> 9, 0, refused (stays 0)
    _check(spark, {1: ["5", "-9", "-2"]}, 2, opening={1: "4"})


def test_hot_product_split_over_many_chunks(spark):
    rnd = random.Random(7)
    hot = [str(rnd.choice([-30, -12, -5, 3, 7, 11, 20])) for _ in range(3000)]
    spec = {1: hot}
    for p in range(2, 40):
        spec[p] = [str(rnd.randint(-20, 20)) for _ in range(rnd.randint(1, 30))]
    _check(spark, spec, 24)


def test_hot_product_with_large_opening_and_dips(spark):
    rnd = random.Random(3)
    spec = {9: [str(rnd.choice([-50, -50, 40, 45])) for _ in range(1500)],
            10: [str(rnd.choice([-5, 4])) for _ in range(800)]}
    _check(spark, spec, 16, opening={9: "10.50", 10: "0"})


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.integers(1, 6),
                       st.lists(st.integers(-40, 40).map(lambda v: f"{v / 4:.2f}"),
                                min_size=1, max_size=60),
                       min_size=1, max_size=6),
       st.integers(1, 12), st.sampled_from(["range", "hash", "auto"]))
def test_fold_matches_brute_force(spark, spec, n_chunks, split):
    _check(spark, spec, n_chunks, split=split)


def test_auto_split_picks_range_only_for_hot_keys(spark):
    hot = spark.createDataFrame(_rows({1: ["1"] * 50, 2: ["1"], 3: ["1"]}), SCHEMA)
    even = spark.createDataFrame(_rows({p: ["1"] * 5 for p in range(1, 20)}), SCHEMA)
    assert L.has_hot_key(hot, 4) and not L.has_hot_key(even, 4)


def test_running_balance_hot_key(spark):
    rnd = random.Random(11)
    spec = {1: [str(rnd.randint(-9, 9)) for _ in range(2000)], 2: ["1", "-3", "2"]}
    df = spark.createDataFrame(_rows(spec), SCHEMA)
    got = {(r.product_id, r.ord_key): r.balance_after
           for r in L.running_balance(df, n_chunks=16).collect()}
    for pid, qs in spec.items():
        acc = Decimal(0)
        for i, q in enumerate(qs):
            acc += Decimal(q)
            assert got[(pid, i)] == acc


def test_unknown_type_adds(spark):
    from stockspark.functions import exprs as X
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("transfer", Decimal("5.00")), ("stock_out", Decimal("5.00"))],
                               "type string, quantity decimal(12,2)")
    got = [r.s for r in df.select(X.signed_quantity("type", "quantity").alias("s")).collect()]
    assert got == [Decimal("5.00"), Decimal("-5.00")]
    assert F is not None


def test_reconcile_clean_ledger_has_no_row_violations(spark):
    spec = {1: ["5", "-9", "3", "-2"], 2: ["-1", "4"]}
    df = spark.createDataFrame(_rows(spec), SCHEMA)
    led = L.ledger_apply(df, n_chunks=3)
    assert L.reconcile(led).count() == 0


def test_reconcile_finds_injected_breaks(spark):
    from pyspark.sql import functions as F
    spec = {1: ["5", "-2", "3", "-1"], 2: ["4", "-4"]}
    df = spark.createDataFrame(_rows(spec), SCHEMA)
    led = L.ledger_apply(df, n_chunks=2)
    # corrupt product 1, third row: before no longer equals the previous after
    bad = led.withColumn("balance_before", F.when(
        (F.col("product_id") == 1) & (F.col("ord_key") == 2), F.lit(Decimal("9.00")))
        .otherwise(F.col("balance_before")))
    got = sorted((r.product_id, r.ord_key, r.rule) for r in L.reconcile(bad).collect())
    assert got == [(1, 2, "after_mismatch"), (1, 2, "chain_break")]


def test_both_splits_agree_and_reject_movements_without_product(spark):
    from stockspark.operators import ledger as L
    rows = [(p, T0 + dt.timedelta(hours=i), i, 1, Decimal(q)) for i, (p, q) in enumerate(
        [(1, 5), (None, 4), (1, -9), (2, 3), (None, -1), (1, 2), (2, -3), (1, -4), (2, 8), (None, 7), (1, 1), (9, 6)])]
    df = spark.createDataFrame(rows, "product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
                                     "signed_qty decimal(12,2)")
    key = lambda d: sorted((r.product_id, r.ord_key, r.balance_after) for r in d.collect())
    for fold in (L.ledger_apply, L.running_balance):
        a, b = (key(fold(df, n_chunks=3, split=s)) for s in ("hash", "range"))
        assert a == b and len(a) == 9
    assert key_snapshot(L.ledger_snapshot(df, n_chunks=3, split="hash")) == \
        key_snapshot(L.ledger_snapshot(df, n_chunks=3, split="range"))
    products = spark.createDataFrame([(1,), (2,)], "id long")
    got = L.rejected_movements(df, products).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"no product": 3, "unknown product": 1}


def key_snapshot(df):
    return sorted((r.product_id, r.current_stock) for r in df.collect())
