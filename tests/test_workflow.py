import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockspark.operators import numbering as N
from stockspark.operators import workflow as W

T0 = dt.datetime(2024, 3, 1, 10, 0)
REQ = ("id string, product_id long, quantity_requested decimal(12,2), status string, "
       "created_at timestamp_ntz")
PROD = "id long, current_stock decimal(12,2), reserved_stock decimal(12,2)"
DEC = ("decision_id string, request_id string, decision string, qty_issued decimal(12,2), "
       "reason string, decided_by long, decided_at timestamp_ntz")


def _apply(spark, reqs, prods, decs):
    out = W.apply_issue_decisions(spark.createDataFrame(reqs, REQ),
                                  spark.createDataFrame(prods, PROD),
                                  spark.createDataFrame(decs, DEC))
    return {r.request_id: r for r in out.collect()}


def test_partial_issue_and_over_issue(spark):
    d = Decimal
    reqs = [("a", 1, d("10"), "pending", T0), ("b", 2, d("10"), "pending", T0)]
    prods = [(1, d("6"), d("0")), (2, d("6"), d("0"))]
    decs = [("a1", "a", "approve", d("4"), None, 1, T0),
            ("b1", "b", "approve", None, None, 1, T0)]
    got = _apply(spark, reqs, prods, decs)
    assert got["a"].status == "partially_issued" and got["a"].quantity_issued == d("4")
    assert got["a"].available_after == d("2")
    assert got["b"].status == "pending" and got["b"].quantity_issued is None


def test_first_decision_wins_and_blank_reason_refused(spark):
    d = Decimal
    reqs = [("a", 1, d("1"), "pending", T0), ("b", 1, d("1"), "pending", T0)]
    prods = [(1, d("100"), d("0"))]
    decs = [("a1", "a", "approve", None, None, 1, T0),
            ("a2", "a", "reject", None, "late", 1, T0 + dt.timedelta(hours=1)),
            ("b1", "b", "reject", None, "  ", 1, T0)]
    got = _apply(spark, reqs, prods, decs)
    assert got["a"].status == "issued"
    assert "b" not in got            # a blank reason is refused: the request stays pending


def test_approvals_consume_stock_in_decision_order(spark):
    d = Decimal
    reqs = [(f"r{i}", 1, d("4"), "pending", T0) for i in range(5)]
    prods = [(1, d("13"), d("1"))]     # available 12 -> three approvals fit
    decs = [(f"d{i}", f"r{i}", "approve", None, None, 1, T0 + dt.timedelta(minutes=i))
            for i in range(5)]
    got = _apply(spark, reqs, prods, decs)
    assert [got[f"r{i}"].status for i in range(5)] == ["issued"] * 3 + ["pending"] * 2


def test_allocation_total_is_min_of_available_and_demand(spark):
    rnd = random.Random(5)
    reqs, prods = [], []
    for p in range(1, 8):
        prods.append((p, Decimal(rnd.randint(0, 60)), Decimal(rnd.randint(0, 5))))
        for i in range(rnd.randint(1, 25)):
            reqs.append((f"{p}-{i}", p, Decimal(rnd.randint(1, 9)), "pending",
                         T0 + dt.timedelta(minutes=i)))
    r = spark.createDataFrame(reqs, REQ)
    pr = spark.createDataFrame(prods, PROD)
    out = W.allocate_requests(r, pr).groupBy("product_id").agg(
        F.sum("allocated").alias("a"), F.sum("quantity_requested").alias("q")).collect()
    avail = {p: max(Decimal(0), c - rs) for p, c, rs in prods}
    for row in out:
        assert row.a == min(avail[row.product_id], row.q)


def test_number_rows_is_the_global_rank_on_skewed_input(spark):
    rows = [(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 200)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = sorted((r.k, r.t, r.number) for r in
                 N.number_rows(df, ["k", "t"], "TXN", n_parts=16).collect())
    exp = [(k, t, f"TXN-{i + 1:04d}") for i, (k, t) in enumerate(sorted(rows))]
    assert got == exp


def test_number_by_year_continues_after_latest_existing(spark):
    rows = [(i, dt.datetime(2023 + (i % 2), 1, 1) + dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    existing = spark.createDataFrame([(1, "ISS-2023-0007"), (2, "ISS-2023-0003")],
                                     "id long, number string")
    got = {r.id: r.number for r in
           N.number_by_year(df, "created_at", ["id"], "ISS", existing).collect()}
    assert got[0] == "ISS-2023-0004"     # latest by id is 0003
    assert got[1] == "ISS-2024-0001"


def test_request_validation_reasons(spark):
    d = Decimal
    decs = spark.createDataFrame([("x", "a", "approve", d("-1"), None, 1, T0),
                                  ("y", "a", "reject", None, None, 1, T0),
                                  ("z", "a", "hold", None, "r", 1, T0)], DEC)
    got = {r.decision_id: (r.valid, r.reasons) for r in W.validate_decisions(decs).collect()}
    assert got["x"] == (True, "")      # falls back to the requested quantity
    assert got["y"] == (False, "rejection reason is mandatory")
    assert got["z"] == (False, "unknown decision")


def _sequential(reqs, prods, decs):
    """Brute force: every valid decision in time order against per-request and per-product state."""
    left = {p: s - r for p, s, r in prods}
    req = {r[0]: r for r in reqs}
    out = {}
    for did, rid, kind, qty, reason, by, at in sorted(decs, key=lambda x: (x[6], x[0])):
        if rid not in req or (kind == "reject" and not (reason or "").strip()):
            continue
        if out.get(rid, ("pending",))[0] != "pending":
            continue
        _, prod, asked, _, _ = req[rid]
        if kind == "reject":
            out[rid] = ("rejected", None, by, at, None)
            continue
        q = qty if qty is not None and qty > 0 else asked
        if q > left[prod]:
            out.setdefault(rid, ("pending", None, None, None, left[prod]))
            continue
        left[prod] -= q
        out[rid] = ("partially_issued" if q < asked else "issued", q, by, at, left[prod])
    return out


def test_refused_approval_leaves_the_request_to_its_next_decision(spark):
    d = Decimal
    reqs = [("a", 1, d("10"), "pending", T0), ("b", 1, d("10"), "pending", T0)]
    h = [T0 + dt.timedelta(hours=i) for i in range(5)]
    decs = [("1", "a", "approve", None, None, 1, h[0]), ("2", "a", "reject", None, "no stock", 2, h[1]),
            ("3", "b", "approve", d("0"), None, 1, h[0]), ("4", "b", "approve", d("4"), None, 3, h[2])]
    got = _apply(spark, reqs, [(1, d("6"), d("0"))], decs)
    assert (got["a"].status, got["a"].rejection_reason, got["a"].issued_at) == ("rejected", "no stock", h[1])
    assert (got["b"].status, got["b"].quantity_issued, got["b"].issued_by) == ("partially_issued", d("4"), 3)


def test_decision_batch_matches_the_sequential_outcome(spark):
    rnd = random.Random(7)
    reqs = [(f"r{i:03d}", 1 if i % 3 == 0 else 2 + i % 4, Decimal(rnd.randint(1, 12)), "pending", T0)
            for i in range(160)]
    prods = [(p, Decimal(rnd.randint(20, 90)), Decimal(2)) for p in range(1, 6)]
    decs = []
    for i in range(700):
        kind = "reject" if rnd.random() < 0.12 else "approve"
        qty = rnd.choice([None, Decimal(0), Decimal(rnd.randint(1, 12))])
        decs.append((f"d{i:04d}", rnd.choice(reqs)[0], kind, qty, rnd.choice(["no", " ", None]), rnd.randint(1, 9),
                     T0 + dt.timedelta(minutes=rnd.randint(0, 400))))
    got = {k: (r.status, r.quantity_issued, r.issued_by, r.issued_at, r.available_after)
           for k, r in _apply(spark, reqs, prods, decs).items()}
    want = _sequential(reqs, prods, decs)
    assert got == want
    assert {v[0] for v in want.values()} == {"pending", "rejected", "issued", "partially_issued"}


def test_long_chain_of_retries_in_one_pass(spark, monkeypatch):
    """10,000 requests that each take three tries at one product, in one chunk and cut over many."""
    from stockspark.operators import retry_fold
    d, n = Decimal, 10_000
    reqs = [(f"r{i:05d}", 1, d(9), "pending", T0) for i in range(n)]
    decs = []
    for i in range(n):                 # 9 and 5 are refused unless stock is left, 1 at last may pass
        for k, q in enumerate((9, 5, 1)):
            decs.append((f"d{i:05d}{k}", f"r{i:05d}", "approve", d(q), None, 1,
                         T0 + dt.timedelta(minutes=(i if k == 0 else (i + 4000 * k) % 13_000 + 5))))
    prods = [(1, d(4000), d(0)), (2, d(5), d(0))]
    want = _sequential(reqs, prods, decs)
    assert len({v[1] for v in want.values()}) > 2
    rounds = []
    real = retry_fold._stitch
    monkeypatch.setattr(retry_fold, "_stitch", lambda rows, order: rounds.append(1) or real(rows, order))
    for hot in (False, True):
        monkeypatch.setattr(retry_fold.L, "has_hot_key", lambda rows, n, hot=hot: hot)
        got = {k: (r.status, r.quantity_issued, r.issued_by, r.issued_at, r.available_after)
               for k, r in _apply(spark, reqs, prods, decs).items()}
        assert got == want
    assert rounds == [1]


def test_retries_across_chunks_match_the_sequential_outcome(spark, monkeypatch):
    from stockspark.operators import retry_fold
    monkeypatch.setattr(retry_fold.L, "has_hot_key", lambda rows, n: True)
    rnd = random.Random(11)
    reqs = [(f"r{i:03d}", 1 if i % 2 else 2 + i % 6, Decimal(rnd.randint(1, 12)), "pending", T0) for i in range(200)]
    prods = [(p, Decimal(rnd.randint(40, 200)), Decimal(2)) for p in range(1, 8)]
    decs = [(f"d{i:04d}", rnd.choice(reqs)[0], "reject" if rnd.random() < 0.08 else "approve",
             rnd.choice([None, Decimal(rnd.randint(1, 12))]), rnd.choice(["no", None]), rnd.randint(1, 9),
             T0 + dt.timedelta(minutes=rnd.randint(0, 900))) for i in range(1500)]
    got = {k: (r.status, r.quantity_issued, r.issued_by, r.issued_at, r.available_after)
           for k, r in _apply(spark, reqs, prods, decs).items()}
    assert got == _sequential(reqs, prods, decs)
