"""Hand-derived goldens on the application's seed rows."""

import datetime as dt
from decimal import Decimal

import pytest

from seed import NOW, seed_views
from stockspark.operators import reports as R
from stockspark.params import Params

P = Params(as_of=NOW.date(), date_from=dt.date(2025, 1, 1), date_to=dt.date(2025, 12, 31))


@pytest.fixture(scope="module")
def sv(spark):
    return seed_views(spark)


def test_kpis(sv):
    r = R.dashboard_kpis(sv, P).first()
    assert (r.total_products, r.low_stock, r.critical_stock) == (15, 3, 1)
    assert (r.pending_indents, r.pending_issues, r.issued_today) == (2, 3, 0)
    assert r.stock_in_today == Decimal("823.00")       # opening movements are dated today


def test_urgency_order(sv):
    rows = R.low_stock_report(sv, P).collect()
    assert [r.product_code for r in rows] == ["P-006", "P-004", "P-002"]
    assert [r.alert_level for r in rows] == ["CRITICAL", "LOW", "LOW"]
    assert [round(r.ratio, 3) for r in rows] == [0.25, 0.533, 0.85]


def test_stock_per_category(sv):
    got = {r.category: r.total for r in R.category_totals(sv, P).collect()}
    assert got == {"Electrical": 508, "Civil": 340, "Safety": 67, "Mechanical": 26,
                   "Office": 20, "Finishing": 18, "Plumbing": 5}


def test_low_and_critical_per_category(sv):
    got = {r.category: (r.low_items, r.critical_items)
           for r in R.category_stock_report(sv, P).collect()}
    assert got["Civil"] == (1, 0) and got["Electrical"] == (1, 0) and got["Plumbing"] == (1, 1)
    assert got["Safety"] == (0, 0)


def test_status_counts(sv):
    got = {r.status: r.cnt for r in R.status_counts(sv, P).collect()}
    assert got == {"pending": 3, "issued": 3, "rejected": 1, "all": 7}


def test_department_consumption(sv):
    got = {r.department: (r.requests, r.total_qty) for r in R.dept_consumption(sv, P).collect()}
    assert got == {"Electrical": (2, Decimal("52.00")), "Admin": (1, Decimal("3.00"))}


def test_top_products(sv):
    got = [(r.product_id, r.total_qty, r.rank) for r in R.top_products(sv, P).collect()]
    assert got == [(3, Decimal("50.00"), 1), (9, Decimal("3.00"), 2), (4, Decimal("2.00"), 3)]
