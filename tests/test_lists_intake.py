"""List pages, tab counts, lookups, intake rules and delete rules on small hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest

from stockspark.operators import intake as I
from stockspark.operators import lists as L
from stockspark.operators import quality as Q

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    products = spark.createDataFrame([(1, "Red paint", "Nos"), (2, "Blue 100%", "Nos")], "id long, name string, unit string")
    users = spark.createDataFrame(
        [(1, "Ann", "ann", "Civil", "employee", "active"), (2, "Bo", "bo", None, "keeper", "active"),
         (3, "Cy", "cy", "HR", "employee", "inactive")],
        "id long, name string, username string, department string, role string, status string")
    rows = [(f"ISS-{k:04d}", 1 + k % 3, "Ann" if k % 3 == 0 else "X", "Civil", 1 + k % 2, Decimal(k), None,
             "pending" if k % 2 else "issued", None if k % 2 else 2, DAY) for k in range(9990, 10030)]
    requests = spark.createDataFrame(
        rows, "issue_number string, employee_id long, employee_name string, department string, product_id long, "
              "quantity_requested decimal(12,2), quantity_issued decimal(12,2), status string, issued_by long, "
              "created_at timestamp")
    return products, users, requests


def test_issue_pages_order_ties_by_number_and_hide_foreign_rows(tables):
    products, users, requests = tables
    first = L.issues_page(requests, products, users, viewer=("keeper", 2)).collect()
    assert [r.issue_number for r in first] == [f"ISS-{k:04d}" for k in range(10029, 10004, -1)]
    second = L.issues_page(requests, products, users, page_no=2).collect()
    assert len(second) == 15 and {r.total for r in first + second} == {40}
    own = L.issues_page(requests, products, users, viewer=("employee", 1)).collect()
    assert {r.employee_id for r in own} == {1} and own[0].total == 14
    hit = L.issues_page(requests, products, users, status="issued", term="red").collect()
    assert {(r.product, r.status_label, r.issued_by_name) for r in hit} == {("Red paint", "Issued", "Bo")}
    assert L.issues_page(requests, products, users, term="nothing").collect() == []


def test_tab_counts_per_viewer(tables):
    _, users, requests = tables
    got = {r.viewer_id: (r.total, r.pending, r.issued) for r in
           L.tab_counts(requests, users, ["pending", "issued"]).collect()}
    assert got == {1: (14, 7, 7), 2: (40, 20, 20), 3: (13, 6, 7)}
    assert {tuple(r)[2:] for r in L.tab_counts(requests.limit(0), users, ["pending"]).collect()} == {(0, 0)}


def test_user_lookups(spark, tables):
    users = tables[1]
    ids = spark.createDataFrame([(1,), (1,), (9,)], "user_id long")
    assert {(r.user_id, r.name) for r in L.users_by_id(users, ids).collect()} == {(1, "Ann"), (9, None)}
    names = spark.createDataFrame([("bo",), ("cy",), ("zz",)], "username string")
    got = {(r.username, r.user_id) for r in L.active_users_by_username(users, names).collect()}
    assert got == {("bo", 2), ("cy", None), ("zz", None)}


def test_adjustments_need_product_quantity_and_reason(spark):
    raw = spark.createDataFrame(
        [(1, 5, Decimal(2), " count "), (2, 5, Decimal(2), "\t "), (3, 5, Decimal(2), None), (4, None, Decimal(2), "x"),
         (5, 5, Decimal(0), "x"), (6, 5, None, "x"), (7, 5, Decimal(1), "0"), (8, 6, Decimal(1), "y")],
        "id long, product_id long, quantity decimal(12,2), reason string")
    got = {r.id: (r.reference_number, r.reference_type, r.message) for r in I.adjustment_intake(raw, ["id"]).collect()}
    assert got[1] == ("ADJ-0001", "adjustment", None) and got[8] == ("ADJ-0002", "adjustment", None)
    assert all(got[k] == (None, None, I.ADJUSTMENT_MESSAGE) for k in range(2, 8))
    assert I.adjustment_intake(raw.limit(0), ["id"]).collect() == []


def test_indent_intake_and_notices(spark):
    raw = spark.createDataFrame(
        [(1, "Ann", "Chair", Decimal(2), "Nos", 0), (2, "Bo", " ", Decimal(2), "Nos", 1), (3, "Cy", "Desk", None, "Nos", 1)],
        "id long, employee_name string, item_name string, quantity decimal(12,2), unit string, category_id long")
    out = I.indent_intake(raw, ["id"])
    got = {r.id: (r.indent_number, r.status, r.category_id, r.message) for r in out.collect()}
    assert got == {1: ("IND-0001", "pending", None, None), 2: (None, None, 1, I.INDENT_MESSAGE),
                   3: (None, None, 1, I.INDENT_MESSAGE)}
    notice, = I.new_indent_notices(out).collect()
    assert notice.body == "Ann requested 2.00 Nos of Chair"


def test_user_intake_takes_each_username_once(spark, tables):
    raw = spark.createDataFrame(
        [(1, "A", " New ", "employee", 8), (2, "B", "new", "employee", 9), (3, "C", "BO", "admin", 9),
         (4, "D", "short", "admin", 7), (5, "E", "short", "admin", 8), (6, None, "q", "admin", 8),
         (7, "F", None, "admin", 8), (8, "G", "g", "admin", None)],
        "seq long, name string, username string, role string, password_length int")
    got = {r.seq: r.message for r in I.user_intake(raw, tables[1], ["seq"]).collect()}
    assert got == {1: None, 2: "Username 'new' already exists.", 3: "Username 'bo' already exists.",
                   4: I.USER_PASSWORD_MESSAGE, 5: None, 6: I.USER_REQUIRED_MESSAGE, 7: I.USER_REQUIRED_MESSAGE,
                   8: I.USER_REQUIRED_MESSAGE}


def test_delete_rules(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, ref long")
    gone = spark.createDataFrame([(10,)], "id long")
    assert {tuple(r) for r in Q.set_null(child, "ref", gone).select("id", "ref", "nulled").collect()} \
        == {(1, None, True), (2, 20, False), (3, None, False)}
    assert {r.id for r in Q.cascade(child, "ref", gone).collect()} == {2, 3}
    both = spark.createDataFrame([(10,), (30,)], "id long")
    assert {tuple(r) for r in Q.restricted(both, {"child": (child, "ref")}).collect()} == {(10, 1, True), (30, 0, False)}


def test_orphans_are_found(spark):
    child = spark.createDataFrame([(5,), (5,), (6,), (None,)], "ref long")
    parent = spark.createDataFrame([(6,)], "id long")
    assert [tuple(r) for r in Q.fk_violations({"c.ref": (child, "ref", parent, "id")}).collect()] == [("c.ref", "5", 2)]
