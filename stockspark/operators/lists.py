"""Filtered list pages with visibility (L-03, L-05, P-12), tab counts per viewer (A-13), user lookups (S-03).

Every list takes all of its filters as optional arguments, counts the
matches, and joins names only to the rows of the page.  Orders end with the
number or id, so pages are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.functions import exprs as X
from stockspark.functions import filters as FL
from stockspark.operators import paging as PG
from stockspark.operators.common import attach_scalars


def _equals(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == F.lit(value)


def visible(viewer: tuple | None) -> Column | None:
    """``viewer``: (role, user id); None: no viewer, every row."""
    return None if viewer is None else FL.visible_to(F.lit(viewer[0]), F.lit(viewer[1]))


def _names(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), F.col("name").alias("product"), "unit")


def _page(filtered: DataFrame, order: list[Column], page_no: int, per_page: int = K.ROWS_PER_PAGE) -> DataFrame:
    return PG.with_total(PG.page(filtered, order, page_no, per_page), filtered)


def _with_user(rows: DataFrame, users: DataFrame, key: str, out: str) -> DataFrame:
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias(out))
    return rows.join(u, F.col(key) == F.col("_uid"), "left").drop("_uid")


def stock_page(transactions: DataFrame, products: DataFrame, users: DataFrame, page_no: int = 1,
               product_id=None, movement_type=None, date_from=None, date_to=None, term=None) -> DataFrame:
    """Stock transactions newest first; the search covers product, number and reference."""
    f = transactions.filter(FL.conjunction([
        _equals("product_id", product_id), _equals("type", movement_type),
        FL.date_bound("created_at", date_from, date_to)]))
    f = f.join(_names(products), "product_id").filter(FL.search(["product", "txn_number", "reference_number"], term))
    order = [F.desc("created_at"), X.number_seq("txn_number").desc()]
    rows = _with_user(_page(f, order, page_no), users, "created_by", "created_by_name")
    return rows.select("txn_number", "created_at", "product", "unit", X.movement_label("type").alias("type_label"),
                       "quantity", "balance_before", "balance_after", "reference_number", "created_by_name",
                       "total").orderBy(*order)


def issues_page(requests: DataFrame, products: DataFrame, users: DataFrame, page_no: int = 1,
                viewer=None, status=None, term=None) -> DataFrame:
    """Issue requests newest first, for employees only their own; the search covers number, requester, product."""
    f = requests.filter(FL.conjunction([visible(viewer), _equals("status", status)]))
    f = f.join(_names(products), "product_id").filter(FL.search(["issue_number", "employee_name", "product"], term))
    order = [F.desc("created_at"), X.number_seq("issue_number").desc()]
    rows = _with_user(_page(f, order, page_no), users, "issued_by", "issued_by_name")
    return rows.select("issue_number", "employee_id", "employee_name", "department", "product", "unit",
                       "quantity_requested", "quantity_issued", X.status_label("status").alias("status_label"),
                       "issued_by_name", "created_at", "total").orderBy(*order)


def indents_page(indents: DataFrame, categories: DataFrame, page_no: int = 1,
                 viewer=None, status=None, term=None) -> DataFrame:
    """Indents newest first, for employees only their own; the search covers number, requester, item."""
    f = indents.filter(FL.conjunction([visible(viewer), _equals("status", status),
                                       FL.search(["indent_number", "employee_name", "item_name"], term)]))
    order = [F.desc("created_at"), X.number_seq("indent_number").desc()]
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (_page(f, order, page_no).join(c, "category_id", "left")
            .select("indent_number", "employee_id", "employee_name", "item_name", "quantity", "category",
                    X.priority_label("priority").alias("priority_label"),
                    X.status_label("status").alias("status_label"), "created_at", "total").orderBy(*order))


def users_page(users: DataFrame, page_no: int = 1, role=None, term=None) -> DataFrame:
    """Users by name; the search covers name, username, department and employee number."""
    f = users.filter(FL.conjunction([_equals("role", role),
                                     FL.search(["name", "username", "department", "employee_id"], term)]))
    return (_page(f, [F.col("name"), F.col("id")], page_no)
            .select("id", "employee_id", "name", "username", "department", X.role_label("role").alias("role_label"),
                    X.status_label("status").alias("status_label"), "total"))


def products_page(products: DataFrame, categories: DataFrame, page_no: int = 1, term=None) -> DataFrame:
    """Products of any status by name; the search covers name and code."""
    f = products.filter(FL.search(["name", "product_code"], term))
    order = [F.col("name"), F.col("id")]
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (_page(f, order, page_no).join(c, "category_id", "left")
            .select("id", "product_code", "name", "category", "unit", "current_stock", "min_stock_level",
                    "rack_location", X.status_label("status").alias("status_label"), "total").orderBy(*order))


def audit_page(audit: DataFrame, page_no: int = 1, term=None, module=None, action=None, user_id=None,
               date_from=None, date_to=None) -> DataFrame:
    """Audit rows newest first under all filters of the audit list."""
    f = audit.filter(FL.conjunction([
        FL.search(["details", "user_name", "action"], term), _equals("module", module), _equals("action", action),
        _equals("user_id", user_id), FL.date_bound("created_at", date_from, date_to)]))
    return (_page(f, [F.desc("created_at"), F.desc("id")], page_no, K.AUDIT_ROWS_PER_PAGE)
            .select("id", "created_at", "user_id", "user_name", "user_role", "action", "module", "details", "total"))


def tab_counts(requests: DataFrame, viewers: DataFrame, statuses: list[str]) -> DataFrame:
    """Per viewer the visible rows in all and by status: employees their own, others everybody's.

    Requests are counted per owner before they meet the viewers; the counts
    of all owners are one row, attached as a scalar.
    """
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]]
    names = ["total", *statuses]
    own = requests.groupBy(F.col("employee_id").alias("id")).agg(*counts)
    everything = requests.agg(*[c.alias(f"all_{n}") for c, n in zip(counts, names)])
    v = attach_scalars(viewers.select("id", "role").join(own, "id", "left"), everything)
    pick = [F.when(F.col("role") == "employee", F.coalesce(n, F.lit(0))).otherwise(F.col(f"all_{n}")).alias(n)
            for n in names]
    return v.select(F.col("id").alias("viewer_id"), "role", *pick)


def users_by_id(users: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per distinct ``user_id`` of ``keys``; nulls where there is no such user."""
    u = users.select(F.col("id").alias("_uid"), "name", "username", "department", "role", "status")
    return (keys.select("user_id").distinct().join(u, F.col("user_id") == F.col("_uid"), "left").drop("_uid"))


def active_users_by_username(users: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per distinct ``username`` of ``keys``; nulls where no active user has it."""
    u = (users.filter(F.col("status") == "active")
         .select(F.col("username").alias("_name"), F.col("id").alias("user_id"), "name", "role", "department"))
    return (keys.select("username").distinct().join(u, F.col("username") == F.col("_name"), "left").drop("_name"))
