"""Catalog entries: list pages with filters and visibility, tab counts per viewer, user lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockspark import constants as K
from stockspark.operators import lists as L
from stockspark.plans.catalog import register, sql_case, sql_ucfirst, with_views

TERM = "red"
PER = K.ROWS_PER_PAGE
STOCK_FROM, STOCK_TO = dt.date(1996, 1, 1), dt.date(1999, 12, 31)
VIEWER = ("employee", 7)
KEEPER = ("keeper", 1)


def _limit(page_no: int, per: int = PER) -> str:
    return f"limit {per} offset {(page_no - 1) * per}"


def _status(col: str) -> str:
    return sql_case(col, K.STATUS_LABELS, sql_ucfirst(col))


@register("stock_page", with_views(f"""
with f as (
  select st.*, p.p_name product from stock_transactions st join part p on p.p_partkey = st.product_id
  where st.type = 'stock_out' and cast(st.created_at as date) >= date '{STOCK_FROM}'
    and cast(st.created_at as date) <= date '{STOCK_TO}'
    and (p.p_name ilike '%{TERM}%' or st.txn_number ilike '%{TERM}%' or st.reference_number ilike '%{TERM}%')),
g as (select * from f order by created_at desc, cast(split_part(txn_number, '-', 2) as bigint) desc {_limit(2)})
select g.txn_number, g.created_at, g.product, 'Nos' unit,
  {sql_case('g.type', K.MOVEMENT_LABELS, sql_ucfirst('g.type'))} type_label,
  cast(g.quantity as double) quantity, cast(g.balance_before as double) balance_before,
  cast(g.balance_after as double) balance_after, g.reference_number, u.name created_by_name,
  (select count(*) from f) total
from g left join users u on u.id = g.created_by
""", "stock_transactions", "users"))
def stock_page(v, p):
    """L-03/P-04/P-08: issues from stock within dates and matching a search, page 2 newest first."""
    return L.stock_page(v.stock_transactions, v.product_base, v.users, page_no=2, movement_type="stock_out",
                        date_from=STOCK_FROM, date_to=STOCK_TO, term=TERM)


def _issues_sql(where: str, page_no: int) -> str:
    return with_views(f"""
with f as (select r.*, p.p_name product from numbered_requests r join part p on p.p_partkey = r.product_id
           where {where}),
g as (select * from f order by created_at desc, cast(split_part(issue_number, '-', 2) as bigint) desc
      {_limit(page_no)})
select g.issue_number, g.employee_id, g.employee_name, g.department, g.product, 'Nos' unit,
  cast(g.quantity_requested as double) quantity_requested, cast(g.quantity_issued as double) quantity_issued,
  {_status('g.status')} status_label, u.name issued_by_name, g.created_at, (select count(*) from f) total
from g left join users u on u.id = g.issued_by
""", "numbered_requests", "users")


@register("issues_page", _issues_sql(
    f"r.status = 'partially_issued' and (r.issue_number ilike '%{TERM}%' or r.employee_name ilike '%{TERM}%'"
    f" or p.p_name ilike '%{TERM}%')", 2))
def issues_page(v, p):
    """L-03/P-12: a keeper's issue requests of one status matching a search, page 2."""
    return L.issues_page(v.numbered_requests, v.product_base, v.users, page_no=2, viewer=KEEPER,
                         status="partially_issued", term=TERM)


@register("issues_page_own", _issues_sql(f"r.employee_id = {VIEWER[1]}", 1))
def issues_page_own(v, p):
    """L-03/P-12: an employee's own issue requests, page 1."""
    return L.issues_page(v.requests_numbered(L.visible(VIEWER)), v.product_base, v.users, viewer=VIEWER)


def _indents_sql(where: str, page_no: int) -> str:
    return with_views(f"""
with f as (select * from numbered_indents i where {where}),
g as (select * from f order by created_at desc, cast(split_part(indent_number, '-', 2) as bigint) desc
      {_limit(page_no)})
select g.indent_number, g.employee_id, g.employee_name, g.item_name, cast(g.quantity as double) quantity,
  c.name category, {sql_case('g.priority', K.PRIORITY_LABELS, sql_ucfirst('g.priority'))} priority_label,
  {_status('g.status')} status_label, g.created_at, (select count(*) from f) total
from g left join categories c on c.id = g.category_id
""", "numbered_indents", "categories")


@register("indents_page", _indents_sql(
    "status = 'pending' and (indent_number ilike '%item 4%' or employee_name ilike '%item 4%'"
    " or item_name ilike '%item 4%')", 2))
def indents_page(v, p):
    """L-03/J-09: a keeper's pending indents matching a search, with their categories, page 2."""
    return L.indents_page(v.numbered_indents, v.categories, page_no=2, viewer=KEEPER, status="pending",
                          term="item 4")


@register("indents_page_own", _indents_sql(f"employee_id = {VIEWER[1]}", 1))
def indents_page_own(v, p):
    """L-03/P-12: an employee's own indents, page 1."""
    return L.indents_page(v.numbered_indents, v.categories, viewer=VIEWER)


@register("users_page", with_views(f"""
with f as (select * from (select *, 'EMP-' || cast(id as varchar) employee_id from users) x
  where role = 'employee' and (name ilike '%auto%' or username ilike '%auto%' or department ilike '%auto%'
                               or employee_id ilike '%auto%'))
select id, employee_id, name, username, department, {sql_case('role', K.ROLE_LABELS, sql_ucfirst('role'))} role_label,
  {_status('status')} status_label, (select count(*) from f) total
from f order by name, id {_limit(1)}
""", "users"))
def users_page(v, p):
    """L-03: users of one role matching a search over four columns, page 1 by name."""
    users = v.users.withColumn("employee_id", F.concat(F.lit("EMP-"), F.col("id").cast("string")))
    return L.users_page(users, role="employee", term="auto")


@register("products_page", with_views(f"""
with f as (select * from products where name ilike '%{TERM}%' or product_code ilike '%{TERM}%'),
g as (select * from f order by name, id {_limit(2)})
select g.id, g.product_code, g.name, c.name category, g.unit, cast(g.current_stock as double) current_stock,
  cast(g.min_stock_level as double) min_stock_level, g.rack_location, {_status('g.status')} status_label,
  (select count(*) from f) total
from g left join categories c on c.id = g.category_id
""", "products", "categories"))
def products_page(v, p):
    """L-03: products of any status matching a search, page 2 by name."""
    return L.products_page(v.products, v.categories, page_no=2, term=TERM)


AUDIT_FROM, AUDIT_TO, AUDIT_USER = dt.date(2024, 1, 5), dt.date(2024, 1, 25), 11


@register("audit_page_filtered", with_views(f"""
with f as (select * from audit_log where module = 'Reports' and action = 'EXPORT' and user_id = {AUDIT_USER}
  and cast(created_at as date) >= date '{AUDIT_FROM}' and cast(created_at as date) <= date '{AUDIT_TO}'
  and (details ilike '%exp%' or user_name ilike '%exp%' or action ilike '%exp%'))
select id, created_at, user_id, user_name, user_role, action, module, details, (select count(*) from f) total
from f order by created_at desc, id desc {_limit(1, K.AUDIT_ROWS_PER_PAGE)}
""", "audit_log"))
def audit_page_filtered(v, p):
    """L-03/P-01/P-04: the audit list under all its filters."""
    return L.audit_page(v.audit_log, term="exp", module="Reports", action="EXPORT", user_id=AUDIT_USER,
                        date_from=AUDIT_FROM, date_to=AUDIT_TO)


def _tabs_sql(table: str, statuses: list[str]) -> str:
    own = ", ".join(f"count(*) filter (where status = '{s}') {s}" for s in statuses)
    pick = ", ".join(f"case when u.role = 'employee' then coalesce(o.{s}, 0) else a.{s} end {s}"
                     for s in ["total", *statuses])
    return with_views(f"""
with o as (select employee_id, count(*) total, {own} from {table} group by employee_id),
a as (select count(*) total, {own} from {table})
select u.id viewer_id, u.role, {pick} from users u cross join a left join o on o.employee_id = u.id
""", table, "users")


ISSUE_TABS = ["pending", "issued", "rejected", "partially_issued"]
INDENT_TABS = ["pending", "approved", "rejected"]


@register("issue_tab_counts", _tabs_sql("issue_requests", ISSUE_TABS))
def issue_tab_counts(v, p):
    """A-13/P-12: the tab counts of the issue list for every viewer."""
    return L.tab_counts(v.issue_requests, v.users, ISSUE_TABS)


@register("indent_tab_counts", _tabs_sql("indents", INDENT_TABS))
def indent_tab_counts(v, p):
    """A-13/P-12: the tab counts of the indent list for every viewer."""
    return L.tab_counts(v.indents, v.users, INDENT_TABS)


@register("user_lookup", with_views("""
select k.user_id, u.name, u.username, u.department, u.role, u.status
from (select distinct s_suppkey * 40 user_id from supplier) k left join users u on u.id = k.user_id
""", "users"))
def user_lookup(v, p):
    """S-03: users by id, nulls where absent."""
    return L.users_by_id(v.users, v.t.supplier.select((F.col("s_suppkey") * 40).alias("user_id")))


@register("login_lookup", with_views("""
select k.username, cast(u.id as double) user_id, u.name, u.role, u.department
from (select username from users union select lower(s_name) from supplier) k
left join users u on u.username = k.username and u.status = 'active'
""", "users"))
def login_lookup(v, p):
    """S-03: active users by username, all usernames and names that no user has; nulls where there is none."""
    keys = (v.users.select("username")
            .unionByName(v.t.supplier.select(F.lower("s_name").alias("username"))))
    return L.active_users_by_username(v.users, keys).withColumn("user_id", F.col("user_id").cast("double"))
