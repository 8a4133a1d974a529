"""Catalog entries: KPIs, group-bys, named reports, joins, top-k, facets."""

from __future__ import annotations

from stockspark import constants as K
from stockspark.operators import reports as R
from stockspark.plans.catalog import (AS_OF, A_FROM, A_TO, CRIT, LOW, dbl, in_range, register,
                                      sql_case, sql_ucfirst, with_views)

register("dashboard_kpis", with_views(f"""
select
 (select count(*) from products where status='active') total_products,
 (select count(*) from products p where status='active' and {LOW}) low_stock,
 (select count(*) from products p where status='active' and {CRIT}) critical_stock,
 (select count(*) from indents where status='pending') pending_indents,
 (select count(*) from issue_requests where status='pending') pending_issues,
 (select count(*) from issue_requests where status='issued' and cast(issued_at as date) = {AS_OF}) issued_today,
 (select cast(coalesce(sum(quantity), 0) as double) from stock_transactions
   where type='stock_in' and cast(created_at as date) = {AS_OF}) stock_in_today
""", "products", "indents", "issue_requests", "stock_transactions"))(R.dashboard_kpis)

register("period_summary", with_views(f"""
select
 (select count(*) from issue_requests where status='issued' and {in_range('issued_at')}) total_issued,
 (select cast(coalesce(sum(quantity), 0) as double) from stock_transactions
   where type='stock_in' and {in_range('created_at')}) total_stock_in,
 (select cast(coalesce(sum(quantity), 0) as double) from stock_transactions
   where type='stock_out' and {in_range('created_at')}) total_stock_out,
 (select count(*) from indents where {in_range('created_at')}) total_indents,
 (select count(*) from indents where status='approved' and {in_range('created_at')}) approved_indents,
 (select count(*) from issue_requests where status='rejected' and {in_range('created_at')}) rejected_issues
""", "issue_requests", "stock_transactions", "indents"))(R.period_summary)

ISSUED = f"status='issued' and {in_range('issued_at')}"

register("daily_issues", with_views(f"""
select cast(cast(issued_at as date) as varchar) "day", count(*) cnt,
  cast(sum(quantity_issued) as double) qty
from issue_requests where {ISSUED} group by 1
""", "issue_requests"))(R.daily_issues)

@register("monthly_trend", with_views(f"""
select strftime(date_trunc('month', issued_at), '%Y-%m') month_start, count(*) "count",
  strftime(date_trunc('month', issued_at), '%b %Y') "month"
from issue_requests
where status='issued' and issued_at >= {AS_OF} - interval 6 month
group by 1, 3
""", "issue_requests"))
def monthly_trend(v, p):
    """A-05/P-06: issued requests per month over the last six months."""
    return R.monthly_trend(v, p).withColumn("month_start",
                                            R.F.date_format("month_start", "yyyy-MM"))

register("top_products", with_views(f"""
select a.product_id, p.name, p.unit, cast(a.total_qty as double) total_qty,
  row_number() over (order by a.total_qty desc, a.product_id) rank
from (select product_id, sum(quantity_issued) total_qty from issue_requests
      where {ISSUED} group by product_id) a
join part_names p on p.id = a.product_id
order by a.total_qty desc, a.product_id limit {K.TOP_PRODUCTS}
""", "issue_requests", extra=[("part_names", "select p_partkey id, p_name name, 'Nos' unit from part")]))(
    R.top_products)

register("dept_consumption", with_views(f"""
select department, count(*) requests, cast(sum(quantity_issued) as double) total_qty
from issue_requests where {ISSUED} group by department
""", "issue_requests"))(R.dept_consumption)

register("category_overview", with_views(f"""
select c.id category_id, c.name category, count(*) items,
  cast(sum(p.current_stock) as double) total_stock, count(*) filter (where {LOW}) low_items
from products p join categories c on p.category_id = c.id
where p.status='active' group by c.id, c.name
""", "products", "categories"))(R.category_overview)

register("category_totals", with_views("""
select c.name category, cast(sum(p.current_stock) as double) total
from products p join categories c on p.category_id = c.id
where p.status='active' group by c.name
""", "products", "categories"))(R.category_totals)

register("category_share", with_views("""
select category, cast(total as double) total,
  cast(case when max(total) over () > 0
       then round(cast(total as double) * 100.0 / cast(max(total) over () as double))
       else 0 end as bigint) pct
from (select c.name category, sum(p.current_stock) total
      from products p join categories c on p.category_id = c.id
      where p.status='active' group by c.name) t
""", "products", "categories"))(R.category_share)

register("category_stock_report", with_views(f"""
select c.name category, count(p.id) total_products,
  cast(coalesce(sum(p.current_stock), 0) as double) total_stock,
  cast(sum(case when {LOW} then 1 else 0 end) as bigint) low_items,
  cast(sum(case when {CRIT} then 1 else 0 end) as bigint) critical_items
from categories c left join products p on p.category_id = c.id and p.status='active'
group by c.id, c.name
""", "products", "categories"))(R.category_stock_report)

register("employee_history_top", with_views(f"""
select employee_name, department, count(*) total_requests,
  cast(sum(quantity_issued) as double) total_qty, max(issued_at) last_issued_at
from issue_requests where {ISSUED}
group by employee_name, department
order by total_requests desc, employee_name, department nulls first limit {K.TOP_EMPLOYEES}
""", "issue_requests"))(R.employee_history_top)

register("employee_history", with_views(f"""
select employee_name, department, count(*) total_requests,
  cast(sum(quantity_issued) as double) total_qty,
  cast(cast(max(issued_at) as date) as varchar) last_request_date
from issue_requests where {ISSUED}
group by employee_name, department
""", "issue_requests"))(R.employee_history)

register("status_counts", with_views("""
select status, count(*) cnt from issue_requests group by status
union all select 'all', count(*) from issue_requests
""", "issue_requests"))(R.status_counts)

register("indent_status_counts", with_views("""
select status, count(*) cnt from indents group by status
union all select 'all', count(*) from indents
""", "indents"))(R.indent_status_counts)

register("last_login", with_views("""
select u.id, u.name, l.last_login,
  case when l.last_login is null then 'Never'
       else strftime(l.last_login, '%d %b %Y, %I:%M %p') end last_login_text
from users u left join (select user_id, max(created_at) last_login from audit_log
                        where action='LOGIN' group by user_id) l on l.user_id = u.id
""", "users", "audit_log"))(R.last_login)

register("daily_issue_report", with_views(f"""
select r.issue_number, r.created_at, r.employee_name, r.department, p.p_name product,
  {dbl('r.quantity_requested')}, cast(coalesce(r.quantity_issued, 0) as double) quantity_issued,
  coalesce(r.work_order_ref, '') work_order, coalesce(u.name, '') issued_by, r.status
from (select *, printf('ISS-%04d', row_number() over (order by created_at, id)) issue_number
      from issue_requests) r
join part p on r.product_id = p.p_partkey
left join users u on r.issued_by = u.id
where {in_range('r.created_at')}
""", "issue_requests", "users"))(R.daily_issue_report)

register("stock_summary", with_views(f"""
select p.product_code, p.name, c.name category, p.unit, {dbl('p.current_stock')},
  {dbl('p.reserved_stock')}, cast(p.current_stock - p.reserved_stock as double) available,
  {dbl('p.min_stock_level')}, coalesce(p.rack_location, '') location,
  coalesce(p.supplier_name, '') supplier,
  case when {CRIT} then 'Critical' when {LOW} then 'Low' else 'Good' end stock_status
from products p left join categories c on p.category_id = c.id
where p.status='active'
""", "products", "categories"))(R.stock_summary)

register("low_stock_report", with_views(f"""
select p.product_code, p.name, c.name category, p.unit, {dbl('p.current_stock')},
  {dbl('p.min_stock_level')}, cast(p.current_stock - p.reserved_stock as double) available,
  coalesce(p.supplier_name, '') supplier, coalesce(p.rack_location, '') location,
  case when {CRIT} then 'CRITICAL' else 'LOW' end alert_level,
  cast(p.current_stock as double) / nullif(cast(p.min_stock_level as double), 0) ratio
from products p left join categories c on p.category_id = c.id
where {LOW} and p.status='active'
""", "products", "categories"))(R.low_stock_report)

COVERAGE = """case when p.min_stock_level > 0
  then least(100.0, cast(p.current_stock as double) / cast(p.min_stock_level as double) * 100.0)
  else 100.0 end"""

register("low_stock_top", with_views(f"""
select p.id, p.product_code, p.name, c.name category, {dbl('p.current_stock')},
  {dbl('p.min_stock_level')},
  cast(p.current_stock as double) / nullif(cast(p.min_stock_level as double), 0) ratio,
  {COVERAGE} coverage_pct
from products p left join categories c on p.category_id = c.id
where {LOW} and p.status='active'
order by ratio asc nulls first, p.id limit {K.TOP_LOW_STOCK}
""", "products", "categories"))(R.low_stock_top)

register("stock_ledger", with_views(f"""
select st.txn_number, st.created_at, p.p_name product,
  {sql_case('st.type', K.MOVEMENT_LABELS, sql_ucfirst('st.type'))} type_label,
  cast(case when st.type in ('stock_in','adjustment_in','return') then st.quantity else 0 end
       as double) qty_in,
  cast(case when st.type in ('stock_out','adjustment_out') then st.quantity else 0 end
       as double) qty_out,
  {dbl('st.balance_before')}, {dbl('st.balance_after')}, coalesce(st.reference_number, '') reference,
  coalesce(st.invoice_number, '') invoice, coalesce(st.remarks, '') remarks,
  coalesce(u.name, 'System') done_by
from stock_transactions st join part p on st.product_id = p.p_partkey
left join users u on st.created_by = u.id
where {in_range('st.created_at')}
""", "stock_transactions", "users"))(R.stock_ledger)

register("audit_export", with_views(f"""
select created_at, user_name, user_role, action, module, details, ip_address from audit_log
where {in_range('created_at', A_FROM, A_TO)}
""", "audit_log"))(R.audit_export)

register("issue_review", with_views(f"""
select r.id, r.product_id, p.name product, {dbl('r.quantity_requested')},
  {dbl('p.current_stock')}, cast(p.current_stock - p.reserved_stock as double) available,
  (p.current_stock - p.reserved_stock) >= r.quantity_requested can_issue,
  (r.quantity_requested > p.current_stock - p.reserved_stock
   and p.current_stock - p.reserved_stock >= 0) shortage,
  {COVERAGE} coverage_pct,
  cast(least(p.current_stock - p.reserved_stock, r.quantity_requested) as double) suggested_qty
from issue_requests r join products p on r.product_id = p.id where r.status='pending'
""", "issue_requests", "products"))(R.issue_review)

register("pending_issues", with_views("""
select r.id, r.employee_name, r.product_id, p.p_name product_name, 'Nos' unit,
  cast(r.quantity_requested as double) quantity_requested, r.created_at
from issue_requests r join part p on r.product_id = p.p_partkey where r.status='pending'
""", "issue_requests"))(R.pending_issues)

@register("recent_pending", with_views(f"""
select r.id, r.employee_name, r.product_id, p.p_name product_name, 'Nos' unit,
  cast(r.quantity_requested as double) quantity_requested, r.created_at
from issue_requests r join part p on r.product_id = p.p_partkey where r.status='pending'
order by r.created_at desc, r.id limit {K.TOP_PENDING}
""", "issue_requests"))
def recent_pending(v, p):
    """L-02: five newest pending requests (dashboard)."""
    return R.pending_issues(v, p, K.TOP_PENDING)

_role = "coalesce(u.role, 'system')"
register("audit_enriched", with_views(f"""
select a.id, a.user_id,
  case when u.name is null or trim(u.name) = '' then 'System' else u.name end user_name,
  {sql_case(_role, K.ROLE_LABELS, sql_ucfirst(_role))} role_label,
  u.department, a.action, {sql_case('a.action', K.ACTION_SEVERITY, "'gray'")} severity,
  a.module, a.created_at
from audit_log a left join users u on a.user_id = u.id
""", "audit_log", "users"))(R.audit_enriched)

register("issue_slips", with_views("""
select r.id, printf('P-%04d', p.p_partkey) product_code, p.p_name product, c.name category,
  'Nos' unit, p.p_brand rack_location, cast(r.quantity_requested as double) quantity_requested,
  cast(r.quantity_issued as double) quantity_issued, r.employee_name,
  e.username employee_username, e.role employee_role, r.department,
  i.name issued_by_name, r.issued_at, r.status
from issue_requests r join part p on r.product_id = p.p_partkey
left join categories c on c.name = p.p_type
left join users i on r.issued_by = i.id
left join users e on r.employee_id = e.id
where r.status = 'issued'
""", "issue_requests", "categories", "users"))(R.issue_slips)

register("indent_review", with_views(f"""
select i.id, e.name employee_name, e.department, i.status,
  {sql_case('i.status', K.STATUS_LABELS, sql_ucfirst('i.status'))} status_label, i.priority,
  {sql_case('i.priority', K.PRIORITY_LABELS, sql_ucfirst('i.priority'))} priority_label,
  a.name approver_name, i.created_at
from (select *, case when status='approved' then employee_id % 30 end approved_by from indents) i
left join users e on i.employee_id = e.id
left join users a on i.approved_by = a.id
""", "indents", "users"))(R.indent_review)

register("recent_activity", with_views(f"""
select id, user_name, action, module, created_at from audit_log
order by created_at desc, id desc limit {K.TOP_ACTIVITY}
""", "audit_log"))(R.recent_activity)

register("issued_today", with_views(f"""
select id, employee_name, product_id, cast(quantity_issued as double) quantity_issued, issued_at
from issue_requests where status='issued' and cast(issued_at as date) = {AS_OF}
""", "issue_requests"))(R.issued_today)

register("facet_values", with_views("""
select distinct facet, value from (
  select 'department' facet, department value from users where department is not null
  union all select 'module', module from audit_log
  union all select 'action', action from audit_log) x
""", "users", "audit_log"))(R.facet_values)

register("audit_users", with_views("""
select distinct user_id, user_name from audit_log where user_name is not null
""", "audit_log"))(R.audit_users)
